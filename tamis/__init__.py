"""Tamis: select, filter and format semi-structured records with Spark."""
