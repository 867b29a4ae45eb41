"""Texts and files as tables of records.

``documents`` reads whole texts, one task for each file: the format is detected and the records come out in order.
``lines`` reads splittable line formats of any size where the format is known.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.jsontext import dumps
from tamis.operators.binding import Binding
from tamis.operators.dynamic import Fields, Json, Pairs, Text
from tamis.sources.decode import Broken, csv_line, decode, logfmt_value
from tamis.sources.detect import BLANKS, CSV, JSON, LOGFMT, TEXT

#: source: place of the source; at: place in it; line: read line by line; raw: original text of objects; doc: JSON;
#: echo: the physical line; broken: why there is no value.
RECORDS = "source int, at bigint, line boolean, raw string, doc string, echo string, broken string"


def of_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "source int, text string")


def of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Whole files in the given order, each one row."""
    found = None
    for i, path in enumerate(paths):
        own = spark.read.text(path, wholetext=True).select(F.lit(i).alias("source"), F.col("value").alias("text"))
        found = own if found is None else found.unionByName(own)
    return found if found is not None else spark.createDataFrame([], "source int, text string")


def records(documents: DataFrame, forced: str | None = None, by_line: bool = False) -> DataFrame:
    """The records of whole texts (source, text), as RECORDS."""
    names = [p.split()[0] for p in RECORDS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(source, r.at, r.line, r.raw, None if r.broken is not None else dumps(r.value), r.echo, r.broken) for r in decode(text or "", forced, by_line)]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return documents.mapInArrow(run, RECORDS)


def bound(found: DataFrame) -> tuple[DataFrame, Binding]:
    """Records with a VARIANT column, and the binding to query them."""
    found = found.filter("broken is null").withColumn("rec", F.try_parse_json("doc"))
    return found, Json(F.col("rec"), F.col("doc"), F.col("raw"))


@dataclass(frozen=True)
class Lines:
    """A table of lines (raw and what they split into) with its binding."""

    df: DataFrame
    binding: Binding


def lines(source: DataFrame, fmt: str, column: str = "value", blanks: str = BLANKS, every: bool = False) -> Lines:
    """The lines of a text column, each a record of one known format; blank and broken lines are left out.

    Of plain text, blanks are the characters that part words; with every, blank lines and nulls stay, without words.

    Stays in the JVM for JSON and text. Of a table, only logfmt lines with a quote or backslash go through Python, as a
    branch of their own that reads the source once more; quoted CSV goes through Python in Arrow batches. Works for batches and streams alike.
    """
    if fmt != TEXT and (every or blanks != BLANKS):
        raise ValueError(f"blanks and every are for plain text, not {fmt}")
    raw = F.regexp_replace(F.col(column), "\\r\\z", "")
    rows = source.withColumn("raw", raw)
    if not every:
        rows = rows.filter(~F.col("raw").rlike(f"^[{blanks}]*\\z"))
    if fmt == JSON:
        # Arrays and scalars are records too, but have no original text.
        rows = rows.withColumn("rec", F.try_parse_json("raw")).filter("rec is not null")
        is_object = F.schema_of_variant(F.col("rec")).startswith("OBJECT")
        rows = rows.withColumn("doc", F.col("raw")).withColumn("own", F.when(is_object, F.col("raw")))
        return Lines(rows, Json(F.col("rec"), F.col("doc"), F.col("own")))
    if fmt == TEXT:
        rows = rows.withColumn("parts", F.filter(F.split("raw", f"[{blanks}]+"), lambda w: w != ""))
        return Lines(rows, Text(F.col("parts"), F.col("raw"), blanks))
    if fmt == LOGFMT:
        simple = F.col("raw").rlike(SIMPLE)
        if rows.isStreaming:  # a stream is read once, so its simple lines pass by Python as nulls
            rows = rows.withColumn("simple", simple).withColumn("pairs", _pairs(F.when(~F.col("simple"), F.col("raw")))).filter("simple or pairs is not null")
        else:
            plain = rows.filter(simple).withColumn("simple", F.lit(True)).withColumn("pairs", F.lit(None).cast("map<string,string>"))
            others = rows.filter(~simple).withColumn("simple", F.lit(False)).withColumn("pairs", _pairs(F.col("raw"))).filter("pairs is not null")
            rows = plain.unionByName(others)
        return Lines(rows, Pairs(F.col("simple"), F.col("pairs"), F.col("raw")))
    if fmt == CSV:
        rows = rows.withColumn("parts", _fields(F.col("raw"))).filter("parts is not null")
        return Lines(rows, Fields(F.col("parts"), F.col("raw")))
    raise ValueError(f"no line format {fmt!r}")


#: Lines of blank-separated pairs without quotes and escapes.
SIMPLE = f"^[{BLANKS}]*+[^{BLANKS}=\"\\\\]++=[^{BLANKS}\"\\\\]*+(?:[{BLANKS}]++[^{BLANKS}=\"\\\\]++=[^{BLANKS}\"\\\\]*+)*+[{BLANKS}]*+\\z"


def _pairs(raw: Column) -> Column:
    """A map of a logfmt line, or null where it is none."""

    def run(s: pd.Series) -> pd.Series:
        def one(line):
            if line is None:
                return None
            try:
                return logfmt_value(line)
            except Broken:
                return None

        return s.map(one)

    return F.pandas_udf(run, "map<string,string>").asNondeterministic()(raw)


def _fields(raw: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        def one(line):
            if line is None:
                return None
            try:
                return csv_line(line)
            except Broken:
                return None

        return s.map(one)

    quoted = F.contains(raw, F.lit('"'))
    return F.when(quoted, F.pandas_udf(run, "array<string>")(F.when(quoted, raw))).otherwise(F.split(raw, ","))
