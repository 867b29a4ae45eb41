"""Running expressions: on tables, on texts and files of any format, and on lines of one format."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators import typed
from tamis.plans.ast import Query
from tamis.plans.parser import compile_expression
from tamis.sources import texts


class BrokenFirstLine(ValueError):
    """The first line of a source is not in the format it looks like."""


def query(df: DataFrame, expression: str, template: str | None = None, name: str = "value") -> DataFrame:
    """What an expression prints for each row of a table with a schema, in one text column."""
    return typed.select(df, compile_expression(expression, template), name)


def where(df: DataFrame, expression: str) -> DataFrame:
    """The rows of a table that pass an expression's filter."""
    return typed.where(df, compile_expression(expression))


@dataclass(frozen=True)
class Run:
    """values: source, at, value, in order of (source, at). problems: source, at, line, message of lines that were left out."""

    values: DataFrame
    problems: DataFrame

    def collect(self) -> list[str]:
        """The printed values in order; raises where the first line of a source is broken."""
        first = self.problems.filter("at = 1").orderBy("source").first()
        if first is not None:
            raise BrokenFirstLine(f"source {first['source']}, line 1: {first['message']}")
        return [r["value"] for r in self.values.orderBy("source", "at").collect()]

    def write(self, path: str) -> None:
        """The printed values as text files, which in order of their names hold the values in order."""
        self.values.orderBy("source", "at").select("value").write.text(path)


def run(documents: DataFrame, expression: str | None = None, template: str | None = None, fmt: str | None = None) -> Run:
    """An expression on whole texts (source, text), each in the format it is detected to have.

    Without an expression every line that parses is printed as it is. fmt keeps only the detected formats that are
    compatible with it; it does not count where lines are echoed.
    """
    if expression is None and template is None:
        found = texts.records(documents, by_line=True)
        values = found.filter("broken is null").select("source", "at", F.col("echo").alias("value"))
    else:
        compiled = compile_expression(expression or "", template)
        streamed = compiled.selector is None and compiled.template is None
        found = texts.records(documents, fmt, by_line=streamed)
        values = _printed(found, compiled, streamed)
    problems = found.filter("broken is not null").select("source", "at", F.col("echo").alias("line"), F.col("broken").alias("message"))
    return Run(values, problems)


def _printed(found: DataFrame, compiled: Query, streamed: bool) -> DataFrame:
    rows, binding = texts.bound(found)
    if streamed:
        # The original text, or the JSON of values that have none.
        kept = binding.where(rows, compiled)
        return kept.select("source", "at", F.coalesce("raw", "doc").alias("value"))
    if compiled.selector is None:
        return binding.select(rows, compiled, carry=("source", "at"))
    rows, binding = binding.prepared(rows, compiled)
    cell = binding.cell(compiled.selector)
    shown = rows.select("source", "at", "line", cell.shown(pretty=True).alias("value"))
    # A missing field prints nothing from a document and a blank line from a line.
    return shown.filter("line or value is not null").select("source", "at", F.coalesce("value", F.lit("")).alias("value"))


def run_texts(spark: SparkSession, sources: list[str], expression: str | None = None, template: str | None = None, fmt: str | None = None) -> Run:
    return run(texts.of_texts(spark, sources), expression, template, fmt)


def run_files(spark: SparkSession, paths: list[str], expression: str | None = None, template: str | None = None, fmt: str | None = None) -> Run:
    return run(texts.of_files(spark, paths), expression, template, fmt)


def run_lines(source: DataFrame, fmt: str, expression: str, template: str | None = None, column: str = "value", carry: tuple[str, ...] = (), blanks: str = texts.BLANKS, every: bool = False) -> DataFrame:
    """An expression on the lines of a text column in one known format: splittable, for batches and streams.

    Of plain text, blanks are the characters that part words, and with every each row that passes the filter prints
    one, null where it lacks the selected word.
    """
    found = texts.lines(source, fmt, column, blanks, every)
    return found.binding.select(found.df, compile_expression(expression, template), carry=carry, every=every)


def convert(documents: DataFrame) -> DataFrame:
    """source, at, value: each line as JSON; lines of CSV and text become arrays of their fields or words."""
    rows = texts.records(documents, by_line=True).filter("broken is null")
    array = F.get_json_object("doc", "$._array")
    listed = F.col("doc").startswith('{"_array":') & F.col("raw").isNotNull()
    return rows.select("source", "at", F.when(listed & array.isNotNull(), array).otherwise(F.col("doc")).alias("value"))
