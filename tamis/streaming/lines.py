"""Expressions on streams of lines.

A stream of lines has one format. It is given, or taken from the first line that is not blank in the first batch and
kept beside the checkpoint, so that a restart goes on with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamis.api import run_lines
from tamis.sources.decode import line_format
from tamis.sources.detect import BLANKS


def transformed(lines: DataFrame, fmt: str, expression: str, template: str | None = None) -> DataFrame:
    """What an expression prints for each line of a stream in a known format; stateless."""
    return run_lines(lines, fmt, expression, template)


def start(lines: DataFrame, expression: str, output: str, checkpoint: str, template: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Writes what an expression prints to text files, in the format that the first line tells.

    Each batch is written to its own folder, so a batch that runs twice replaces its own output.
    """

    def batch(df: DataFrame, number: int) -> None:
        fmt = _format(df.sparkSession, f"{checkpoint}/format", df)
        if fmt is not None:
            run_lines(df, fmt, expression, template).write.mode("overwrite").text(f"{output}/batch={number}")

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/offsets")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _format(spark: SparkSession, path: str, df: DataFrame) -> str | None:
    jvm = spark.sparkContext._jvm
    kept = jvm.org.apache.hadoop.fs.Path(path)
    if kept.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(kept):
        return spark.read.text(path).first()["value"]
    first = df.filter(~F.col("value").rlike(f"^[{BLANKS}]*\\z")).first()
    if first is None:
        return None
    fmt = line_format(first["value"])
    spark.createDataFrame([(fmt,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return fmt
