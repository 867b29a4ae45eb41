"""The corpus pipeline: toxic documents go, poor ones go, one document of each near-duplicate group stays, sources are mixed to target weights and the mix is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and
reads it again for the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import jaccard, mixing, packing, quality, queries, toxicity
from tamis.llm.common import BROADCAST_ROWS, written

#: No SQL says what trained models, tokenizers and packing do; tests hold the stages against brute force.
ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not vote toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.learns(5, 0))
    return toxicity.score(docs, model, keep=COLUMNS, evidence=False).filter("predicted = 0").select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the quality threshold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.learns(3, 1))
    return quality.score(docs, model, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null ids last. Rows are told apart by number, so equal ids and null ids are no exception."""
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = written(jaccard.join(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "groups")
    # Rows alone in their group stay as they are; of the others, all but the first go.
    several = groups.groupBy("group").count().filter("count > 1").select("group")
    members = groups.join(_some(several), "group", "left_semi").join(rows.select("row", "doc_id"), "row")
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    stays = members.groupBy("group").agg(first.alias("row")).select("row")
    gone = written(members.select("row").join(stays, "row", "left_anti"), "gone")
    return rows.join(_some(gone), "row", "left_anti").select(*COLUMNS)


def _some(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. This stage runs no Python, so its weights are made of the text, not of the classifier's score."""
    found = mixing.mix(docs, carry=COLUMNS)
    return found.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, in sequences of at most 2048 tokens."""
    return packing.pack(docs, queries.word_bpe(), queries.LIMIT, end_id=0)


STAGES = [
    ("toxicity", clean),
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
