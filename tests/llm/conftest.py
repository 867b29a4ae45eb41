"""Small tables with nulls, empty and very long texts, repeated rows and clashing columns."""

import random

import public_tokenizers
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def sentence(draw, n):
    return " ".join("".join(draw.choice("abcdeéßz") for _ in range(draw.randint(1, 7))) for _ in range(n)) + draw.choice([".", "", "!\n", " \t"])


def make_docs(seed=1, n=120):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        text = sentence(draw, draw.choice([0, 1, 3, 4, 5, 6, 20, 80, 200]))
        if rows and draw.random() < 0.35:
            text = draw.choice(rows)[1] or ""
            words = text.split()
            if words and draw.random() < 0.7:
                words[draw.randrange(len(words))] = "changed"
                text = " ".join(words)
        rows.append((i, text, draw.choice(["en", "fr", None]), draw.choice(["a", "b", "b", "b", "c", None]), len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t ", "en", "", 4), (None, "no id here at all", "en", "a", 17), (None, None, None, None, None)]
    rows += [(n + 3, "x" * 30_000 + " " + "word " * 3000, "en", "c", 45_001), (5, rows[5][1], rows[5][2], rows[5][3], rows[5][4])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The documents with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ("size", "part", "row", "cls", "n", "bucket", "score", "key", "slice", "source_size", "target", "found", "length", "rank", "none", "name", "tie", "label", "kind")
    return docs.select("*", *[F.lit("clash").alias(n) for n in names])
