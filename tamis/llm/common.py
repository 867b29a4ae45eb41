"""What the text operators share: scratch tables, ranks over all rows and joins with a checked side."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table with a few numbers a row is broadcast (some 20 MB at most).
BROADCAST_ROWS = 200_000
#: Copies of the small side, and salts of the large one, in a join past that bound.
SALTS = 16

_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where it is unset and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tamis.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="tamis-")
        spark.conf.set("spark.tamis.scratch", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A table written to the shared folder: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/tamis-{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.schema = df.schema
        _written.append((self.spark, self.path))

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def written(df: DataFrame, name: str) -> DataFrame:
    return Scratch(df, name).df()


def give_back() -> None:
    """Return the memory of dropped arrays and tables to the system: what one operator fitted must not narrow the driver of the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc keeps pages that need this
        return


def join_small(big: DataFrame, small: DataFrame, on: list[str], small_rows: int, how: str = "inner", spread: Column | None = None) -> DataFrame:
    """Join with a side of small_rows rows: broadcast up to BROADCAST_ROWS; beyond that both sides are salted, so a hot key meets SALTS tasks.

    spread: what the salt of a row of the large side is made from, so that a retried task gives the same one.
    """
    if small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64(spread if spread is not None else F.struct(*big.columns)), F.lit(SALTS)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return big.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def only(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """The named columns, cast; a missing one is null. Other columns, whatever their names, take no further part.

    A name that occurs more than once counts as the first column of that name.
    """
    names = [f.name for f in df.schema.fields]
    positions = {}
    for i, name in enumerate(names):
        positions.setdefault(name, i)
    if len(set(names)) < len(names):
        plain = [f"_c{i}" for i in range(len(names))]
        df = df.toDF(*plain)
        at = {name: plain[i] for name, i in positions.items()}
    else:
        at = {name: f"`{name}`" for name in names}
    return df.select(*[(F.col(at[name]) if name in at else F.lit(None)).cast(kind).alias(name) for name, kind in columns])
