"""What the operators of this subpackage share: the shared folder, written tables, partition counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local master gets one of its own; on a
    cluster that is an error, since a machine-local folder would be lost with its executor.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, a null one counting as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def guarded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named c0, c1, ... and their names by the old ones, so that no column of a caller clashes with an operator's own."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


#: A broadcast side may be so large; beyond it, operators take a shuffle instead.
BROADCAST_BYTES = 16 << 20


def fits(rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * bytes_per_row <= limit


_kept: dict = {}


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than the default 10,000, which with whole texts would be tens of MB outside the heap; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def worker_cache(name: str, make: Callable):
    """What a Python worker keeps between tasks, made once. It keeps one thing: a later operator's cache takes the place of an earlier one's."""
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = make()
    return _kept[name]


def trim() -> None:
    """Gives freed memory back to the system; a worker lives on after its task, and its peak would stay with it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_parts(batches: Iterable, rows: int = 512) -> Iterator:
    """Arrow batches in slices of so many rows, so that few texts at a time are Python objects; trims at the end."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.slice(a, rows)
        del b
    trim()
