"""Numbers and running sums over a whole table's order, without one task that holds it.

Rows are dealt out by ranges of the order; each range is numbered by itself, and what lies before it is added: a sum for each range, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import saved


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` by ``key``, in so many partitions that each has about ``rows`` rows: what tasks hold for sorts, windows and groups by the key stays bounded, however large the table. ``df`` is counted, so it should be read from files."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(n, key)


def running_total(df: DataFrame, order: list[str], value: Column, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before a row in the order (within ``by``), 0 for the first. The order has to be total."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written down once: the ranges of a second evaluation could differ.
    dealt = saved(df.withColumn("_v", value).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_v").alias("_sum"))
    offsets = sums.withColumn("_offset", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    own = F.sum("_v").over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0)
    out_df = dealt.withColumn("_own", own).join(offsets, [*by, "_range"])
    return out_df.withColumn(out, F.coalesce("_own", zero) + F.coalesce("_offset", zero)).select(*df.columns, out)


def least_from_here(df: DataFrame, order: list[str], value: Column, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the least ``value`` of a row and all rows after it in the order (within ``by``). The order has to be total."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.withColumn("_v", value).repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()))
    mins = dealt.groupBy(*by, "_range").agg(F.min("_v").alias("_m"))
    after = mins.withColumn("_after", F.min("_m").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(1, Window.unboundedFollowing))).drop("_m")
    # From the end: Spark takes a frame that ends with the partition anew for each row, in quadratic time.
    own = F.min("_v").over(Window.partitionBy(*by, "_range").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_own", own).join(after, [*by, "_range"]).withColumn(out, F.least("_own", "_after")).select(*df.columns, out)


def numbered(df: DataFrame, order: list[str], out: str = "place", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place in the order, from 0. The order has to be total."""
    return running_total(df, order, F.lit(1).cast("long"), out, by)
