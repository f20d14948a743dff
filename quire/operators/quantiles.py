"""Exact percentiles of groups of any size: order statistics found by counting in ranges that narrow.

A round cuts each range at approximate quantiles (a sketch that merges), counts exactly how many values each part has, and goes on with the part that holds the wanted rank. What is left after
a few rounds are few distinct values with their counts. So no task holds a group's values, and one task's answer for a group is as large as a sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import saved

#: Groups up to so many values are aggregated as they are; so many values may be left of a range.
SMALL = 1_000_000
LEFT = 100_000
_CUTS, _ACCURACY, _ROUNDS = 64, 2000, 12
#: The interval that reports give.
HDI = {"hdi_3": 0.03, "hdi_97": 0.97}


def percentiles(df: DataFrame, by: list[str], value: Column | str, shares: dict[str, float], small: int = SMALL, left: int = LEFT) -> DataFrame:
    """by, and a column for each name of ``shares``: the percentile between order statistics, interpolated. Missing values (null or NaN) don't count; a group with none but these has nulls."""
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, F.when(~F.isnan(x.cast("double")), x.cast("double")).alias("_x"))
    rows = saved(rows)
    sizes = rows.groupBy(*by).agg(F.count("_x").alias("_n"))
    plain = lambda t: t.groupBy(*by).agg(*[F.percentile("_x", p).alias(c) for c, p in shares.items()])
    if sizes.filter(F.col("_n") > small).isEmpty():
        return plain(rows)
    sizes = saved(sizes)
    met = _beside(rows, sizes, by)
    many = _selected(met.filter((F.col("_n") > small) & F.col("_x").isNotNull()), by, shares, left)
    return plain(met.filter(F.col("_n") <= small).select(*by, "_x")).unionByName(many) if by else many


def _beside(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``a`` with ``b``'s columns, by keys that may be null; without keys ``b`` is a few rows."""
    if not by:
        return a.crossJoin(F.broadcast(b))
    other = {c: f"{c}_of_b" for c in by}
    b = b.withColumnsRenamed(other)
    return a.join(b, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()], how).drop(*other.values())


def _selected(rows: DataFrame, by: list[str], shares: dict[str, float], left: int) -> DataFrame:
    """Of rows (by, _x, _n) the percentiles of each group, by rank."""
    place = F.array(*[F.struct(F.lit(c).alias("_name"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_at")) for c, p in shares.items()])
    groups = rows.select(*by, "_n").distinct().select(*by, F.explode(place).alias("p")).select(*by, "p.*")
    # each wanted rank by itself; below: values before the range
    ranks = groups.select(*by, "_name", "_at", F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.floor("_at").alias("_rank")), F.struct(F.lit(1).alias("_side"), F.ceil("_at").alias("_rank")))).alias("r")).select(*by, "_name", "_at", "r.*")
    infinite = float("inf")
    state = saved(ranks.withColumns({"_lo": F.lit(-infinite), "_hi": F.lit(infinite), "_below": F.lit(0).cast("long"), "_within": F.lit(None).cast("long")}))
    key = [*by, "_lo", "_hi"]  # ranks that share a range are counted once
    open_ = F.col("_within").isNull() | ((F.col("_within") > left) & (F.col("_lo") < F.col("_hi")))
    for _ in range(_ROUNDS):
        ranges = state.filter(open_).select(*key).distinct()
        if ranges.isEmpty():
            break
        held = _beside(rows.select(*by, "_x"), ranges, by).filter("_x >= _lo AND _x <= _hi")
        cuts = held.groupBy(*key).agg(F.array_distinct(F.percentile_approx("_x", [i / _CUTS for i in range(_CUTS + 1)], _ACCURACY)).alias("_cuts"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
        cuts = cuts.select(*key, F.array_sort(F.array_distinct(F.concat(F.array("_first"), "_cuts", F.array("_last")))).alias("_cuts"))
        # parts: 2i for the i-th cut itself, 2i + 1 for what lies between it and the next
        inside = _beside(held, cuts, key)
        upto = F.size(F.filter("_cuts", lambda c: c <= F.col("_x")))
        part = 2 * (upto - 1) + (F.element_at("_cuts", upto) < F.col("_x")).cast("int")
        counted = inside.groupBy(*key, part.alias("_part")).agg(F.count(F.lit(1)).alias("_k"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        w = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # 2 * _CUTS parts
        counted = counted.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0)))
        moved = state.filter(open_)
        met = _beside(moved, counted, key)
        met = met.filter((F.col("_rank") - F.col("_below") >= F.col("_before")) & (F.col("_rank") - F.col("_below") < F.col("_before") + F.col("_k")))
        met = met.select(*by, "_name", "_at", "_side", "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_k").alias("_within"))
        state = saved(state.filter(~open_).unionByName(met))
    ranges = state.filter("_lo < _hi").select(*key).distinct()
    per = _beside(rows.select(*by, "_x"), ranges, by).filter("_x >= _lo AND _x <= _hi").groupBy(*key, "_x").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*key).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)  # LEFT values at most
    per = per.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    known = state.filter("_lo = _hi").select(*by, "_name", "_at", "_side", F.col("_lo").alias("_v"))
    rest = state.filter("_lo < _hi")
    found = _beside(rest, per, key)
    found = found.filter((F.col("_rank") - F.col("_below") >= F.col("_before")) & (F.col("_rank") - F.col("_below") < F.col("_before") + F.col("_k")))
    both = known.unionByName(found.select(*by, "_name", "_at", "_side", F.col("_x").alias("_v")))
    per_name = both.groupBy(*by, "_name", "_at").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    return per_name.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == c, value)).alias(c) for c in shares])


def with_percentiles(aggregates: DataFrame, df: DataFrame, by: list[str], value: Column | str, shares: dict[str, float]) -> DataFrame:
    """``aggregates`` (a row for each group) with the percentiles of its group's values."""
    p = percentiles(df, by, value, shares)
    if not by:
        return aggregates.crossJoin(F.broadcast(p))  # one row
    return _beside(aggregates, p, by, "left")
