"""Splits and samples by portable hashes: the same members on any cluster. Sizes follow the published arithmetic, members don't (its generators aren't portable)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.hashing import uniform
from quire.operators.graph import saved
from quire.operators.ranking import numbered, running_total

SPLITS = ("train", "val", "test")


def _cut(df: DataFrame, key: str, seed: str, train: Column, val: Column) -> DataFrame:
    """Keys in the order of a hash: the first ``train`` places, the next ``val``, the rest."""
    n = df.select(key).distinct().withColumn("_u", uniform(F.lit(seed), key))
    out = numbered(n, ["_u", key], "_i").crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    return out.select(key, F.when(F.col("_i") < train, "train").when(F.col("_i") < train + val, "val").otherwise("test").alias("split"))


def split_70_15_15(df: DataFrame, key: str = "dossier", seed: str = "0") -> DataFrame:
    """key, split. The held-out part is ceil(0.3 n), of which ceil(half) is test."""
    n = F.col("_n")
    held = F.ceil(n * F.lit(0.3) - F.lit(1e-9))
    return _cut(df, key, seed, n - held, held - F.ceil(held / 2))


def split_60_20_20(df: DataFrame, key: str = "dossier", seed: str = "0") -> DataFrame:
    n = F.col("_n")
    train = F.floor(n * F.lit(0.6) + F.lit(1e-9))
    return _cut(df, key, seed, train, F.floor(n * F.lit(0.8) + F.lit(1e-9)) - train)


def split_rounded(df: DataFrame, key: str = "dossier", seed: str = "0", ratios=(0.7, 0.15)) -> DataFrame:
    """Rounded half to even, at least 1 each for train and val."""
    n = F.col("_n")
    return _cut(df, key, seed, F.greatest(F.lit(1), F.bround(n * ratios[0])), F.greatest(F.lit(1), F.bround(n * ratios[1])))


def stratified(df: DataFrame, key: str, label: str, seed: str = "0", ratios=(0.7, 0.15)) -> DataFrame:
    """key, label, split, by class: below three rows all is train; else rounded shares of at least 1, val only if two rows are left."""
    rows = df.select(key, label).withColumn("_u", uniform(F.lit(seed), key))
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(label, "_l")
    # numbered in ranges, so that a class of any size is several tasks'
    rows = numbered(rows, ["_u", key], "_i", (label,))
    rows = rows.join(sizes, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    n = F.col("_n")
    train = F.greatest(F.lit(1), F.bround(n * ratios[0]))
    val = F.when(n - train >= 2, F.greatest(F.lit(1), F.bround(n * ratios[1]))).otherwise(0)
    split = F.when((n < 3) | (F.col("_i") < train), "train").when(F.col("_i") < train + val, "val").otherwise("test")
    return rows.select(key, label, split.alias("split"))


def _pinned(holds, rarity: list[int]):
    """The split (-1: none) of each dossier, given who holds which class (dossiers in hash order x classes), and the places of a class that stay empty."""
    import numpy as np

    split = np.full(len(holds), -1)
    empty = []
    for j in rarity:
        own = holds[:, j]
        lacking = np.setdiff1d(np.arange(len(SPLITS)), split[own])
        fresh = np.flatnonzero(own & (split < 0))[: len(lacking)]
        split[fresh] = lacking[: len(fresh)]
        empty += [(j, int(s)) for s in lacking[len(fresh) :]]
    return split, empty


def _levelled(n: int, room: list[int]) -> list[int]:
    """n in parts such that what is left of each room is as even as can be; a room that is overfull already gets none."""
    order = sorted(range(len(room)), key=lambda i: -room[i])
    for m in range(len(room), 0, -1):
        top = order[:m]
        left = (sum(room[i] for i in top) - n) / m
        if m == 1 or room[top[-1]] >= left:
            break
    part = {i: math.floor(room[i] - left) for i in top}
    for i in top[: n - sum(part.values())]:
        part[i] += 1
    return [max(0, part.get(i, 0)) for i in range(len(room))]


def group_stratified(coverage: DataFrame, key: str, label: str, seed: str = "0", ratios=(0.7, 0.15, 0.15)) -> tuple[DataFrame, list[tuple[str, str]]]:
    """((key, split) of every dossier, [(class, split) not covered]).

    First every class, the rarest first, gets a dossier in each split that has none of it yet. That takes three dossiers a class at most, so of a class only
    the first 3 x classes dossiers in hash order can ever be needed: these are all that the driver sees. All others are cut in hash order
    to the sizes that the ratios leave, without leaving the cluster.
    """
    held = saved(coverage.filter(F.col(label).isNotNull()).select(key, label).distinct().withColumn("_u", uniform(F.lit(seed), key)))
    sizes = {r[label]: r["count"] for r in held.groupBy(label).count().collect()}  # a vocabulary
    classes = sorted(sizes)
    first = Window.partitionBy(label).orderBy("_u", key)
    able = held.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= len(SPLITS) * len(classes)).select(key).distinct()
    seen = held.join(able, key, "left_semi").groupBy("_u", key).agg(F.collect_set(label).alias("has")).orderBy("_u", key).collect()  # 3 x classes^2 dossiers at most
    import numpy as np

    holds = np.array([[c in r["has"] for c in classes] for r in seen], bool).reshape(len(seen), len(classes))
    split, empty = _pinned(holds, sorted(range(len(classes)), key=lambda j: (sizes[classes[j]], classes[j])))
    fixed = coverage.sparkSession.createDataFrame([(r[key], SPLITS[s]) for r, s in zip(seen, split) if s >= 0], coverage.select(key, F.lit("").alias("split")).schema)
    everyone = coverage.select(key).distinct().withColumn("_u", uniform(F.lit(seed), key))
    rest = saved(everyone.join(F.broadcast(fixed), key, "left_anti"))  # three dossiers a class
    n = rest.count()
    pinned = [int((split == i).sum()) for i in range(len(SPLITS))]
    train, val, _ = _levelled(n, [round(r * (n + sum(pinned))) - k for r, k in zip(ratios, pinned)])
    place = F.col("_i")
    others = numbered(rest, ["_u", key], "_i").select(key, F.when(place < train, SPLITS[0]).when(place < train + val, SPLITS[1]).otherwise(SPLITS[2]).alias("split"))
    return fixed.unionByName(others), [(classes[j], SPLITS[s]) for j, s in empty]


def coverage_audit(rows: DataFrame, label: str = "document_type", split: str = "split", key: str | None = None) -> DataFrame:
    """A row for each class: its rows (or distinct keys) in each split, and missing, the splits that have none."""
    n = F.count(F.lit(1)) if key is None else F.count_distinct(key)
    out = rows.groupBy(F.col(label).alias("class")).pivot(split, list(SPLITS)).agg(n).na.fill(0)
    return out.withColumn("missing", F.concat_ws(",", *[F.when(F.col(s) == 0, s) for s in SPLITS]))


def from_column(df: DataFrame, column: str) -> DataFrame:
    """``df`` with split taken from a column, which has to be there."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to take splits from; there are {df.columns}")
    return df.withColumn("split", F.col(column))


def weighted_draws(weights: DataFrame, key: str, weight: str, n: int, seed: str = "0") -> DataFrame:
    """i, key: n draws with replacement, by weight. Each draw's uniform number falls into one key's stretch of the running sum.

    Both sides are cut at the same bounds of the running sum, so they meet by equal slot, not pair by pair.
    """
    total = weights.agg(F.sum(weight).alias("_t"))
    slots = 1024
    w = running_total(weights, [key], F.col(weight), "_before").crossJoin(F.broadcast(total))  # one row
    w = w.withColumn("hi", (F.col("_before") + F.col(weight)) / F.col("_t")).withColumn("lo", F.col("hi") - F.col(weight) / F.col("_t"))
    slot = lambda x: F.least(F.floor(x * slots), F.lit(slots - 1)).cast("int")
    w = w.filter(F.col(weight) > 0).withColumn("slot", F.explode(F.sequence(slot(F.greatest(F.col("lo"), F.lit(0.0))), slot(F.col("hi")))))
    draws = weights.sparkSession.range(n).select(F.col("id").alias("i"), uniform(F.lit(seed), "id").alias("u")).withColumn("slot", slot(F.col("u")))
    met = draws.join(w, "slot").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.groupBy("i").agg(F.min(key).alias(key))


def shard(df: DataFrame, draw: str, index: int, of: int) -> DataFrame:
    """Every of-th draw from ``index`` on: shards are disjoint and together all."""
    return df.filter(F.pmod(F.col(draw), F.lit(of)) == index)


def draws_without_replacement(ids: DataFrame, n: int, column: str = "draw", seed: str = "0") -> DataFrame:
    """n of the draws: those with the least hashes."""
    return ids.select(column).distinct().orderBy(uniform(F.lit(seed), column), column).limit(n)


def quantile_sizes(n: int) -> tuple[int, int, int]:
    """Sizes of split_70_15_15."""
    held = math.ceil(0.3 * n - 1e-9)
    return n - held, held - math.ceil(held / 2), math.ceil(held / 2)
