"""How documents compose dossiers: occurrence, co-occurrence, dispersion, order. ``by`` may name a draw: each is summarised by itself.

Segments have dossier, type, order_in_dossier, norm_position. Tables are long; only pairs and types that occur are joined, what is absent follows from marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import saved
from quire.operators.metrics import ratio
from quire.operators.quantiles import HDI, with_percentiles
from quire.operators.ranking import numbered


def type_counts(segs: DataFrame, by=()) -> DataFrame:
    """dossier, type, n where n > 0."""
    return segs.groupBy(*by, "dossier", "type").agg(F.count(F.lit(1)).alias("n"))


def dense(counts: DataFrame, dossiers: DataFrame, types: DataFrame, by=()) -> DataFrame:
    """With a row of 0 for each type (a vocabulary) that a dossier hasn't."""
    grid = dossiers.select(*by, "dossier").crossJoin(F.broadcast(types.select("type")))
    return grid.join(counts, [*by, "dossier", "type"], "left").na.fill(0, ["n"])


def occurrence(counts: DataFrame, dossiers: DataFrame, types: DataFrame, by=()) -> DataFrame:
    """prevalence, mean_count, mean_count_given_present, frac_single_given_present of each type; a type without an instance has zeros."""
    n = dossiers.groupBy(*by).agg(F.count_distinct("dossier").alias("_d"))
    per = counts.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("present"), F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("single"))
    grid = n.crossJoin(F.broadcast(types.select("type")))
    out = grid.join(per, [*by, "type"], "left").na.fill(0, ["present", "total", "single"])
    return out.select(*by, "type", ratio(F.col("present"), F.col("_d")).alias("prevalence"), ratio(F.col("total"), F.col("_d")).alias("mean_count"),
                      ratio(F.col("total"), F.col("present")).alias("mean_count_given_present"), ratio(F.col("single"), F.col("present")).alias("frac_single_given_present"))


def type_pairs(types: DataFrame) -> DataFrame:
    """type_a < type_b: every unordered pair of a vocabulary."""
    return types.select(F.col("type").alias("type_a")).join(F.broadcast(types.select(F.col("type").alias("type_b"))), F.col("type_a") < F.col("type_b"))


def _strata(counts: DataFrame, dossiers: DataFrame, types: DataFrame, n_strata: int, by=()) -> DataFrame:
    """by, type_a, type_b, dossier, a, b, stratum: dossiers ranked by how many other types they hold, in strata of equal size.

    Each dossier is there once for each pair, which stratification by pair needs; presence comes in as a set of types, one row a dossier.
    """
    have = dossiers.select(*by, "dossier").join(counts.groupBy(*by, "dossier").agg(F.collect_set("type").alias("has")), [*by, "dossier"], "left")
    have = have.withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    rows = have.crossJoin(F.broadcast(type_pairs(types)))
    rows = rows.withColumns({"a": F.array_contains("has", F.col("type_a")), "b": F.array_contains("has", F.col("type_b"))})
    rest = F.size("has") - F.col("a").cast("int") - F.col("b").cast("int")
    # Numbered in ranges, so that a pair's dossiers are several tasks'; then the same parts as ntile makes: the first of them one larger where they aren't equal.
    ranked = numbered(rows.withColumn("_rest", rest), ["_rest", "dossier"], "_i", (*by, "type_a", "type_b"))
    n = dossiers.groupBy(*by).agg(F.count_distinct("dossier").alias("_n"))
    ranked = ranked.join(F.broadcast(n), list(by)) if by else ranked.crossJoin(F.broadcast(n))  # a row, or one for each draw
    i, size, more = F.col("_i"), F.floor(F.col("_n") / n_strata), F.col("_n") % n_strata
    stratum = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return ranked.select(*by, "type_a", "type_b", "dossier", "a", "b", stratum.cast("int").alias("stratum"))


def stratum_counts(counts: DataFrame, dossiers: DataFrame, types: DataFrame, n_strata: int, by=()) -> DataFrame:
    """by, type_a, type_b, stratum, n11, n10, n01, n00 over the strata of ``_strata``, without a row for each dossier and pair.

    Dossiers are dealt out once by ranges of their order and counted by their set of types in each. A pair's buckets (how many other types, range) lie in one stratum as a whole but for the few that a
    border cuts; only the dossiers of these are numbered.
    """
    have = dossiers.select(*by, "dossier").join(counts.groupBy(*by, "dossier").agg(F.array_sort(F.collect_set("type")).alias("has")), [*by, "dossier"], "left")
    have = have.withColumn("has", F.coalesce("has", F.array().cast("array<string>")))
    n = int(dossiers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written down once: the ranges of a second evaluation could differ.
    placed = saved(have.repartitionByRange(n, *by, "dossier").withColumn("_block", F.spark_partition_id()))
    pairs, pair = F.broadcast(type_pairs(types)), [*by, "type_a", "type_b"]

    def flagged(df):
        df = df.withColumns({"a": F.array_contains("has", F.col("type_a")), "b": F.array_contains("has", F.col("type_b"))})
        return df.withColumn("_rest", F.size("has") - F.col("a").cast("int") - F.col("b").cast("int"))

    flag = lambda a, b: F.coalesce(F.sum(F.when((F.col("a") == a) & (F.col("b") == b), F.col("_k"))), F.lit(0))
    four = lambda: [flag(True, True).alias("n11"), flag(True, False).alias("n10"), flag(False, True).alias("n01"), flag(False, False).alias("n00"), F.sum("_k").alias("n")]
    sets = placed.groupBy(*by, "has", "_block").agg(F.count(F.lit(1)).alias("_k"))
    bucket = flagged(sets.crossJoin(pairs)).groupBy(*pair, "_rest", "_block").agg(*four())
    w = Window.partitionBy(*pair)  # buckets of a pair
    bucket = bucket.withColumns({"_from": F.coalesce(F.sum("n").over(w.orderBy("_rest", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("n").over(w)})

    def stratum(i):
        size, more = F.floor(F.col("_n") / n_strata), F.col("_n") % n_strata
        return (F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1).cast("int")

    bucket = saved(bucket.withColumns({"stratum": stratum(F.col("_from")), "_last": stratum(F.col("_from") + F.col("n") - 1)}))
    whole = bucket.filter("stratum = _last").select(*pair, "stratum", "n11", "n10", "n01", "n00", "n")
    cut = bucket.filter("stratum <> _last").select(*pair, F.col("_rest").alias("_r"), "_block", "_from", "_n")
    met = flagged(placed.join(cut, [*by, "_block"])).filter("_rest = _r")
    own = F.row_number().over(Window.partitionBy(*pair, "_rest", "_block").orderBy("dossier")) - 1  # a range's dossiers
    parts = met.withColumns({"stratum": stratum(F.col("_from") + own), "_k": F.lit(1).cast("long")}).groupBy(*pair, "stratum").agg(*four())
    return whole.unionByName(parts).groupBy(*pair, "stratum").agg(*[F.sum(c).alias(c) for c in ("n11", "n10", "n01", "n00", "n")])


def presence_tables(counts: DataFrame, dossiers: DataFrame, types: DataFrame, by=()) -> DataFrame:
    """n11, n10, n01, n00 of each pair of types. Only co-present types are joined; the rest follows from how often each is present."""
    n = dossiers.groupBy(*by).agg(F.count_distinct("dossier").alias("_d"))
    alone = counts.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("k"))
    left = counts.select(*by, "dossier", F.col("type").alias("type_a"))
    right = counts.select(*by, "dossier", F.col("type").alias("type_b"))
    met = left.join(right, [*by, "dossier"]).filter("type_a < type_b").groupBy(*by, "type_a", "type_b").agg(F.count(F.lit(1)).alias("n11"))
    out = n.crossJoin(F.broadcast(type_pairs(types))).join(met, [*by, "type_a", "type_b"], "left")
    for side in ("a", "b"):
        out = out.join(alone.select(*by, F.col("type").alias(f"type_{side}"), F.col("k").alias(f"k{side}")), [*by, f"type_{side}"], "left")
    out = out.na.fill(0, ["n11", "ka", "kb"])
    return out.select(*by, "type_a", "type_b", "n11", (F.col("ka") - F.col("n11")).alias("n10"), (F.col("kb") - F.col("n11")).alias("n01"), (F.col("_d") - F.col("ka") - F.col("kb") + F.col("n11")).alias("n00"))


def mantel_haenszel(counts: DataFrame, dossiers: DataFrame, types: DataFrame, n_strata: int = 4, by=()) -> DataFrame:
    """log_or, var_log_or of each pair of types, stratified by how many other types a dossier holds; null where a sum vanishes."""
    per = stratum_counts(counts, dossiers, types, n_strata, by)
    n = F.col("n")
    r, s = F.col("n11") * F.col("n00") / n, F.col("n10") * F.col("n01") / n
    p, q = (F.col("n11") + F.col("n00")) / n, (F.col("n10") + F.col("n01")) / n
    sums = per.groupBy(*by, "type_a", "type_b").agg(
        F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("mixed"), F.sum(q * s).alias("qs"))
    ok = (F.col("r") > 0) & (F.col("s") > 0)
    var = F.col("pr") / (2 * F.col("r") * F.col("r")) + F.col("mixed") / (2 * F.col("r") * F.col("s")) + F.col("qs") / (2 * F.col("s") * F.col("s"))
    return sums.select(*by, "type_a", "type_b", F.when(ok, F.log(F.col("r") / F.col("s"))).alias("log_or"), F.when(ok, var).alias("var_log_or"))


def log_odds_posterior(tables: DataFrame) -> DataFrame:
    """log_or_mean, log_or_var of the log odds ratio under a flat Dirichlet prior, in closed form (digamma and trigamma of the counts plus one)."""
    tables = tables.withColumns({c: F.col(c) + F.lit(1.0) for c in ("n11", "n10", "n01", "n00")})
    return tables.select("type_a", "type_b", (digamma("n11") + digamma("n00") - digamma("n10") - digamma("n01")).alias("log_or_mean"),
                         sum((trigamma(c) for c in ("n11", "n10", "n01", "n00")), F.lit(0.0)).alias("log_or_var"))


def digamma(c: str):
    """Of values of at least 1: raised by six steps, then the asymptotic series."""
    x = F.col(c)
    y = x + 6
    steps = sum((1 / (x + k) for k in range(6)), F.lit(0.0))
    z = 1 / (y * y)
    return F.log(y) - 0.5 / y - z * (F.lit(1 / 12) - z * (F.lit(1 / 120) - z * (F.lit(1 / 252) - z * (F.lit(1 / 240) - z / 132)))) - steps


def trigamma(c: str):
    x = F.col(c)
    y = x + 6
    steps = sum((1 / ((x + k) * (x + k)) for k in range(6)), F.lit(0.0))
    z = 1 / (y * y)
    return steps + 1 / y + z / 2 + (z / y) * (F.lit(1 / 6) - z * (F.lit(1 / 30) - z * (F.lit(1 / 42) - z * (F.lit(1 / 30) - z * 5 / 66))))


def pair_draws(estimates: DataFrame, n_draws: int, seed: str, by=()) -> DataFrame:
    """type_a, type_b, x: normal draws with each estimate's mean and variance; estimates without either give none."""
    from quire.functions.hashing import box_muller, uniform

    rows = estimates.filter("log_or is not null and var_log_or > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    key = [F.lit(seed), *[F.col(c) for c in by], "type_a", "type_b", "i"]
    z = box_muller(uniform(*key, F.lit("a")), uniform(*key, F.lit("b")))
    return rows.select("type_a", "type_b", (F.col("log_or") + F.sqrt("var_log_or") * z).alias("x"))


def summarised(draws: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mean, hdi_3, hdi_97 (percentiles, interpolated), p_positive of the values that aren't null or NaN, and credible flags."""
    x = F.when(~F.isnan(value), F.col(value))
    out = with_percentiles(draws.groupBy(*by).agg(F.avg(x).alias("mean"), F.avg((F.coalesce(x > 0, F.lit(False))).cast("double")).alias("p_positive")), draws, list(by), value, HDI)
    return out.withColumns({"credible": (F.col("p_positive") > 0.975) | (F.col("p_positive") < 0.025), "excludes_zero": F.coalesce((F.col("hdi_3") > 0) | (F.col("hdi_97") < 0), F.lit(False))})


def runs(segs: DataFrame, by=()) -> DataFrame:
    """dossier, type, k (segments), runs (unbroken rows of them), length (segments of the dossier)."""
    w = Window.partitionBy(*by, "dossier").orderBy("order_in_dossier")
    marked = segs.withColumns({"_first": ~F.coalesce(F.lag("type").over(w).eqNullSafe(F.col("type")) & (F.row_number().over(w) > 1), F.lit(False)), "_len": F.count(F.lit(1)).over(Window.partitionBy(*by, "dossier"))})
    return marked.groupBy(*by, "dossier", "type").agg(F.count(F.lit(1)).alias("k"), F.count_if("_first").alias("runs"), F.first("_len").alias("length"))


def dispersion(run_counts: DataFrame, by=(), low_support: int = 15) -> DataFrame:
    """Of each type with at least two segments in a dossier: n_qualifying, mean_contiguity, and two z scores of its number of runs.

    z_score takes the moments of the number of runs of both kinds, as published figures do; they belong to another count, and the score is
    strongly negative by that alone. z_score_type_runs has the moments of the runs of the type itself.
    """
    k, n, x = F.col("k").cast("double"), F.col("length").cast("double"), F.col("runs").cast("double")
    total_mean = 1 + 2 * k * (n - k) / n
    total_var = F.when(n > 1, F.greatest(F.lit(0.0), 2 * k * (n - k) * (2 * k * (n - k) - n) / (n * n * (n - 1)))).otherwise(0.0)
    own_mean = k * (n - k + 1) / n
    own_var = F.when(n > 1, k * (k - 1) * (n - k) * (n - k + 1) / (n * n * (n - 1))).otherwise(0.0)
    rows = run_counts.filter("k >= 2").groupBy(*by, "type").agg(
        F.count(F.lit(1)).alias("n_qualifying"), F.avg((x - 1) / (k - 1)).alias("mean_contiguity"),
        F.sum(x - total_mean).alias("d1"), F.sum(total_var).alias("v1"), F.sum(x - own_mean).alias("d2"), F.sum(own_var).alias("v2"))
    z = lambda i: F.when(F.col(f"v{i}") > 0, F.col(f"d{i}") / F.sqrt(f"v{i}"))
    return rows.select(*by, "type", z(1).alias("z_score"), z(2).alias("z_score_type_runs"), "mean_contiguity", "n_qualifying", (F.col("n_qualifying") < low_support).alias("low_support"))


def positions(segs: DataFrame, by=()) -> DataFrame:
    """n, mean, sd, se_mean, se_sd of the place of each type in its dossier (0 to 1); null below two segments."""
    out = segs.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"), F.avg("norm_position").alias("mean"), F.stddev_samp("norm_position").alias("sd"))
    ok, n = F.col("n") >= 2, F.col("n")
    return out.select(*by, "type", "n", F.when(ok, F.col("mean")).alias("mean"), F.when(ok, F.col("sd")).alias("sd"), F.when(ok, F.col("sd") / F.sqrt(n)).alias("se_mean"), F.when(ok, F.col("sd") / F.sqrt(2 * (n - 1))).alias("se_sd"))


def first_occurrences(segs: DataFrame, by=()) -> DataFrame:
    return segs.groupBy(*by, "dossier", "type").agg(F.min("order_in_dossier").alias("first"))


def first_wins(firsts: DataFrame, types: DataFrame, by=()) -> DataFrame:
    """a_first, b_first of each pair of types: in how many dossiers that hold both which comes first."""
    a = firsts.select(*by, "dossier", F.col("type").alias("type_a"), F.col("first").alias("fa"))
    b = firsts.select(*by, "dossier", F.col("type").alias("type_b"), F.col("first").alias("fb"))
    won = a.join(b, [*by, "dossier"]).filter("type_a < type_b").groupBy(*by, "type_a", "type_b").agg(F.count_if(F.col("fa") < F.col("fb")).alias("a_first"), F.count_if(~(F.col("fa") < F.col("fb"))).alias("b_first"))
    if by:
        return won
    return type_pairs(types).join(won, ["type_a", "type_b"], "left").na.fill(0, ["a_first", "b_first"])


def richness(segs: DataFrame) -> DataFrame:
    """min, max, mean of the number of types of a dossier."""
    return segs.groupBy("dossier").agg(F.count_distinct("type").alias("r")).agg(F.min("r").alias("min_richness"), F.max("r").alias("max_richness"), F.avg("r").alias("mean_richness"))
