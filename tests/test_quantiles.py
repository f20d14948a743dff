import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import composition as C
from quire.operators.quantiles import percentiles

SHARES = {"low": 0.03, "mid": 0.5, "high": 0.97, "first": 0.0, "last": 1.0}


@pytest.mark.parametrize("small, left", [(1_000_000, 100), (100, 50), (100, 3)])
def test_percentiles_are_exact(spark, small, left):
    rng = np.random.default_rng(0)
    groups = {"even": rng.normal(size=5000), "tied": rng.integers(0, 4, 4000).astype(float), "one": np.full(500, 7.0), "skewed": rng.pareto(0.5, 3000), "few": np.array([3.0, 1.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("even", None), ("none", None), ("even", float("nan")), (None, 5.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", SHARES, small, left).collect()}
    assert set(got) == {*groups, "none", None} and got["none"]["mid"] is None and got[None]["mid"] == 7.0
    for g, x in groups.items():
        for c, p in SHARES.items():
            assert np.isclose(got[g][c], np.quantile(x, p), rtol=1e-12, atol=1e-12), (g, c)


def test_without_groups(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    r = percentiles(df, [], F.col("v") * 2, {"a": 0.25, "b": 0.95}, small=10, left=10).first()
    assert (r["a"], r["b"]) == (5000.0, 19000.0)
    assert percentiles(df.filter("false"), ["v"], "v", {"a": 0.5}).count() == 0


@pytest.mark.parametrize("n, n_strata, by", [(701, 4, ()), (300, 3, ("draw",)), (5, 4, ()), (64, 4, ())])
def test_strata_counted_in_ranges(spark, n, n_strata, by):
    rng = np.random.default_rng(n)
    types = spark.createDataFrame([(t,) for t in "abcd"], "type string")
    rows = [(k, f"d{i:04d}", t, 1) for k in range(2 if by else 1) for i in range(n) for t in "abcd" if rng.random() < 0.45]
    counts = spark.createDataFrame(rows, "draw int, dossier string, type string, n int").cache()
    dossiers = spark.range(n).select(F.format_string("d%04d", "id").alias("dossier")).crossJoin(counts.select("draw").distinct())
    if not by:
        counts, dossiers = counts.drop("draw"), dossiers.drop("draw")
    keys = [*by, "type_a", "type_b", "stratum"]
    a, b = F.col("a"), F.col("b")
    want = C._strata(counts, dossiers, types, n_strata, by).groupBy(*keys).agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"), F.count(F.lit(1)).alias("n"))
    got = C.stratum_counts(counts, dossiers, types, n_strata, by).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
