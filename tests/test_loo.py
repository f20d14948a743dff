import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import loo as L
from quire.operators import size_models as S
from tests.test_size_models import dossiers

MODELS = [S.by_persons()[0], S.by_persons()[2]]


def plain_pareto(x):
    """The same estimate for one sorted sample, by loops."""
    n, m = len(x), 30 + int(math.sqrt(len(x)))
    quarter = x[max(0, int(n / 4 + 0.5) - 1)]
    rates = [(1 - math.sqrt(m / (j - 0.5))) / (3 * quarter) + 1 / x[-1] for j in range(1, m + 1)]
    fits = []
    for b in rates:
        k = sum(math.log1p(-b * v) for v in x) / n
        fits.append(n * (math.log(-b / k) - k - 1))
    weights = [1 / sum(math.exp(min(700, f - g)) for f in fits) for g in fits]
    best = sum(b * w for b, w in zip(rates, weights)) / sum(weights)
    k = sum(math.log1p(-best * v) for v in x) / n
    return (n * k + 5) / (n + 10), -k / best


def test_pareto_fit():
    rng = np.random.default_rng(1)
    for shape in (0.2, 0.7, 1.2):
        x = np.sort((rng.random((20, 400)) ** -shape - 1) / shape * 2, axis=1)
        k, sigma = L.pareto_fit(x)
        assert abs(k.mean() - shape) < 0.1 and abs(sigma.mean() - 2) < 0.3
        assert np.allclose([k[0], sigma[0]], plain_pareto(x[0].tolist()))


def test_weights_are_smoothed_in_the_tail_only():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4, 1000))
    x[3] = 0.0
    w, k = L.smoothed_weights(x)
    assert np.allclose(np.exp(w).sum(1), 1) and np.isinf(k[3]) and np.allclose(w[3], -math.log(1000)) and (k[:3] < 0.7).all()
    tail = math.ceil(3 * math.sqrt(1000))
    for i in range(3):
        order = np.argsort(x[i])
        body, ends = order[:-tail], order[-tail:]
        assert np.allclose(np.diff(w[i][body] - x[i][body]), 0) and (np.diff(w[i][ends]) >= 0).all()
    few, k = L.smoothed_weights(x[:, :20])
    assert np.isinf(k).all() and np.allclose(few - x[:, :20], (few - x[:, :20])[:, :1])


@pytest.fixture(scope="module")
def case(spark):
    df = dossiers(spark, 1500)
    return df, [S.fitted(df, m) for m in MODELS]


def test_pointwise_against_rows_one_by_one(case):
    df, fits = case
    got = L.pointwise(df, fits, 400)
    rows = got.collect()
    assert sum(r["_rows"] for r in rows) == 1500
    d = df.toPandas()
    plain, k_plain, waic = [], [], []
    for _, r in d.drop_duplicates(["travel_year", "num_persons", "num_adults", "num_minors", "num_docs"]).head(40).iterrows():
        for f, terms in zip(fits, (["num_persons"], ["num_adults", "num_minors"])):
            x = np.array([1.0, *[r[t] for t in terms], *[float(r["travel_year"] == y) for y in f.years]])
            draws = f.draws(400)
            mu, a = np.exp(draws[:, : f.n_mean] @ x), np.exp(draws[:, f.n_mean])
            y = r["num_docs"]
            ll = np.array([math.lgamma(y + v) - math.lgamma(v) - math.lgamma(y + 1) + v * math.log(v / (v + m)) + y * math.log(m / (v + m)) for m, v in zip(mu, a)])
            w, k = L.smoothed_weights(-ll[None, :])
            plain.append(math.log((np.exp(w[0]) * np.exp(ll)).sum()))
            waic.append(math.log(np.exp(ll).mean()) - ll.var(ddof=1))
            k_plain.append(k[0])
    found = np.array([x for r in rows for x in r["elpd"]])
    assert all(np.abs(found - x).min() < 1e-9 for x in plain)
    assert max(abs(a - b) for a, b, k in zip(plain, waic, k_plain) if k < 0.5) < 0.02


def test_comparison_agrees_with_numpy(case):
    df, fits = case
    points = L.pointwise(df, fits, 400).cache()
    r = points.toPandas()
    w, e = r["_rows"].to_numpy(float), np.stack(r["elpd"])
    got = {x["model"]: x for x in L.loo_compared(points, [m.name for m in MODELS]).collect()}
    assert got["B"]["rank"] == 0 and got["A"]["rank"] == 1 and got["B"]["dse"] == 0 and not got["B"]["warning"]
    total = w @ e
    d = e[:, 1] - e[:, 0]
    assert np.isclose(got["A"]["elpd_loo"], total[0]) and np.isclose(got["A"]["elpd_diff"], w @ d)
    assert np.isclose(got["A"]["dse"], math.sqrt(w @ d**2 - (w @ d) ** 2 / w.sum())) and np.isclose(got["B"]["se"], math.sqrt(w @ e[:, 1] ** 2 - total[1] ** 2 / w.sum()))
    assert got["A"]["n"] == 1500 and 0 < got["B"]["p_loo"] < 30 and abs(got["B"]["waic"] - got["B"]["elpd_loo"]) < 1
    k = np.stack(r["k"])
    assert got["A"]["n_fair"] == int(w @ ((k[:, 0] > 0.5) & (k[:, 0] <= 0.7))) and np.isclose(got["A"]["max_k"], k[:, 0].max())


def test_groups_are_compared_each_by_itself(case):
    df, fits = case
    points = L.pointwise(df.withColumn("period", F.when(F.col("era") == 1, "post").otherwise("pre")), fits, 200, ["period"])
    whole = {r["model"]: r for r in L.loo_compared(points, ["A", "B"]).collect()}
    parts = L.loo_compared(points, ["A", "B"], ["period"]).collect()
    assert len(parts) == 4 and sorted(r["rank"] for r in parts) == [0, 0, 1, 1]
    for m in ("A", "B"):
        assert np.isclose(sum(r["elpd_loo"] for r in parts if r["model"] == m), whole[m]["elpd_loo"]) and sum(r["n"] for r in parts if r["model"] == m) == 1500


def test_stacking_maximises_the_log_score(spark):
    rng = np.random.default_rng(3)
    e = np.log(rng.random((300, 3)) + [0.2, 0.25, 0.01])
    points = spark.createDataFrame([(int(n), [float(v) for v in r]) for n, r in zip(rng.integers(1, 4, 300), e)], "_rows long, elpd array<double>").cache()
    got = np.array([w for _, w in L.stacking_weights(points, ["a", "b", "c"])])
    rows = points.toPandas()
    n, p = rows["_rows"].to_numpy(float), np.exp(np.stack(rows["elpd"]))
    score = lambda w: float(n @ np.log(p @ w))
    grid = [np.array([i, j, 100 - i - j]) / 100 for i in range(101) for j in range(101 - i)]
    assert abs(got.sum() - 1) < 1e-9 and (got >= 0).all() and score(got) >= max(map(score, grid)) - 1e-6


def test_folds_agree_with_leaving_one_out(case):
    df, fits = case
    df = df.withColumn("id", F.monotonically_increasing_id())
    loo = {r["model"]: r for r in L.loo_compared(L.pointwise(df, fits, 400), ["A", "B"]).collect()}
    folds = {r["model"]: r for r in L.k_folds(df, MODELS, ["id"], 5, 300).collect()}
    for m in ("A", "B"):
        assert folds[m]["n"] == 1500 and abs(folds[m]["elpd"] - loo[m]["elpd_loo"]) < 6 and abs(folds[m]["se"] - loo[m]["se"]) < 3
    assert folds["B"]["elpd"] > folds["A"]["elpd"]


def test_a_fold_is_left_out(spark):
    """Against a fit to the other rows."""
    df = dossiers(spark, 400).withColumn("id", F.monotonically_increasing_id()).cache()
    fold = F.pmod(F.xxhash64("id"), F.lit(2))
    want = 0.0
    for i in range(2):
        f = S.fitted(df.filter(fold != i), MODELS[0])
        rows, at = S.designed(df.filter(fold == i), MODELS[:1])
        rows = rows.toPandas()
        f, d = L._with_years(f, f.draws(300), rows["travel_year"].tolist())
        ll = S.likelihoods(f, d, rows, at)
        want += float(np.log(np.exp(ll).mean(1)).sum())
    got = L.k_folds(df, MODELS[:1], ["id"], 2, 300).first()
    assert abs(got["elpd"] - want) < 1e-3
