import math

import numpy as np
import pandas as pd
import pytest

from quire.operators import size_models as S


def dossiers(spark, n=3000, slope=0.0, family="negative_binomial"):
    rng = np.random.default_rng(5)
    year = rng.integers(1950, 1962, n)
    adults, minors = rng.integers(1, 4, n), rng.integers(0, 3, n)
    mu = np.exp(0.7 + 0.25 * adults + 0.1 * minors + slope * (year - 1956))
    docs = rng.negative_binomial(4, 4 / (4 + mu))
    persons = adults + minors
    rows = pd.DataFrame({"travel_year": year, "era": (year >= 1956).astype(int), "year_c": year - 1956, "num_adults": adults, "num_minors": minors, "num_persons": persons,
                         "num_docs": docs, "heads": rng.binomial(persons, rng.beta(6, 4, n)), "minor_lt16": minors, "preadult_16_17": np.minimum(adults, 1), "adult_18plus": adults - np.minimum(adults, 1)})
    return spark.createDataFrame(rows)


def test_special_functions():
    x = np.array([1e-3, 0.5, 1, 3.25, 40, 1e5])
    assert np.allclose(S.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    assert np.allclose(S.digamma(x), (S.log_gamma(x * (1 + 1e-6)) - S.log_gamma(x * (1 - 1e-6))) / (2e-6 * x), rtol=1e-4)


@pytest.mark.parametrize("family", ["negative_binomial", "truncated", "binomial", "beta_binomial"])
def test_slopes_are_derivatives(family):
    m = S.Model("m", "y", family=family, trials="t")
    eta, la, n, total, trials = np.array([0.3, -1.2]), np.array([0.4, 1.5]), np.array([3.0, 1.0]), np.array([2.0, 4.0]), np.array([5.0, 6.0])
    e = 1e-6
    _, de, dl = S._slopes(m, eta, la, n, total, trials)
    for got, (i, j) in ((de, (e, 0)), (dl, (0, e))):
        up, down = S._slopes(m, eta + i, la + j, n, total, trials)[0], S._slopes(m, eta - i, la - j, n, total, trials)[0]
        assert np.allclose(got, (up - down) / (2 * e), atol=1e-5)


def test_likelihood_from_aggregates_is_that_of_the_rows():
    """Cells and counts give the sum of the textbook's probabilities."""
    rng = np.random.default_rng(0)
    y, mu, a = rng.integers(0, 9, 50), 2.5, 1.7
    m = S.Model("m", "y")
    la = np.array([math.log(a)])
    value = S._slopes(m, np.array([math.log(mu)]), la, np.array([50.0]), np.array([float(y.sum())]), np.zeros(1))[0].sum()
    values, n = np.unique(y, return_counts=True)
    value += S._count_part(np.full(len(values), la[0]), values, n)[0].sum()
    plain = sum(math.lgamma(v + a) - math.lgamma(a) - math.lgamma(v + 1) + a * math.log(a / (a + mu)) + v * math.log(mu / (a + mu)) for v in y)
    assert abs(value - plain) < 1e-8
    assert abs(sum(S.log_likelihood(m, np.log([mu]), la, np.array([float(v)]), np.zeros(1))[0] for v in y) - plain) < 1e-8


def test_probabilities_sum_to_one():
    k = np.arange(8.0)
    for family in ("binomial", "beta_binomial"):
        m = S.Model("m", "y", family=family, trials="t")
        assert abs(np.exp(S.log_likelihood(m, np.full(8, 0.4), np.full(8, 0.9), k, np.full(8, 7.0))).sum() - 1) < 1e-9


def test_negative_binomial_recovers(spark):
    f = S.fitted(dossiers(spark), S.by_persons()[2])
    got = dict(zip(f.names(), f.theta))
    sd = dict(zip(f.names(), np.sqrt(np.diag(f.cov))))
    for name, true in (("adult", 0.25), ("minor", 0.1), ("log_dispersion", math.log(4))):
        assert abs(got[name] - true) < 4 * sd[name] and 0 < sd[name] < 0.2
    assert f.year_sd < 0.15


def test_trend_is_found(spark):
    rows = dossiers(spark, slope=0.12)
    winner, table = S.temporal_search(rows, covariates={"adult": "num_adults", "minor": "num_minors"})
    t = {(r["stage"], r["model"]): r for r in table.collect()}
    assert len(t) == 7 and t["mean", "mean_trend"]["elpd"] > t["mean", "mean_step"]["elpd"] - 1
    assert all(r["n"] == 3000 and r["elpd_diff"] >= 0 and (r["rank"] > 0) == (r["dse"] > 0) for r in t.values())
    f = S.fitted(rows, S.over_time("num_docs", {"adult": "num_adults", "minor": "num_minors"})[1])
    assert abs(dict(zip(f.names(), f.theta))["mean_trend"] - 0.12) < 0.03
    curve = S.yearly_curve(spark, f, 1956, {"num_adults": 2, "num_minors": 1}).orderBy("travel_year").collect()
    assert len(curve) == 12 and all(r["mu_hdi_3"] <= r["mu_mean"] <= r["mu_hdi_97"] for r in curve) and curve[-1]["mu_mean"] > 2 * curve[0]["mu_mean"]
    assert abs(curve[6]["mu_mean"] - math.exp(0.7 + 0.5 + 0.1)) < 0.5


def test_extra_binomial_dispersion_is_found(spark):
    rows = dossiers(spark)
    plain, wide = (S.fitted(rows, S.Model(f, "heads", {}, "constant", f, "num_persons")) for f in ("binomial", "beta_binomial"))
    top = S.compared(rows, [plain, wide]).orderBy("rank").collect()
    assert [r["model"] for r in top] == ["beta_binomial", "binomial"] and top[1]["elpd_diff"] > 3 * top[1]["dse"]
    got = dict(zip(wide.names(), wide.theta))
    assert abs(1 / (1 + math.exp(-got["intercept"])) - 0.6) < 0.04 and abs(got["log_dispersion"] - math.log(10)) < 0.5


def test_elpd_is_near_the_plain_sum(spark):
    """The one-pass comparison against rows one by one."""
    rows = dossiers(spark, 400)
    fits = [S.fitted(rows, m) for m in S.by_age_groups()[:2]]
    got = {r["model"]: r for r in S.compared(rows, fits, 50).collect()}
    pdf = rows.toPandas()
    for f in fits:
        d = f.draws(50)
        mean, disp = f.matrices(pdf["travel_year"], [pdf.eval(e) for e in f.model.terms.values()], [])
        ll = S.log_likelihood(f.model, mean @ d[:, :f.n_mean].T, disp @ d[:, f.n_mean:].T, pdf["num_docs"].to_numpy(float)[:, None], np.zeros((len(pdf), 1)))
        e = np.log(np.exp(ll).mean(1)) - ll.var(1, ddof=1)
        assert abs(got[f.model.name]["elpd"] - e.sum()) < 1e-6 and abs(got[f.model.name]["se"] - e.std() * math.sqrt(len(e))) < 1e-6


def test_odd_rows(spark):
    rows = dossiers(spark, 200).selectExpr("*", "CASE WHEN num_adults = 1 THEN NULL ELSE num_docs END AS some", "num_docs + 0.25 AS expected")
    f = S.fitted(rows, S.Model("m", "some", {"adult": "num_adults"}))
    assert S.compared(rows, [f], 20).first()["n"] == rows.filter("some IS NOT NULL").count()
    assert np.isfinite(S.fitted(rows, S.Model("m", "expected", {}, "iid")).theta).all()
    with pytest.raises(ValueError):
        S.fitted(rows.limit(0), S.Model("m", "num_docs"))


def test_reduced_rows_give_the_same_fit(spark):
    rows = dossiers(spark, 500)
    model = S.by_persons()[3]
    less = S.reduced(rows, ["era", "num_adults", "num_minors", "num_docs"])
    assert less.count() < 500
    a, b = S.fitted(rows, model), S.fitted(less, model)
    assert np.allclose(a.theta, b.theta, atol=1e-6) and np.allclose(a.cov, b.cov, atol=1e-6)
    a, b = (S.compared(x, [f], 20).first() for x, f in ((rows, a), (less, a)))
    assert a["n"] == b["n"] == 500 and abs(a["elpd"] - b["elpd"]) < 1e-6


def test_fits_side_by_side_are_those_one_by_one(spark):
    df = dossiers(spark, 1200)
    plain = S.by_persons()[2]
    models = [plain, S.by_persons()[3], *S.with_dispersions(S.Model("x", "num_docs", plain.terms))[1:], S.Model("share", "heads", {"trend": "year_c"}, family="beta_binomial", trials="num_persons"),
              S.Model("odds", "heads", family="binomial", trials="num_persons"), S.Model("some", "num_docs", plain.terms, family="truncated")]
    for m, f in zip(models, S.fit_all(df, models)):
        one = S.fitted(df, m)
        assert f.model == m and f.years == one.years and np.allclose(f.theta, one.theta, atol=1e-5) and np.allclose(f.cov, one.cov, atol=1e-5) and np.isclose(f.year_sd, one.year_sd, atol=1e-5)
        assert (f.dispersion_year_sd is None) == (one.dispersion_year_sd is None)
    with pytest.raises(ValueError):
        S.fit_all(df.filter("false"), models)
    with pytest.raises(ValueError):
        S.fit_all(df, [plain, plain])


def test_many_counts_close_to_poisson_have_a_mode():
    """Their dispersion is large, where differences of log gammas lose their digits: the curvature wasn't positive."""
    years = np.arange(1992, 1999)
    cells = pd.DataFrame({"travel_year": years, "disp_trend": years - 1995.0, "n": 130_000, "total": 390_000.0, "trials": 0.0})
    counts = pd.DataFrame([(t - 1995.0, y, 26_000) for t in years for y in range(1, 6)], columns=["disp_trend", "y", "n"])
    fit = S.fitted_cells(S.Model("m", "y", {}, "trend"), cells, counts)
    assert np.linalg.eigvalsh(fit.cov).min() > 0 and np.isfinite(fit.draws(5)).all()
    value, slope = S._rising(np.array([0.5, 1e12]), np.array([3.0, 3.0]))
    assert value[0] == pytest.approx(math.log(0.5 * 1.5 * 2.5 / 0.125)) and value[1] == pytest.approx(3e-12, rel=0.01) and slope[1] == pytest.approx(-3e-12, rel=0.5)
