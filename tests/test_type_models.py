import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import size_models as S
from quire.operators import type_models as T

TERMS = {"adult": "num_adults", "minor": "num_minors"}


def planted(n=4000, kinds=6, seed=3, zeros=0.0):
    """Dossiers, and counts of types with known slopes; the last type is rare."""
    rng = np.random.default_rng(seed)
    meta = pd.DataFrame({"dossier": np.arange(n), "travel_year": rng.integers(1950, 1958, n), "num_adults": rng.integers(0, 4, n), "num_minors": rng.integers(0, 4, n)})
    meta["preadult_16_17"] = np.minimum(meta["num_minors"], 2)
    slopes = rng.normal([0.3, -0.1], [0.15, 0.1], (kinds, 2))
    level = np.append(rng.normal(-0.4, 0.4, kinds - 1), -5.5)
    rows = []
    for k in range(kinds):
        mu = np.exp(level[k] + slopes[k, 0] * meta["num_adults"] + slopes[k, 1] * meta["num_minors"])
        y = rng.negative_binomial(3, 3 / (3 + mu)) * (rng.random(n) >= zeros)
        rows.append(pd.DataFrame({"dossier": meta["dossier"], "type": f"t{k}", "n": y})[y > 0])
    return meta, pd.concat(rows), slopes


@pytest.fixture(scope="module")
def case(spark):
    meta, counts, slopes = planted()
    return spark.createDataFrame(meta), spark.createDataFrame(counts), slopes, meta, counts


def dense(meta, counts):
    kinds = sorted(counts["type"].unique())
    every = meta.merge(pd.DataFrame({"type": kinds}), how="cross").merge(counts, on=["dossier", "type"], how="left")
    return every.fillna({"n": 0})


@pytest.mark.parametrize("part", ["negative_binomial", "binomial", "truncated"])
def test_cells_are_those_of_all_dossiers_and_types(case, part):
    meta, counts, _, pm, pc = case
    d = dense(pm, pc)
    d = d[d["n"] > 0] if part == "truncated" else d
    d["y"] = (d["n"] > 0).astype(float) if part == "binomial" else d["n"]
    keys = ["type", "travel_year", "num_adults", "num_minors"]
    want = d.groupby(keys)["y"].agg(["size", "sum"])
    got = T.type_cells(meta, counts, TERMS, part=part).toPandas()
    cells = got[got["y"].isna()].set_index(["type", "travel_year", "adult", "minor"])
    assert len(cells) == len(want)
    for k, r in want.iterrows():
        assert cells.loc[k, "n"] == r["size"] and cells.loc[k, "total"] == r["sum"]
    h = got[got["y"].notna()]
    if part == "binomial":
        assert h.empty
    else:
        assert {(t, y): n for t, y, n in zip(h["type"], h["y"], h["n"])} == d.groupby(["type", "y"]).size().to_dict()


def test_cells_by_draw_and_period(spark):
    meta = spark.createDataFrame([(1, "all", 1950, 1), (1, "pre", 1950, 1), (2, "all", 1960, 2), (3, "all", None, 1), (None, "all", 1950, 1)], "dossier long, period string, travel_year int, x int")
    counts = spark.createDataFrame([(1, 0, "a", 2), (2, 0, "a", 1), (1, 1, "b", 4), (9, 1, "a", 5), (3, 0, "a", 7), (None, 0, "a", 1)], "dossier long, draw int, type string, n long")
    rows = T.type_cells(meta, counts, {"x": "x"}, ["draw"], ["period"]).collect()
    cells = {(r.period, r.draw, r.type, r.travel_year): (r.n, r.total) for r in rows if r.y is None}
    assert cells == {("all", 0, "a", 1950): (1, 2.0), ("all", 0, "a", 1960): (1, 1.0), ("pre", 0, "a", 1950): (1, 2.0), ("all", 1, "a", 1950): (1, 0.0), ("all", 1, "a", 1960): (1, 0.0), ("pre", 1, "a", 1950): (1, 0.0),
                     ("all", 1, "b", 1950): (1, 4.0), ("all", 1, "b", 1960): (1, 0.0), ("pre", 1, "b", 1950): (1, 4.0)}
    outcome = {(r.period, r.draw, r.type, r.y): r.n for r in rows if r.y is not None}
    assert outcome == {("all", 0, "a", 2.0): 1, ("all", 0, "a", 1.0): 1, ("pre", 0, "a", 2.0): 1, ("all", 1, "a", 0.0): 2, ("pre", 1, "a", 0.0): 1, ("all", 1, "b", 4.0): 1, ("all", 1, "b", 0.0): 1, ("pre", 1, "b", 4.0): 1}
    assert T.type_cells(meta.filter("false"), counts, {"x": "x"}).count() == 0 and T.type_cells(meta, counts.filter("false"), {"x": "x"}).count() == 0


def test_effects_are_recovered_and_rare_types_shrink(case):
    meta, counts, slopes, _, _ = case
    fits = S_saved(T.fit_types(T.type_cells(meta, counts, TERMS), TERMS))
    rows = {r["type"]: r for r in fits.collect()}
    assert len(rows) == 6
    for k in range(5):
        f = T.as_fit(rows[f"t{k}"], TERMS)
        sd = np.sqrt(np.diag(f.cov))[1:3]
        assert (np.abs(f.theta[1:3] - slopes[k]) < 4 * sd).all()
    rare, alone = T.as_fit(rows["t5"], TERMS), S.fitted(meta.join(counts.filter("type = 't5'"), "dossier", "left").na.fill(0, ["n"]), S.Model("alone", "n", TERMS))
    common = rows["t5"]["mu_adult"]
    assert abs(rare.theta[1] - common) < 2 * rows["t5"]["sd_adult"] and np.sqrt(rare.cov[1, 1]) < 0.9 * np.sqrt(alone.cov[1, 1])
    assert 0.1 < common < 0.5 and abs(rows["t0"]["mu_minor"] + 0.1) < 0.2
    effects = {r["type"]: r for r in T.type_effects(T.type_draws(fits, TERMS, ["type"], 400), TERMS, ["type"]).collect()}
    for k in range(5):
        f, e = T.as_fit(rows[f"t{k}"], TERMS), effects[f"t{k}"]
        assert abs(e["pct_adult_mean"] - (math.exp(f.theta[1]) - 1) * 100) < 2 and e["pct_adult_hdi_3"] < e["pct_adult_mean"] < e["pct_adult_hdi_97"]
        assert abs(e["delta_mean"] - (f.theta[1] - f.theta[2])) < 0.02 and e["p_adult_gt_0"] > 0.9
    by_slope = {(r["type"], r["term"]): r for r in T.slopes(fits, TERMS, ["type"]).collect()}
    f = T.as_fit(rows["t2"], TERMS)
    assert np.isclose(by_slope["t2", "minor"]["estimate"], f.theta[2]) and np.isclose(by_slope["t2", "minor"]["variance"], f.cov[2, 2])


def S_saved(df):
    from quire.operators.graph import saved

    return saved(df)


def test_priors_are_updated_as_by_plain_python(spark):
    fits = spark.createDataFrame([("a", [0.5, 0.2], [0.01, 0.02], 1.0, 4), ("b", [-0.5, 0.4], [0.04, 0.01], 2.0, 4)], "type string, theta array<double>, variance array<double>, year_squares double, n_years long")
    before = spark.createDataFrame([(0.0, 1.5, 0.0, 1.0, 0.3)], "mu_intercept double, sd_intercept double, mu_x double, sd_x double, sd_year double")
    got = T.updated_priors(fits, before, [], ["x"]).first()
    mu = (0.6 / 1.0) / (2 / 1.0 + 1)
    squares = (0.2 - mu) ** 2 + (0.4 - mu) ** 2 + 0.03
    assert np.isclose(got["mu_x"], mu) and np.isclose(got["sd_x"], S.half_normal_scale(squares, 2, 1.0)) and np.isclose(got["sd_year"], S.half_normal_scale(3.0, 8, 1.0))
    assert np.isclose(got["mu_intercept"], 0.0) and np.isclose(got["sd_intercept"], S.half_normal_scale(0.5 + 0.05, 2, 2.0))


def test_hurdle_tells_presence_from_number(spark):
    """With zeros planted at random, whether there is one says less than how many; the truncated part keeps the slopes."""
    meta, counts, slopes = planted(zeros=0.4)
    meta, counts = spark.createDataFrame(meta), spark.createDataFrame(counts[counts["type"] != "t5"])
    found = {}
    for part in T.HURDLE:
        fits = T.fit_types(T.type_cells(meta, counts, TERMS, part=part), TERMS, part=part)
        found[part] = {r["type"]: T.as_fit(r, TERMS, part) for r in fits.collect()}
    for k in range(5):
        number = found["truncated"][f"t{k}"]
        assert abs(number.theta[1] - slopes[k, 0]) < 4 * math.sqrt(number.cov[1, 1])
        present = found["binomial"][f"t{k}"]
        assert len(present.theta) == present.n_mean
    d = meta.join(counts.filter("type = 't0'"), "dossier", "left").na.fill(0, ["n"]).toPandas()
    f = found["binomial"]["t0"]
    p = 1 / (1 + np.exp(-(f.matrices(d["travel_year"], [d["num_adults"], d["num_minors"]], [])[0] @ f.theta[: f.n_mean])))
    assert abs(p.mean() - (d["n"] > 0).mean()) < 0.02


def test_presence_or_number_of_a_covariate(spark):
    meta, counts, _ = planted()
    meta = spark.createDataFrame(meta).withColumns({"minor_lt16": F.col("num_minors"), "adult_18plus": F.col("num_adults")})
    counts = spark.createDataFrame(counts)
    scored = None
    for name, terms in (("count", T.three_groups()), ("presence", T.preadult_presence())):
        fits = T.fit_types(T.type_cells(meta, counts, terms), terms)
        s = T.type_scores(meta, counts, fits, terms, 300).withColumn("spec", F.lit(name))
        scored = s if scored is None else scored.unionByName(s)
    rows = scored.cache().collect()
    assert len(rows) == 12 and all(r["n"] == 4000 and r["se"] > 0 for r in rows)
    best = {r["type"]: r for r in T.preferred(scored).collect()}
    by = {(r["type"], r["spec"]): r["elpd"] for r in rows}
    for t, r in best.items():
        assert np.isclose(r["elpd_lead"], abs(by[t, "count"] - by[t, "presence"])) and r["spec"] == max(("count", "presence"), key=lambda s: by[t, s])


def test_pooling_over_imputations(spark):
    rng = np.random.default_rng(0)
    rows = [(g, int(k), float(e), float(v)) for g in "ab" for k, e, v in zip(range(20), rng.normal(0.3, 0.1, 20), rng.uniform(0.01, 0.02, 20))] + [("c", 0, 0.5, 0.1)]
    got = {r["type"]: r for r in T.pooled_over_draws(spark.createDataFrame(rows, "type string, draw int, estimate double, variance double"), ["type"]).collect()}
    for g in "ab":
        e, v = (np.array([r[i] for r in rows if r[0] == g]) for i in (2, 3))
        within, between = v.mean(), e.var(ddof=1)
        total = within + (1 + 1 / 20) * between
        r = got[g]
        assert np.isclose([r["mean"], r["within"], r["between"], r["total"]], [e.mean(), within, between, total]).all()
        assert np.isclose(r["df"], 19 * (1 + within / (1.05 * between)) ** 2) and np.isclose(r["missing"], 1.05 * between / total) and np.isclose(r["upper"] - r["mean"], 1.8807936081512509 * math.sqrt(total))
    assert got["c"]["between"] == 0 and got["c"]["df"] is None and got["c"]["total"] == 0.1


def test_draws_are_fitted_as_each_would_be_alone(spark):
    meta, counts, _ = planted(800, 3)
    meta = spark.createDataFrame(meta)
    counts = spark.createDataFrame(pd.concat([counts.assign(draw=k, n=counts["n"] + (k if k else 0)) for k in range(3)]))
    together = {(r["draw"], r["type"]): r for r in T.fit_types(T.type_cells(meta, counts, TERMS, ["draw"]), TERMS, ["draw"], rounds=3, tolerance=0.0).collect()}
    assert len(together) == 9
    alone = {r["type"]: r for r in T.fit_types(T.type_cells(meta, counts.filter("draw = 2").drop("draw"), TERMS), TERMS, rounds=3, tolerance=0.0).collect()}
    for t, r in alone.items():
        assert np.allclose(r["theta"], together[2, t]["theta"], atol=1e-6) and np.isclose(r["mu_adult"], together[2, t]["mu_adult"])


def test_one_pass_serves_several_designs(spark):
    """Joint cells, read once, give each design the cells that the dossiers give it, and its zeros; a type that no dossier of meta has stays a type."""
    meta = spark.createDataFrame([(i, 1990 + i % 2, i % 3) for i in range(30)], "dossier long, travel_year int, k int")
    counts = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 4) for i in range(0, 30, 2)] + [(99, "z", 1)], "dossier long, type string, n long")
    joint = T.joint_cells(meta, counts, {"k": "k"})
    for terms in ({"x": "k"}, {"x": "CAST(k > 0 AS INT)"}):
        got = sorted(map(str, T.cells_of(joint, terms).collect()))
        assert got == sorted(map(str, T.type_cells(meta, counts, terms).collect()))
    z = T.cells_of(joint, {"x": "k"}).filter("type = 'z'")
    assert z.filter("y IS NULL").selectExpr("sum(n)", "sum(total)").first()[:] == (30, 0.0) and [r["n"] for r in z.filter("y = 0").collect()] == [30]
