"""Count regressions of documents by type, with partial pooling over types: slopes, intercepts and year effects of all types have common priors that the types themselves decide.

A dossier without documents of a type counts too, but isn't a row: a type's cells are those of all dossiers, with the sums of its counts joined on, and the number of its zeros
is what the dossiers leave over. So the input is the counts that there are, never dossiers times types.

Types (and periods, and imputations) are fitted side by side in tasks, each from its own aggregates. The common priors are updated between rounds by
expectation-maximisation, from sums over types that Spark takes; the driver holds none of it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import saved
from quire.operators.size_models import INTERCEPT_SD, SLOPE_SD, Fit, Model, Prior, fitted_cells

# Standard deviations of the normal priors of the common means, scales of the half-normal ones of the common spreads.
MEAN_INTERCEPT_SD = 2.0
MEAN_SLOPE_SD = 1.0
INTERCEPT_SCALE = 2.0
SLOPE_SCALE = 1.0
YEAR_SCALE = 1.0

#: The parts of a count: whether there is one, and how many if so.
HURDLE = ("binomial", "truncated")


def two_groups() -> dict[str, str]:
    return {"adult": "num_adults", "minor": "num_minors"}


def three_groups() -> dict[str, str]:
    return {"minor": "minor_lt16", "preadult": "preadult_16_17", "adult": "adult_18plus"}


def preadult_presence() -> dict[str, str]:
    """The three groups, that of 16 and 17 by whether there is one instead of by how many."""
    return three_groups() | {"preadult": "CAST(preadult_16_17 > 0 AS INT)"}


def type_cells(meta: DataFrame, counts: DataFrame, terms: dict[str, str], by: list[str] | tuple = (), within: list[str] | tuple = (), part: str = "negative_binomial") -> DataFrame:
    """within, by, type, travel_year, the terms, n, total, y: a type's cells (y null; n dossiers with ``total`` documents) and its outcome counts (n dossiers with y documents each).

    ``meta``: a row for each dossier (and ``within``, such as a period that it belongs to) with travel_year and covariates; ``counts``: dossier, type, n (above 0) and ``by``, such as a draw. A pair of dossier
    and type without a row counts as 0 in every draw that there is; dossiers with a null year or covariate go. ``part``: 'negative_binomial', 'binomial' (total is the number of dossiers with a document; no outcome counts) or 'truncated' (dossiers with a document alone).
    """
    return cells_of(joint_cells(meta, counts, terms, by, within), {t: t for t in terms}, by, within, part)


def joint_cells(meta: DataFrame, counts: DataFrame, columns: dict[str, str], by: list[str] | tuple = (), within: list[str] | tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Aggregates, written down, that ``type_cells`` and ``type_scores`` read instead of dossiers: (within, travel_year, ``columns``, n dossiers; the same with by, type and y, n dossiers with y documents).

    One pass over meta and one over counts, whose pairs of by and type are all among the second, with a null year where no dossier of ``meta`` has them.
    """
    names = list(columns)
    d = meta.select("dossier", *within, F.col("travel_year").cast("int").alias("travel_year"), *[F.expr(e).cast("double").alias(c) for c, e in columns.items()]).dropna(subset=["dossier", "travel_year", *names])
    design = [*within, "travel_year", *names]
    whole = saved(d.groupBy(*design).agg(F.count(F.lit(1)).alias("n")))
    met = counts.select("dossier", *by, "type", F.col("n").cast("double").alias("y")).join(d.hint("shuffle_hash"), "dossier", "left")  # of dossiers, a task's share
    return whole, saved(met.groupBy(*design, *by, "type", "y").agg(F.count(F.lit(1)).alias("n")))


def _regrouped(cells: tuple[DataFrame, DataFrame], terms: dict[str, str], by, within) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, met, by and type that there are) by ``terms``, expressions of the columns of ``joint_cells``."""
    whole, met = cells
    design = [*within, "travel_year", *[F.expr(e).cast("double").alias(t) for t, e in terms.items()]]
    kinds = met.select(*by, "type").distinct()
    return whole.groupBy(*design).agg(F.sum("n").alias("n")), met.filter("travel_year IS NOT NULL AND y > 0").groupBy(*design, *by, "type", "y").agg(F.sum("n").alias("n")), kinds


def cells_of(cells: tuple[DataFrame, DataFrame], terms: dict[str, str], by: list[str] | tuple = (), within: list[str] | tuple = (), part: str = "negative_binomial") -> DataFrame:
    """``type_cells`` from ``joint_cells``, whose columns ``terms`` are expressions of."""
    names = list(terms)
    whole, met, kinds = _regrouped(cells, terms, by, within)
    design, scope = [*within, "travel_year", *names], [*within, *by, "type"]
    had = met.groupBy(*design, *by, "type").agg(F.sum(F.col("y") * F.col("n")).alias("total"), F.sum("n").alias("some"))
    outcome = met.groupBy(*scope, "y").agg(F.sum("n").alias("n"))
    if part == "truncated":
        found = had.select(*scope, "travel_year", *names, F.col("some").alias("n"), "total")
    else:
        found = whole.crossJoin(kinds).join(had, [*design, *by, "type"], "left")  # design rows for each type: aggregates both
        total = F.coalesce("some" if part == "binomial" else "total", F.lit(0)).cast("double")
        found = found.select(*scope, "travel_year", *names, "n", total.alias("total"))
        if part != "binomial":
            dossiers = whole.groupBy(*within).agg(F.sum("n").alias("dossiers")) if within else whole.agg(F.sum("n").alias("dossiers"))
            seen = kinds.crossJoin(F.broadcast(dossiers)).join(outcome.groupBy(*scope).agg(F.sum("n").alias("seen")), scope, "left")  # a row for each scope
            zeros = seen.select(*scope, F.lit(0.0).alias("y"), (F.col("dossiers") - F.coalesce("seen", F.lit(0))).alias("n")).filter("n > 0")
            outcome = outcome.select(*scope, "y", "n").unionByName(zeros)
    found = found.withColumn("y", F.lit(None).cast("double"))
    return found if part == "binomial" else found.unionByName(outcome.select(*scope, "n", "y"), allowMissingColumns=True)


def _model(terms: dict[str, str], part: str) -> Model:
    return Model("types", "y", {t: t for t in terms}, family=part, trials="trials" if part == "binomial" else None)


def _half_normal(squares: Column, n: Column, scale: float) -> Column:
    return F.sqrt((-n + F.sqrt(n * n + 4 * squares / scale**2)) / 2) * scale


def _first_priors(scopes: DataFrame, names: list[str]) -> DataFrame:
    out = scopes.withColumns({"mu_intercept": F.lit(0.0), "sd_intercept": F.lit(INTERCEPT_SD), "sd_year": F.lit(0.3)})
    return out.withColumns({k: v for t in names for k, v in ((f"mu_{t}", F.lit(0.0)), (f"sd_{t}", F.lit(SLOPE_SD)))})


def updated_priors(fits: DataFrame, before: DataFrame, scope: list[str], names: list[str]) -> DataFrame:
    """The common priors that the types' fits (their theta, the variances of it, and sums of squares of year effects) make likeliest."""
    at = {"intercept": 0} | {t: i + 1 for i, t in enumerate(names)}
    x = fits.withColumns({f"m_{t}": F.col("theta")[i] for t, i in at.items()} | {f"v_{t}": F.col("variance")[i] for t, i in at.items()})
    sums = [F.count(F.lit(1)).cast("double").alias("types"), F.sum("year_squares").alias("year_squares"), F.sum("n_years").cast("double").alias("n_years")]
    sums += [a for t in at for a in (F.sum(f"m_{t}").alias(f"s_{t}"), F.sum(F.col(f"m_{t}") ** 2 + F.col(f"v_{t}")).alias(f"q_{t}"))]
    s = x.groupBy(*scope).agg(*sums) if scope else x.agg(*sums)
    s = s.join(before, scope) if scope else s.crossJoin(F.broadcast(before))  # one row
    out = {}
    for t in at:
        own, scale = (MEAN_INTERCEPT_SD, INTERCEPT_SCALE) if t == "intercept" else (MEAN_SLOPE_SD, SLOPE_SCALE)
        var = F.col(f"sd_{t}") ** 2
        mu = (F.col(f"s_{t}") / var) / (F.col("types") / var + 1 / own**2)
        out[f"mu_{t}"] = mu
        out[f"sd_{t}"] = F.greatest(F.lit(1e-3), _half_normal(F.greatest(F.lit(0.0), F.col(f"q_{t}") - 2 * mu * F.col(f"s_{t}") + F.col("types") * mu * mu), F.col("types"), scale))
    out["sd_year"] = F.greatest(F.lit(1e-3), _half_normal(F.col("year_squares"), F.col("n_years"), YEAR_SCALE))
    return s.select(*scope, *[c.alias(k) for k, c in out.items()])


def _prior_of(row, names: list[str]) -> Prior:
    return Prior((float(row["mu_intercept"]), float(row["sd_intercept"])), {t: (float(row[f"mu_{t}"]), float(row[f"sd_{t}"])) for t in names}, float(row["sd_year"]))


def fit_types(cells: DataFrame, terms: dict[str, str], by: list[str] | tuple = (), within: list[str] | tuple = (), part: str = "negative_binomial", rounds: int = 12, tolerance: float = 1e-2) -> DataFrame:
    """within, by, type, years, theta, cov (flat), sd_year and the common priors (mu_..., sd_...) of each type's fit; ``cells`` as of ``type_cells``.

    Rounds end when no common mean or spread of any scope moves by more than ``tolerance``. A type without rows has no fit; with a single type the priors come close to what it says itself.
    """
    names, scope = list(terms), [*within, *by]
    model = _model(terms, part)
    cells = saved(cells)
    scopes = cells.select(*scope).distinct() if scope else cells.sparkSession.range(1).select()
    priors = saved(_first_priors(scopes, names))
    keys = [*scope, "type"]
    columns = [c for c in priors.columns if c not in scope]
    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "years array<int>, theta array<double>, cov array<double>, variance array<double>, year_squares double, n_years long", *(f"`{c}` double" for c in columns)])

    def fit(key, rows):
        import pandas as pd

        c, h = rows[rows["y"].isna()], rows[rows["y"].notna()]
        c = c[["travel_year", *names, "n", "total"]].reset_index(drop=True)
        c["travel_year"] = c["travel_year"].astype(int)
        if part == "binomial":
            c["trials"] = c["n"]
        if c.empty:
            return pd.DataFrame(columns=[*keys, "years", "theta", "cov", "variance", "year_squares", "n_years", *columns])
        first = rows.iloc[0]
        f = fitted_cells(model, c, h[["y", "n"]].reset_index(drop=True), prior=_prior_of(first, names))
        v, own = np.diag(f.cov), slice(1 + len(names), f.n_mean)
        row = dict(zip(keys, key)) | {"years": f.years, "theta": f.theta, "cov": f.cov.ravel(), "variance": v, "year_squares": float((f.theta[own] ** 2 + v[own]).sum()), "n_years": len(f.years)}
        return pd.DataFrame([row | {k: float(first[k]) for k in columns}])

    for k in range(rounds):
        rows = cells.join(F.broadcast(priors), scope) if scope else cells.crossJoin(F.broadcast(priors))  # a row for each scope
        fits = saved(rows.groupBy(*keys).applyInPandas(fit, schema))
        after = saved(updated_priors(fits, priors, scope, names))
        moved = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns]
        met = after.alias("a").join(priors.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in scope]) if scope else after.alias("a").crossJoin(priors.alias("b"))
        far = met.agg(F.max(F.greatest(*moved))).first()[0]
        priors = after
        if far is None or far <= tolerance:
            break
    return fits.drop("variance", "year_squares", "n_years")


def as_fit(row, terms: dict[str, str], part: str = "negative_binomial") -> Fit:
    """A row of ``fit_types`` as a fit over columns named as the terms."""
    theta = np.array(row["theta"], float)
    return Fit(_model(terms, part), [int(y) for y in row["years"]], theta, np.array(row["cov"], float).reshape(len(theta), -1), float(row["sd_year"]), None)


def type_draws(fits: DataFrame, terms: dict[str, str], keys: list[str], draws: int = 1000, seed: int = 0, part: str = "negative_binomial") -> DataFrame:
    """keys, draw, beta_... of each term: draws of each fit's slopes, made where it lies."""
    names = list(terms)
    kinds = dict(fits.dtypes)

    def run(batches):
        import pandas as pd
        import xxhash

        for b in batches:
            for _, r in b.iterrows():
                own = xxhash.xxh64_intdigest("|".join(str(r[k]) for k in keys), seed=seed)
                d = as_fit(r, terms, part).draws(draws, own)[:, 1 : 1 + len(names)]
                yield pd.DataFrame({**{k: [r[k]] * draws for k in keys}, "draw": np.arange(draws), **{f"beta_{t}": d[:, i] for i, t in enumerate(names)}})

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "draw int", *(f"beta_{t} double" for t in names)])
    return fits.mapInPandas(run, schema)


def type_effects(draws: DataFrame, terms: dict[str, str], keys: list[str]) -> DataFrame:
    """keys, and for each term the percents of change a unit: pct_..._mean, _hdi_3, _hdi_97, p_..._gt_0; with two terms also delta_mean, delta_hdi_3, delta_hdi_97, p_delta_gt_0 (the first less the second). A fit's draws are a bounded group."""
    out = []
    for t in terms:
        pct = (F.exp(f"beta_{t}") - 1) * 100
        out += [F.avg(pct).alias(f"pct_{t}_mean"), F.percentile(pct, 0.03).alias(f"pct_{t}_hdi_3"), F.percentile(pct, 0.97).alias(f"pct_{t}_hdi_97"), F.avg((F.col(f"beta_{t}") > 0).cast("double")).alias(f"p_{t}_gt_0")]
    if len(terms) == 2:
        a, b = terms
        d = F.col(f"beta_{a}") - F.col(f"beta_{b}")
        out += [F.avg(d).alias("delta_mean"), F.percentile(d, 0.03).alias("delta_hdi_3"), F.percentile(d, 0.97).alias("delta_hdi_97"), F.avg((d > 0).cast("double")).alias("p_delta_gt_0")]
    return draws.groupBy(*keys).agg(*out)


def slopes(fits: DataFrame, terms: dict[str, str], keys: list[str]) -> DataFrame:
    """keys, term, estimate, variance, common_mean, common_sd: a row for each slope of each fit."""
    p = F.size("theta")
    each = [F.struct(F.lit(t).alias("term"), F.col("theta")[i + 1].alias("estimate"), F.element_at("cov", (p + 1) * F.lit(i + 1) + 1).alias("variance"), F.col(f"mu_{t}").alias("common_mean"), F.col(f"sd_{t}").alias("common_sd")) for i, t in enumerate(terms)]
    return fits.select(*keys, F.explode(F.array(*each)).alias("s")).select(*keys, "s.*")


def pooled_over_draws(slopes: DataFrame, by: list[str], draw: str = "draw") -> DataFrame:
    """by, m (imputations), mean, within, between, total, df, missing, lower, upper: estimates of several imputations as one, by Rubin's rules.

    within is the mean of the variances, between the variance of the estimates, total = within + (1 + 1/m) between; df are the degrees of freedom of its t distribution (null without spread between them), missing
    the share of the variance that is due to the imputation, and the interval holds 94 % by the normal distribution.
    """
    x = slopes.groupBy(*by).agg(F.count_distinct(draw).alias("m"), F.avg("estimate").alias("mean"), F.avg("variance").alias("within"), F.coalesce(F.var_samp("estimate"), F.lit(0.0)).alias("between"))
    inflated = (1 + 1 / F.col("m")) * F.col("between")
    x = x.withColumn("total", F.col("within") + inflated)
    z = 1.8807936081512509  # the normal distribution's 97th percentile
    return x.select(*by, "m", "mean", "within", "between", "total", F.when(F.col("between") > 0, (F.col("m") - 1) * (1 + F.col("within") / inflated) ** 2).alias("df"),
                    F.when(F.col("total") > 0, inflated / F.col("total")).alias("missing"), (F.col("mean") - z * F.sqrt("total")).alias("lower"), (F.col("mean") + z * F.sqrt("total")).alias("upper"))


def expected_as_counts(expected: DataFrame, digits: int = 2) -> DataFrame:
    """Expected counts of a point correction as counts to fit: dossier, type, n, rounded to so many digits, so that their number of distinct values stays small; those that round to 0 count as none."""
    return expected.select("dossier", "type", F.round("expected", digits).alias("n")).filter("n > 0")


def type_scores(meta: DataFrame, counts: DataFrame, fits: DataFrame, terms: dict[str, str], draws: int = 500) -> DataFrame:
    """type, n, elpd, se, p_loo, n_bad: leave-one-out scores of each type's fit over all dossiers, zeros among them; distinct (design, outcome) rows are scored where they lie."""
    return scores_of(joint_cells(meta, counts, terms), fits, {t: t for t in terms}, draws)


def scores_of(cells: tuple[DataFrame, DataFrame], fits: DataFrame, terms: dict[str, str], draws: int = 500) -> DataFrame:
    """``type_scores`` from ``joint_cells``."""
    from quire.operators.loo import BAD_K, _log_sum, smoothed_weights
    from quire.operators.size_models import likelihoods

    names = list(terms)
    whole, had, kinds = _regrouped(cells, terms, (), ())
    design = ["travel_year", *names]
    whole = whole.crossJoin(kinds)  # design rows for each type
    left = whole.join(had.groupBy("type", *design).agg(F.sum("n").alias("some")), ["type", *design], "left")
    zeros = left.select("type", *design, F.lit(0.0).alias("y"), (F.col("n") - F.coalesce("some", F.lit(0))).alias("n")).filter("n > 0")
    rows = had.select("type", *design, "y", "n").unionByName(zeros)

    def score(key, left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            f = as_fit(right.iloc[0], terms)
            drawn = f.draws(draws)
            at = {t: t for t in names} | {"y": "y"}
            for lo in range(0, len(left), 500):
                part = left.iloc[lo : lo + 500]
                ll = likelihoods(f, drawn, part, at)
                w, k = smoothed_weights(-ll)
                e = _log_sum(w + ll)
                n = part["n"].to_numpy(float)
                out.append((n.sum(), n @ e, n @ e**2, n @ (_log_sum(ll) - math.log(draws) - e), n @ (k > BAD_K)))
        if not out:
            return pd.DataFrame(columns=["type", "n", "elpd", "se", "p_loo", "n_bad"])
        n, e, q, p, bad = np.array(out).sum(0)
        return pd.DataFrame([{"type": key[0], "n": int(n), "elpd": e, "se": math.sqrt(max(0.0, q - e * e / n)), "p_loo": p, "n_bad": int(bad)}])

    return rows.groupBy("type").cogroup(fits.groupBy("type")).applyInPandas(score, "type string, n long, elpd double, se double, p_loo double, n_bad long")


def preferred(scores: DataFrame, label: str = "spec") -> DataFrame:
    """type, the ``label`` with the largest score, and by how much it leads the next: elpd, elpd_lead."""
    w = Window.partitionBy("type").orderBy(F.desc("elpd"), label)  # a row for each spec
    met = scores.withColumns({"_r": F.row_number().over(w), "_next": F.lead("elpd").over(w)})
    return met.filter("_r = 1").select("type", label, "elpd", (F.col("elpd") - F.col("_next")).alias("elpd_lead"))
