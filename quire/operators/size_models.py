"""Count regressions of dossiers: families of models, their fits, their comparison and their curves.

A fit needs little of the rows: with a log link the coefficients' likelihood depends on how many rows and which sum of counts each distinct design
row has, and the dispersion's on how often each count occurs. Both are aggregates taken by Spark, as large as years times covariate values however many
dossiers there are. The comparison needs every row's likelihood; that pass stays on the cluster, for all models at once.

Instead of sampling, a fit is the posterior mode with its curvature; standard deviations of year effects are found by expectation-maximisation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Standard deviations of the normal priors, the half-normal of year effects, the gamma prior of a constant dispersion.
INTERCEPT_SD = 1.5
SLOPE_SD = 1.0
DISPERSION_MEAN = 2.0
DISPERSION_SD = 1.0
DISPERSION_SLOPE_SD = 0.5
YEAR_SCALE = 1.0
GAMMA_SHAPE = 2.0
GAMMA_RATE = 0.1

#: Families of counts, whose dispersion is fitted from how often each count occurs.
COUNTED = ("negative_binomial", "truncated")

#: Directed terms over time: name -> expressions of era (0, 1) and year_c (years since the border).
STRUCTURES = {
    "iid": {},
    "trend": {"trend": "year_c"},
    "step": {"step": "era"},
    "step_trend": {"step": "era", "trend_pre": "year_c * (1 - era)", "trend_post": "year_c * era"},
}


@dataclass(frozen=True)
class Model:
    """``terms``: name -> SQL expression of a covariate. ``dispersion``: 'constant' or one of STRUCTURES ('iid': an effect for each year).

    ``family``: 'negative_binomial' of ``outcome``, or 'truncated' (the same of outcomes above 0 alone); 'binomial' or 'beta_binomial' of ``outcome`` out of ``trials``.
    """

    name: str
    outcome: str
    terms: dict[str, str] = field(default_factory=dict)
    dispersion: str = "constant"
    family: str = "negative_binomial"
    trials: str | None = None

    @property
    def spread(self) -> dict[str, str]:
        return {} if self.dispersion == "constant" else STRUCTURES[self.dispersion]


def by_persons(outcome: str = "num_docs") -> list[Model]:
    """A: persons; A_era: their slope differs by era; B: adults and minors; C: the adults' slope differs by era."""
    persons, split = {"persons": "num_persons"}, {"adult": "num_adults", "minor": "num_minors"}
    return [Model("A", outcome, persons), Model("A_era", outcome, persons | {"persons_era": "num_persons * era"}),
            Model("B", outcome, split), Model("C", outcome, split | {"adult_era": "num_adults * era"})]


def by_age_groups(outcome: str = "num_docs") -> list[Model]:
    """Three age groups: no slope differs by era (B3), that of 16 and 17 (C3), all (D3)."""
    groups = {"minor": "minor_lt16", "preadult": "preadult_16_17", "adult": "adult_18plus"}
    era = {name: {f"{name}_era": f"{column} * era"} for name, column in groups.items()}
    return [Model("B3", outcome, groups), Model("C3", outcome, groups | era["preadult"]), Model("D3", outcome, groups | era["minor"] | era["preadult"] | era["adult"])]


def over_time(outcome: str = "num_docs", covariates: dict[str, str] | None = None, family: str = "negative_binomial", trials: str | None = None) -> list[Model]:
    """One model for each structure of the mean, beside ``covariates``; a year has an undirected effect in all."""
    return [Model(f"mean_{s}", outcome, (covariates or {}) | {f"mean_{k}": v for k, v in t.items()}, family=family, trials=trials) for s, t in STRUCTURES.items()]


def with_dispersions(model: Model, kinds: tuple[str, ...] = ("constant", "trend", "iid")) -> list[Model]:
    return [Model(f"{k}_disp", model.outcome, model.terms, k, model.family, model.trials) for k in kinds]


# -- special functions ------------------------------------------------------------------------------------------------


def log_gamma(x):
    """Stirling's series, eight steps up."""
    x = np.asarray(x, float)
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - sum(np.log(x + i) for i in range(8))


def digamma(x):
    x = np.asarray(x, float)
    z = x + 8
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - sum(1 / (x + i) for i in range(8))


# -- what a fit needs of the rows -------------------------------------------------------------------------------------


WEIGHT = "_rows"


def reduced(df: DataFrame, columns: list[str]) -> DataFrame:
    """travel_year, ``columns`` and how many rows have them, as _rows, which all of this module's functions count by: write it down once and many models read it instead of the rows."""
    return df.groupBy("travel_year", *columns).agg(F.count(F.lit(1)).alias(WEIGHT))


def designed(df: DataFrame, models: list[Model], by: list[str] | tuple = ()) -> tuple[DataFrame, dict[str, str]]:
    """(``by``, travel_year, _rows, a column for each distinct expression of the models, their outcomes and trials; the column of each expression). Rows with a null among these have no likelihood and go."""
    wanted = dict.fromkeys(e for m in models for e in [*m.terms.values(), *m.spread.values(), m.outcome, *([m.trials] if m.trials else [])])
    names = {e: f"x{i}" for i, e in enumerate(wanted)}
    weight = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1).cast("long")
    out = df.select(*by, "travel_year", weight.alias(WEIGHT), *[F.expr(e).cast("double").alias(c) for e, c in names.items()])
    return out.dropna(subset=[c for c in out.columns if c not in by]), names


def cells(df: DataFrame, model: Model, by: list[str] | tuple = ()) -> DataFrame:
    """``by``, travel_year, a column for each term (and term of the dispersion, as disp_...), n, total (sum of outcomes), trials: one row for each distinct design row; for the beta-binomial, for each outcome and number of trials as well."""
    rows, at = designed(df, [model], by)
    keys = [*by, "travel_year", *[F.col(at[e]).alias(t) for t, e in model.terms.items()], *[F.col(at[e]).alias(f"disp_{t}") for t, e in model.spread.items()]]
    y, trials = F.col(at[model.outcome]), F.col(at[model.trials]) if model.trials else F.lit(0.0)
    if model.family == "truncated":
        rows = rows.filter(y > 0)
    if model.family == "beta_binomial":
        return rows.groupBy(*keys, y.alias("total"), trials.alias("trials")).agg(F.sum(WEIGHT).alias("n"))
    return rows.groupBy(*keys).agg(F.sum(WEIGHT).alias("n"), F.sum(y * F.col(WEIGHT)).alias("total"), F.sum(trials * F.col(WEIGHT)).alias("trials"))


def outcome_counts(df: DataFrame, model: Model, digits: int = 2, by: list[str] | tuple = ()) -> DataFrame:
    """``by``, disp_... (and travel_year where dispersion has year effects), y, n. Fractional outcomes (expected counts) are rounded to ``digits`` here, which only the dispersion sees."""
    rows, at = designed(df, [model], by)
    keys = [*by, *[F.col(at[e]).alias(f"disp_{t}") for t, e in model.spread.items()]] + (["travel_year"] if model.dispersion == "iid" else [])
    if model.family == "truncated":
        rows = rows.filter(F.col(at[model.outcome]) > 0)
    return rows.groupBy(*keys, F.round(at[model.outcome], digits).alias("y")).agg(F.sum(WEIGHT).alias("n"))


# -- fits -------------------------------------------------------------------------------------------------------------


def _slopes(model: Model, eta, la, n, total, trials):
    """(value, d eta, d log dispersion) of each cell; the negative binomial's part that counts alone decide is _count_part."""
    if model.family == "binomial":
        return total * eta - trials * np.logaddexp(0, eta), total - trials / (1 + np.exp(-eta)), np.zeros_like(eta)
    a = np.exp(la)
    if model.family in COUNTED:
        mu = np.exp(np.clip(eta, -30, 30))
        share, rest, kept = a / (a + mu), mu / (a + mu), np.log1p(mu / a)
        slack = a * (rest - kept)  # derivative of the log of share ** a by log dispersion
        value, d_eta, d_la = total * eta - (n * a + total) * kept, (total - n * mu) * share, n * slack + total * rest
        if model.family == "truncated":  # less the log of the probability of a count above 0
            none = np.minimum(-a * kept, -1e-12)
            odds = n * np.exp(none) / -np.expm1(none)
            value, d_eta, d_la = value - n * np.log(-np.expm1(none)), d_eta - odds * a * rest, d_la + odds * slack
        return value, d_eta, d_la
    p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
    one, two, miss = p * a, (1 - p) * a, trials - total
    value = log_gamma(total + one) + log_gamma(miss + two) - log_gamma(trials + a) - log_gamma(one) - log_gamma(two) + log_gamma(a)
    d1, d2, both = digamma(total + one) - digamma(one), digamma(miss + two) - digamma(two), digamma(a) - digamma(trials + a)
    return n * value, n * (d1 - d2) * a * p * (1 - p), n * a * (p * d1 + (1 - p) * d2 + both)


def _rising(a, y):
    """(log gamma(a + y) - log gamma(a) - y log a, its derivative by log a), right to the last digits also where a is so large that the differences nearly vanish."""
    z = a + 8
    tail = lambda z: 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    slope = lambda z: 1 / (12 * z**2) - 1 / (120 * z**4) + 1 / (252 * z**6) - 1 / (240 * z**8)
    grown = np.log1p(y / z)
    value = (z + y - 0.5) * grown - y + y * np.log1p(8 / a) + tail(z + y) - tail(z) - sum(np.log1p(y / (a + i)) for i in range(8))
    d_log = a * grown - y + a * (y / (2 * z * (z + y)) + slope(z) - slope(z + y) + sum(y / ((a + i) * (a + y + i)) for i in range(8)))
    return value, d_log


def _count_part(la, y, n):
    """What counts alone add, less y times the log dispersion, which _slopes leaves out too."""
    value, d_log = _rising(np.exp(la), y)
    return n * (value - log_gamma(y + 1)), n * d_log


@dataclass
class Fit:
    """``theta``: intercept, terms, years' effects, then the same of the log dispersion; ``cov`` its covariance."""

    model: Model
    years: list[int]
    theta: np.ndarray
    cov: np.ndarray
    year_sd: float
    dispersion_year_sd: float | None

    @property
    def has_dispersion(self) -> bool:
        return self.model.family != "binomial"

    @property
    def n_mean(self) -> int:
        return 1 + len(self.model.terms) + len(self.years)

    def names(self) -> list[str]:
        mean = ["intercept", *self.model.terms, *[f"year_{y}" for y in self.years]]
        if not self.has_dispersion:
            return mean
        return mean + ["log_dispersion", *[f"disp_{t}" for t in self.model.spread], *([f"disp_year_{y}" for y in self.years] if self.model.dispersion == "iid" else [])]

    def draws(self, n: int, seed: int = 0) -> np.ndarray:
        root = np.linalg.cholesky(self.cov + 1e-12 * np.eye(len(self.cov)))
        return self.theta + np.random.default_rng(seed).standard_normal((n, len(self.theta))) @ root.T

    def matrices(self, year, terms, spread) -> tuple[np.ndarray, np.ndarray]:
        """(mean, dispersion) design of rows: their years, a list of columns for the terms, one for those of the dispersion."""
        return _design(self.model, self.years, year, terms, spread)


def _design(model: Model, years, year, terms, spread):
    own = (np.asarray(year)[:, None] == np.asarray(years)[None, :]).astype(float)
    one = np.ones((len(own), 1))
    mean = np.hstack([one, *[np.asarray(t, float)[:, None] for t in terms], own])
    disp = np.hstack([one, *[np.asarray(t, float)[:, None] for t in spread], *([own] if model.dispersion == "iid" else [])])
    return mean, disp


@dataclass(frozen=True)
class Prior:
    """Normal priors of a fit. ``intercept`` and each of ``slopes`` are (mean, sd); without an intercept's, it lies around the log mean of the counts. ``year_sd`` is that of year effects; None: it is found from the rows."""

    intercept: tuple[float, float] | None = None
    slopes: dict[str, tuple[float, float]] = field(default_factory=dict)
    year_sd: float | None = None


#: Distinct rows that a fit reads at most; more are an error, not a longer wait: a continuous covariate has to be binned before.
MOST_CELLS = 1_000_000


def _bounded(df: DataFrame):
    """The rows in memory, if they are as few as aggregates should be."""
    out = df.limit(MOST_CELLS + 1).toPandas()
    if len(out) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} distinct rows to fit: bin the covariates or round the outcomes")
    return out


def fitted(df: DataFrame, model: Model, rounds: int = 30, tolerance: float = 1e-3, prior: Prior = Prior()) -> Fit:
    """The mode of a model and its covariance. A table without rows to fit is an error, as is one with more than MOST_CELLS distinct rows."""
    c = _bounded(cells(df, model))  # distinct design rows
    h = _bounded(outcome_counts(df, model)) if model.family in COUNTED else None  # distinct counts
    return fitted_cells(model, c, h, rounds, tolerance, prior)


def fitted_cells(model: Model, c, h=None, rounds: int = 30, tolerance: float = 1e-3, prior: Prior = Prior()) -> Fit:
    """The mode of a model from its cells and, for counts, its outcome counts (pandas tables, as of ``cells`` and ``outcome_counts``). Needs no Spark, so that many fits can run side by side in tasks."""
    if c.empty:
        raise ValueError("no rows to fit")
    c = c.sort_values(list(c.columns), ignore_index=True)
    years = sorted(int(y) for y in c["travel_year"].unique())
    n, total = (c[k].to_numpy(float) for k in ("n", "total"))
    trials = c["trials"].to_numpy(float) if "trials" in c else np.zeros(len(c))
    mean, disp = _design(model, years, c["travel_year"], [c[t] for t in model.terms], [c[f"disp_{t}"] for t in model.spread])
    counted = model.family in COUNTED
    if counted:
        h_y, h_n = h["y"].to_numpy(float), h["n"].to_numpy(float)
        _, h_disp = _design(model, years, h["travel_year"] if model.dispersion == "iid" else np.zeros(len(h)), [], [h[f"disp_{t}"] for t in model.spread])
    if model.family == "binomial":
        disp = disp[:, :0]
    k, p = mean.shape[1], mean.shape[1] + disp.shape[1]
    centre, sd = np.zeros(p), np.full(p, SLOPE_SD)
    centre[0], sd[0] = prior.intercept or ((math.log(max(total.sum(), 0.5) / n.sum()), INTERCEPT_SD) if counted else (0.0, INTERCEPT_SD))
    for i, t in enumerate(model.terms):
        centre[1 + i], sd[1 + i] = prior.slopes.get(t, (0.0, SLOPE_SD))
    at_year = slice(1 + len(model.terms), k)
    at_disp_year = slice(k + 1 + len(model.spread), p) if model.dispersion == "iid" and disp.shape[1] else None
    constant = bool(disp.shape[1]) and model.dispersion == "constant"
    if disp.shape[1]:
        centre[k], sd[k] = DISPERSION_MEAN, DISPERSION_SD
        sd[k + 1:k + 1 + len(model.spread)] = DISPERSION_SLOPE_SD
    scale = {"year": prior.year_sd or 0.3, "disp": 0.3}

    def target(theta):
        """(log posterior, gradient, curvature) with the second derivatives by each cell's eta and log dispersion from differences."""
        eta, la = mean @ theta[:k], disp @ theta[k:] if disp.shape[1] else np.zeros(len(mean))
        f = lambda de, dl: _slopes(model, eta + de, la + dl, n, total, trials)
        e = 1e-4
        value, g_e, g_l = f(0, 0)
        up, down = f(e, 0), f(-e, 0)
        ee, el = (up[1] - down[1]) / (2 * e), (up[2] - down[2]) / (2 * e)
        grad, value, curve = np.zeros(p), value.sum(), np.zeros((p, p))
        grad[:k], curve[:k, :k] = mean.T @ g_e, -(mean.T * ee) @ mean
        if disp.shape[1]:
            up, down = f(0, e), f(0, -e)
            grad[k:], curve[k:, k:] = disp.T @ g_l, -(disp.T * ((up[2] - down[2]) / (2 * e))) @ disp
            curve[:k, k:] = -(mean.T * el) @ disp
            curve[k:, :k] = curve[:k, k:].T
            if counted:
                hl = h_disp @ theta[k:]
                v, g = _count_part(hl, h_y, h_n)
                second = (_count_part(hl + e, h_y, h_n)[1] - _count_part(hl - e, h_y, h_n)[1]) / (2 * e)
                value, grad[k:] = value + v.sum(), grad[k:] + h_disp.T @ g
                curve[k:, k:] -= (h_disp.T * second) @ h_disp
        weight = 1 / sd**2
        weight[at_year] = 1 / scale["year"] ** 2
        if at_disp_year:
            weight[at_disp_year] = 1 / scale["disp"] ** 2
        if constant:  # a gamma prior of the dispersion, in its log
            weight[k] = 0
            a = math.exp(min(theta[k], 50))
            value, grad[k], curve[k, k] = value + GAMMA_SHAPE * theta[k] - GAMMA_RATE * a, grad[k] + GAMMA_SHAPE - GAMMA_RATE * a, curve[k, k] + GAMMA_RATE * a
        off = theta - centre
        return value - 0.5 * (weight * off * off).sum(), grad - weight * off, curve + np.diag(weight)

    theta = centre.copy()
    for _ in range(rounds):
        now, damp = target(theta), 1e-6
        for _ in range(100):
            step = _solved(now[2], now[1], damp)
            new = target(theta + step) if step is not None else None
            if new is not None and np.isfinite(new[0]) and new[0] >= now[0] - 1e-10 * (1 + abs(now[0])):
                theta, now, damp = theta + step, new, max(damp / 10, 1e-9)
                if np.abs(step).max() < 1e-7:
                    break
            else:
                damp *= 10
                if damp > 1e12:
                    break
        cov = np.linalg.pinv(now[2], hermitian=True)
        was = dict(scale)
        for name, part in (("year", None if prior.year_sd else at_year), ("disp", at_disp_year)):
            if part:
                scale[name] = half_normal_scale(float((theta[part] ** 2 + np.diag(cov)[part]).sum()), part.stop - part.start, YEAR_SCALE)
        if all(abs(scale[x] - was[x]) <= tolerance * was[x] for x in scale):
            break
    return Fit(model, years, theta, (cov + cov.T) / 2, scale["year"], scale["disp"] if at_disp_year else None)


_FITTED = "model string, years array<int>, theta array<double>, cov array<double>, year_sd double, disp_sd double"


def fit_all(df: DataFrame, models: list[Model]) -> list[Fit]:
    """``fitted`` of several models side by side, each in a task of its own from its own aggregates; names have to differ. What comes back is parameters and their covariances."""
    own = {m.name: m for m in models}
    if len(own) < len(models):
        raise ValueError("two models have one name")
    rows = None
    for m in models:
        c = cells(df, m)
        z = F.array(*[F.col(f"disp_{t}") for t in m.spread]).cast("array<double>")
        part = c.select(F.lit(m.name).alias("model"), "travel_year", F.array(*[F.col(t) for t in m.terms]).cast("array<double>").alias("x"), z.alias("z"), F.col("n").cast("double").alias("n"), F.col("total").cast("double").alias("total"), F.col("trials").cast("double").alias("trials"), F.lit(None).cast("double").alias("y"))
        if m.family in COUNTED:
            h = outcome_counts(df, m)
            year = F.col("travel_year") if m.dispersion == "iid" else F.lit(0)
            null = F.lit(None).cast("double")
            part = part.unionByName(h.select(F.lit(m.name).alias("model"), year.alias("travel_year"), F.lit(None).cast("array<double>").alias("x"), z.alias("z"), F.col("n").cast("double").alias("n"), null.alias("total"), null.alias("trials"), F.col("y").cast("double").alias("y")))
        rows = part if rows is None else rows.unionByName(part)

    def fit(key, part):
        import pandas as pd

        if len(part) > 2 * MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} distinct rows to fit: bin the covariates or round the outcomes")
        m = own[key[0]]

        def table(some, names, column):
            values = np.array([list(v) for v in some[column]], float).reshape(len(some), len(names))
            return {c: values[:, i] for i, c in enumerate(names)}

        c, h = part[part["y"].isna()], part[part["y"].notna()]
        spread = [f"disp_{t}" for t in m.spread]
        c = pd.DataFrame({"travel_year": c["travel_year"].to_numpy(int), **table(c, list(m.terms), "x"), **table(c, spread, "z"), "n": c["n"].to_numpy(), "total": c["total"].to_numpy(), "trials": c["trials"].to_numpy()})
        h = pd.DataFrame({**table(h, spread, "z"), "travel_year": h["travel_year"].to_numpy(int), "y": h["y"].to_numpy(), "n": h["n"].to_numpy()})
        f = fitted_cells(m, c, h)
        return pd.DataFrame([{"model": m.name, "years": f.years, "theta": f.theta, "cov": f.cov.ravel(), "year_sd": f.year_sd, "disp_sd": f.dispersion_year_sd}])

    found = {r["model"]: r for r in rows.groupBy("model").applyInPandas(fit, _FITTED).collect()}  # a row for each model
    if len(found) < len(models):
        raise ValueError("no rows to fit")
    return [Fit(m, list(r["years"]), np.array(r["theta"]), np.array(r["cov"]).reshape(len(r["theta"]), -1), r["year_sd"], r["disp_sd"]) for m in models for r in [found[m.name]]]


def half_normal_scale(squares: float, n: float, scale: float) -> float:
    """The standard deviation of n effects whose expected squares sum to ``squares``, under a half-normal prior of that scale."""
    return math.sqrt((-n + math.sqrt(n * n + 4 * squares / scale**2)) / 2) * scale


def _solved(curve, grad, damp):
    """A damped Newton step, longest component two; None where the curvature isn't positive."""
    try:
        root = np.linalg.cholesky(curve + damp * np.diag(np.maximum(np.diag(curve), 1.0)))
    except np.linalg.LinAlgError:
        return None
    step = np.linalg.solve(root.T, np.linalg.solve(root, grad))
    return step * min(1.0, 2 / max(np.abs(step).max(), 1e-300))


# -- comparison -------------------------------------------------------------------------------------------------------


def log_likelihood(model: Model, eta, la, y, trials):
    """Of single observations, whole (with the terms that no parameter changes)."""
    one = np.ones_like(eta)
    value = _slopes(model, eta, la, one, y * one, trials * one)[0]
    if model.family in COUNTED:
        return value + _count_part(la, y, one)[0]
    return value + log_gamma(trials + 1) - log_gamma(y + 1) - log_gamma(trials - y + 1)


def likelihoods(fit: Fit, draws: np.ndarray, rows, at: dict[str, str]) -> np.ndarray:
    """Log likelihoods of the rows (a pandas table of ``designed``'s columns, whose names by expression are ``at``) under each draw: rows x draws."""
    m = fit.model
    mean, disp = fit.matrices(rows["travel_year"], [rows[at[x]] for x in m.terms.values()], [rows[at[x]] for x in m.spread.values()])
    eta = mean @ draws[:, :fit.n_mean].T
    la = disp @ draws[:, fit.n_mean:].T if fit.has_dispersion else np.zeros_like(eta)
    trials = rows[at[m.trials]].to_numpy(float)[:, None] if m.trials else np.zeros((len(rows), 1))
    return log_likelihood(m, eta, la, rows[at[m.outcome]].to_numpy(float)[:, None], trials)


def compared(df: DataFrame, fits: list[Fit], draws: int = 200) -> DataFrame:
    """model, rank (from 0), elpd, se, p_eff, elpd_diff, dse (of the difference from the best), n_high (variance above 0.4), n.

    Expected log predictive density by the widely applicable information criterion over draws of each fit. Each distinct row's terms are computed where it lies, and sums of products of models' terms give all differences' errors in one pass.
    """
    models = [f.model for f in fits]
    rows, at = designed(df, models)
    rows = rows.groupBy(*[c for c in rows.columns if c != WEIGHT]).agg(F.sum(WEIGHT).alias("n"))
    known = [(f, f.draws(draws)) for f in fits]

    def partial(batches):
        import pandas as pd

        size = len(known)
        for b in batches:
            out = []
            for lo in range(0, len(b), 2000):
                part = b.iloc[lo:lo + 2000]
                w, e, var = part["n"].to_numpy(float), [], []
                for f, d in known:
                    ll = likelihoods(f, d, part, at)
                    v, top = ll.var(1, ddof=1), ll.max(1)
                    e.append(top + np.log(np.exp(ll - top[:, None]).mean(1)) - v)
                    var.append(v)
                out += [(i, j, float(w @ (e[i] * e[j])), float(w @ e[i]), float(w @ var[i]), float(w @ (var[i] > 0.4)), float(w.sum())) for i in range(size) for j in range(size)]
            yield pd.DataFrame(out, columns=["i", "j", "product", "elpd", "p_eff", "high", "n"])

    sums = rows.mapInPandas(partial, "i int, j int, product double, elpd double, p_eff double, high double, n double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("product", "elpd", "p_eff", "high", "n")])
    s = {(r["i"], r["j"]): r for r in sums.collect()}  # models squared
    best = sorted(range(len(fits)), key=lambda i: (-s[i, i]["elpd"], models[i].name))
    spread = lambda total, squares, n: math.sqrt(max(0.0, squares - total**2 / n))
    out, top = [], best[0]
    for rank, i in enumerate(best):
        a, t = s[i, i], s[top, top]
        diff = t["elpd"] - a["elpd"]
        squares = a["product"] + t["product"] - 2 * s[i, top]["product"]
        out.append((models[i].name, rank, a["elpd"], spread(a["elpd"], a["product"], a["n"]), a["p_eff"], diff, spread(diff, squares, a["n"]) if i != top else 0.0, int(a["high"]), int(a["n"])))
    return df.sparkSession.createDataFrame(out, "model string, rank int, elpd double, se double, p_eff double, elpd_diff double, dse double, n_high long, n long")


def temporal_search(df: DataFrame, outcome: str = "num_docs", covariates: dict[str, str] | None = None) -> tuple[Fit, DataFrame]:
    """(the winner, the comparisons of both stages): the best structure of the mean first, then, on it, the best of the dispersion."""
    first = fit_all(df, over_time(outcome, covariates))
    mean = compared(df, first)
    winner = mean.filter("rank = 0").first()["model"]
    chosen = next(f for f in first if f.model.name == winner)
    kinds = with_dispersions(chosen.model)
    second = [Fit(m, chosen.years, chosen.theta, chosen.cov, chosen.year_sd, None) for m in kinds if m.dispersion == "constant"] + fit_all(df, [m for m in kinds if m.dispersion != "constant"])
    disp = compared(df, second)
    last = disp.filter("rank = 0").first()["model"]
    return next(f for f in second if f.model.name == last), mean.withColumn("stage", F.lit("mean")).unionByName(disp.withColumn("stage", F.lit("dispersion")))


# -- results ----------------------------------------------------------------------------------------------------------


def coefficients(spark, fits: list[Fit]) -> DataFrame:
    """model, term, estimate, sd; years' effects are among the terms, and their standard deviation is year_sd."""
    rows = [(f.model.name, t, float(b), float(s)) for f in fits for t, b, s in zip(f.names(), f.theta, np.sqrt(np.clip(np.diag(f.cov), 0, None)))]
    rows += [(f.model.name, "year_sd", float(f.year_sd), None) for f in fits] + [(f.model.name, "disp_year_sd", float(f.dispersion_year_sd), None) for f in fits if f.dispersion_year_sd is not None]
    return spark.createDataFrame(rows, "model string, term string, estimate double, sd double")


def yearly_curve(spark, fit: Fit, border: int, at: dict[str, float] | None = None, n: int = 500) -> DataFrame:
    """travel_year, mu and sd with mean and 3 and 97 percentiles over draws: a negative binomial fit at fixed covariates ``at`` (name -> value), for each year."""
    if fit.model.family != "negative_binomial":
        raise ValueError("a curve of counts needs a negative binomial fit")
    d, y = fit.draws(n), np.array(fit.years)
    names = {"year_c": (y - border).astype(float), "era": (y >= border).astype(float)} | {k: np.full(len(y), float(v)) for k, v in (at or {}).items()}
    known = STRUCTURES["step_trend"] | STRUCTURES["trend"]
    over = {known["step"]: names["era"], known["trend"]: names["year_c"], known["trend_pre"]: names["year_c"] * (1 - names["era"]), known["trend_post"]: names["year_c"] * names["era"]}

    def column(expression):
        if expression in over:
            return over[expression]
        base, _, by_era = expression.partition(" * ")
        return names[base] * (names["era"] if by_era else 1.0)

    mean, disp = fit.matrices(y, [column(e) for e in fit.model.terms.values()], [column(e) for e in fit.model.spread.values()])
    mu, a = np.exp(mean @ d[:, :fit.n_mean].T), np.exp(disp @ d[:, fit.n_mean:].T)
    sd = np.sqrt(mu + mu**2 / a)
    stats = [f(z) for z in (mu, sd) for f in (lambda z: z.mean(1), lambda z: np.percentile(z, 3, axis=1), lambda z: np.percentile(z, 97, axis=1))]
    rows = [(int(t), *[float(s[i]) for s in stats]) for i, t in enumerate(y)]
    return spark.createDataFrame(rows, "travel_year int, mu_mean double, mu_hdi_3 double, mu_hdi_97 double, sd_mean double, sd_hdi_3 double, sd_hdi_97 double")
