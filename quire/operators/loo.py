"""Leave-one-out comparison of count regressions: Pareto-smoothed importance sampling, K folds, stacking weights.

A row left out is predicted from draws of the fit to all rows, weighted by the inverse of their likelihood of it. The largest weights are smoothed by a generalised Pareto
distribution fitted to them, whose shape k says how far the result can be trusted. All of this is done for each distinct row where it lies; sums over rows make the comparison.
Where k is too large, K folds are the other way: aggregates of all rows less those of a fold are what a fit without it needs, so no fold reads the rows again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graph import saved
from quire.operators.size_models import COUNTED, WEIGHT, Fit, Model, cells, designed, fitted_cells, likelihoods, outcome_counts

#: Shapes above these are counted: weights with no variance, and estimates not to be relied on.
FAIR_K, BAD_K = 0.5, 0.7
#: Rows whose draws are held at a time.
_ROWS = 500


def pareto_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape and scale of a generalised Pareto distribution for each row of excesses, ascending and above 0.

    The empirical Bayes estimate of Zhang and Stephens (2009) over a grid of rates, the shape drawn to 0.5 with the weight of ten values.
    """
    n = x.shape[1]
    m = 30 + int(math.sqrt(n))
    quarter = x[:, max(0, int(n / 4 + 0.5) - 1)]
    rate = (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5)))[None, :] / (3 * quarter[:, None]) + 1 / x[:, -1:]
    shape = np.stack([np.log1p(-rate[:, [j]] * x).mean(1) for j in range(m)], axis=1)
    fit = n * (np.log(-rate / shape) - shape - 1)
    weight = 1 / np.exp(np.clip(fit[:, None, :] - fit[:, :, None], -700, 700)).sum(2)
    best = (rate * weight).sum(1) / weight.sum(1)
    k = np.log1p(-best[:, None] * x).mean(1)
    sigma = -k / best
    return (n * k + 5) / (n + 10), sigma


def smoothed_weights(log_ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weights that sum to 1 over the draws of each row, and the shapes k of their tails (infinite where a tail is too short or has no spread)."""
    log_ratio = log_ratio - log_ratio.max(1, keepdims=True)
    rows, draws = log_ratio.shape
    tail = min(draws // 5, int(math.ceil(3 * math.sqrt(draws))))
    k = np.full(rows, np.inf)
    if tail >= 5:
        order = np.argsort(log_ratio, axis=1, kind="stable")
        top = order[:, -tail:]
        ends = np.take_along_axis(log_ratio, top, 1)
        cut = np.take_along_axis(log_ratio, order[:, -tail - 1 : -tail], 1)
        excess = np.exp(ends) - np.exp(cut)
        some = (excess[:, 0] > 0) & (ends[:, -1] - ends[:, 0] > 1e-12)
        if some.any():
            shape, scale = pareto_fit(excess[some])
            p = (np.arange(tail) + 0.5) / tail
            with np.errstate(divide="ignore", invalid="ignore"):
                far = np.where(np.abs(shape)[:, None] < 1e-12, -np.log1p(-p), np.expm1(-shape[:, None] * np.log1p(-p)) / shape[:, None])
            smooth = np.minimum(np.log(np.exp(cut[some]) + scale[:, None] * far), 0.0)  # no more than the largest
            log_ratio = log_ratio.copy()
            ends[some] = smooth
            np.put_along_axis(log_ratio, top, ends, 1)
            k[some] = shape
    return log_ratio - _log_sum(log_ratio)[:, None], k


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def pointwise(df: DataFrame, fits: list[Fit], draws: int = 1000, by: list[str] | None = None) -> DataFrame:
    """A row for each distinct row of ``df``: ``by``, _rows (how many it stands for), and arrays over the models: elpd, lppd (the row not left out), k, waic (the other estimate of elpd)."""
    rows, at = designed(df, [f.model for f in fits], by or [])
    rows = rows.groupBy(*[c for c in rows.columns if c != WEIGHT]).agg(F.sum(WEIGHT).alias(WEIGHT))
    known = [(f, f.draws(draws)) for f in fits]
    names = [*(by or []), WEIGHT, "elpd", "lppd", "k", "waic"]

    def run(batches):
        import pandas as pd

        for b in batches:
            for lo in range(0, len(b), _ROWS):
                part = b.iloc[lo : lo + _ROWS]
                found = {n: [] for n in names[-4:]}
                for f, d in known:
                    ll = likelihoods(f, d, part, at)
                    w, k = smoothed_weights(-ll)
                    whole = _log_sum(ll) - math.log(ll.shape[1])
                    for n, x in zip(names[-4:], (_log_sum(w + ll), whole, k, whole - ll.var(1, ddof=1))):
                        found[n].append(x)
                yield pd.DataFrame({**{c: part[c].to_numpy() for c in names[:-4]}, **{n: list(np.stack(x, axis=1)) for n, x in found.items()}})

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names[:-4]), *(f"{c} array<double>" for c in names[-4:])])
    return rows.mapInPandas(run, schema)


def _products(points: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j and sums over rows: of the products of the models' elpd, and of elpd, lppd and k counts of model i."""
    pair = points.select(*by, WEIGHT, "elpd", "lppd", "k", "waic", F.posexplode("elpd").alias("i", "a")).select("*", F.posexplode("elpd").alias("j", "b"))
    w, k = F.col(WEIGHT), F.col("k")[F.col("i")]
    own = lambda x: F.sum(w * x)
    return pair.groupBy(*by, "i", "j").agg(own(F.col("a") * F.col("b")).alias("product"), own(F.col("a")).alias("elpd"), own(F.col("lppd")[F.col("i")]).alias("lppd"), own(F.col("waic")[F.col("i")]).alias("waic"),
                                           own((k > FAIR_K).cast("int")).alias("above_fair"), own((k > BAD_K).cast("int")).alias("bad"), F.max(k).alias("max_k"), F.sum(w).alias("n"))


def loo_compared(points: DataFrame, models: list[str], by: list[str] | None = None) -> DataFrame:
    """by, model, rank (from 0), elpd_loo, p_loo, elpd_diff, se, dse (of the difference from the best), waic, max_k, n_fair (0.5 < k <= 0.7), n_bad (k > 0.7), warning, n; ``points`` as of ``pointwise``.

    With ``by``, each of its groups is compared by itself. Models with equal scores rank by their place in ``models``.
    """
    by = by or []
    s = _products(points, by)
    names = s.sparkSession.createDataFrame(list(enumerate(models)), "i int, model string")  # a row for each model
    own = s.filter("i = j").select(*by, "i", "elpd", "lppd", "waic", "above_fair", "bad", "max_k", "n", F.col("product").alias("square"))
    best = own.groupBy(*by).agg(F.min_by(F.struct("i", "elpd", "square"), F.struct(-F.col("elpd"), F.col("i"))).alias("best"))
    met = own.join(best, by) if by else own.crossJoin(F.broadcast(best))  # one row
    cross = s.select(*by, F.col("i"), F.col("j").alias("top"), "product")
    met = met.withColumn("top", F.col("best.i")).join(cross, [*by, "i", "top"])
    error = lambda total, squares: F.sqrt(F.greatest(F.lit(0.0), squares - total * total / F.col("n")))
    diff = F.col("best.elpd") - F.col("elpd")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("elpd"), "i")) - 1  # a row for each model (and group)
    return met.join(F.broadcast(names), "i").select(
        *by, "model", rank.alias("rank"), F.col("elpd").alias("elpd_loo"), (F.col("lppd") - F.col("elpd")).alias("p_loo"), diff.alias("elpd_diff"), error(F.col("elpd"), F.col("square")).alias("se"),
        F.when(F.col("i") == F.col("top"), 0.0).otherwise(error(diff, F.col("square") + F.col("best.square") - 2 * F.col("product"))).alias("dse"), "waic", "max_k",
        (F.col("above_fair") - F.col("bad")).cast("long").alias("n_fair"), F.col("bad").cast("long").alias("n_bad"), (F.col("bad") > 0).alias("warning"), F.col("n").cast("long").alias("n"))


def stacking_weights(points: DataFrame, models: list[str], rounds: int = 200, tolerance: float = 1e-6) -> list[tuple[str, float]]:
    """The weights of the mixture of the models' predictions with the largest log score. Each round is a pass over ``points`` (write them down before) that returns sums for each pair of models."""
    n = len(models)
    w = np.full(n, 1.0 / n)
    p = [F.exp(F.col("elpd")[i] - F.array_max("elpd")) for i in range(n)]
    for _ in range(rounds):
        mixed = sum((p[i] * float(w[i]) for i in range(1, n)), p[0] * float(w[0]))
        share = [p[i] / mixed for i in range(n)]
        sums = points.agg(F.sum(WEIGHT), *[F.sum(F.col(WEIGHT) * share[i]) for i in range(n)], *[F.sum(F.col(WEIGHT) * share[i] * share[j]) for i in range(n) for j in range(i, n)]).first()
        grad, curve = np.array(sums[1 : n + 1]) / sums[0], np.zeros((n, n))
        curve[np.triu_indices(n)] = np.array(sums[n + 1 :]) / sums[0]
        curve = curve + np.triu(curve, 1).T
        if grad.max() - 1 < tolerance:  # no model would gain by more weight
            break
        w = _stepped(w, grad, curve)
    return [(m, float(x)) for m, x in zip(models, w)]


def _stepped(w: np.ndarray, grad: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """A Newton step within the simplex, by active sets; where it stalls, the step of expectation-maximisation."""
    free = (w > 1e-12) | (grad > 1)
    for _ in range(len(w)):
        i = np.flatnonzero(free)
        a = np.block([[curve[np.ix_(i, i)] + 1e-9 * np.eye(len(i)), np.ones((len(i), 1))], [np.ones((1, len(i))), np.zeros((1, 1))]])
        step = np.zeros(len(w))
        step[i] = np.linalg.lstsq(a, np.append(grad[i], 0.0), rcond=None)[0][:-1]
        low = (step < 0) & (w + step < 0) & free & (w <= 1e-12)
        if not low.any():
            break
        free &= ~low
    down = step < -1e-15
    reach = min(1.0, float((w[down] / -step[down]).min())) if down.any() else 1.0
    out = np.clip(w + reach * step, 0, None)
    if not np.isfinite(out).all() or np.abs(out - w).max() < 1e-12:
        out = w * grad
    return out / out.sum()


def k_folds(df: DataFrame, models: list[Model], key: list[str], folds: int = 10, draws: int = 500) -> DataFrame:
    """model, elpd, se, n: each row is predicted by a fit without its fold (by a hash of ``key``); rows of one ``key`` are left out together.

    Folds' cells are taken from all in the aggregates, and all fits run side by side in tasks.
    """
    fold = F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int")
    rows, at = designed(df.withColumn("_fold", fold), models, ["_fold"])
    rows = saved(rows.groupBy(*[c for c in rows.columns if c != WEIGHT]).agg(F.sum(WEIGHT).alias(WEIGHT)))
    out = None
    for m in models:
        own = Model(m.name, at[m.outcome], {t: at[e] for t, e in m.terms.items()}, "constant", m.family, at[m.trials] if m.trials else None)
        if m.dispersion != "constant":
            raise ValueError("folds are for models with a constant dispersion")
        scored = _held_out(rows, own, folds, draws).withColumn("model", F.lit(m.name))
        out = scored if out is None else out.unionByName(scored)
    n, total = F.sum(WEIGHT), F.sum(F.col(WEIGHT) * F.col("elpd"))
    return out.groupBy("model").agg(total.alias("elpd"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(WEIGHT) * F.col("elpd") ** 2) - total * total / n)).alias("se"), n.cast("long").alias("n"))


_FIT = "_fold int, years array<int>, theta array<double>, cov array<double>, year_sd double"


def _held_out(rows: DataFrame, model: Model, folds: int, draws: int) -> DataFrame:
    """Of each distinct row: _rows and its elpd under the fit without its fold."""
    every = rows.sparkSession.range(folds).select(F.col("id").cast("int").alias("_fold"))

    def without(aggregated: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
        """For each fold, the aggregates of all rows less its own."""
        whole = aggregated.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        met = whole.crossJoin(F.broadcast(every)).join(aggregated, [*keys, "_fold"], "left")  # a row for each fold
        left = met.select("_fold", *keys, *[(F.col(f"_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in sums])
        return left.filter("n > 0")

    c = cells(rows, model, ["_fold"])
    keys = ["travel_year", *model.terms, *(["total", "trials"] if model.family == "beta_binomial" else [])]
    c = without(c, keys, ["n"] if model.family == "beta_binomial" else ["n", "total", "trials"])
    both = c.withColumn("y", F.lit(None).cast("double"))
    if model.family in COUNTED:
        h = without(outcome_counts(rows, model, by=["_fold"]), ["y"], ["n"])
        both = both.unionByName(h, allowMissingColumns=True)

    def fit(key, part):
        import pandas as pd

        counts = part[part["y"].notna()]
        f = fitted_cells(model, part[part["y"].isna()].drop(columns=["_fold", "y"]), counts[["y", "n"]] if len(counts) else None)
        return pd.DataFrame([{"_fold": key[0], "years": f.years, "theta": f.theta, "cov": f.cov.ravel(), "year_sd": f.year_sd}])

    fits = saved(both.groupBy("_fold").applyInPandas(fit, _FIT)).collect()  # a row for each fold, as long as the model has parameters squared
    known = {r["_fold"]: Fit(model, list(r["years"]), np.array(r["theta"]), np.array(r["cov"]).reshape(len(r["theta"]), -1), r["year_sd"], None) for r in fits}
    of = {e: e for e in [*model.terms.values(), model.outcome, *([model.trials] if model.trials else [])]}

    def score(batches):
        import pandas as pd

        drawn = {i: f.draws(draws) for i, f in known.items()}
        for b in batches:
            for i, part in b.groupby("_fold"):
                f, d = _with_years(known[i], drawn[i], part["travel_year"].tolist())
                for lo in range(0, len(part), _ROWS):
                    some = part.iloc[lo : lo + _ROWS]
                    ll = likelihoods(f, d, some, of)
                    yield pd.DataFrame({WEIGHT: some[WEIGHT], "elpd": _log_sum(ll) - math.log(ll.shape[1])})

    return rows.mapInPandas(score, f"{WEIGHT} long, elpd double")


def _with_years(f: Fit, draws: np.ndarray, years: list[int]) -> tuple[Fit, np.ndarray]:
    """The fit and its draws with effects of years that it hasn't seen, drawn from the spread of years' effects."""
    new = sorted({int(y) for y in years} - set(f.years))
    if not new:
        return f, draws
    effects = np.random.default_rng(new[0]).standard_normal((len(draws), len(new))) * f.year_sd
    return Fit(f.model, [*f.years, *new], f.theta, f.cov, f.year_sd, None), np.hstack([draws[:, : f.n_mean], effects, draws[:, f.n_mean :]])
