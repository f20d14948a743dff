"""Correction for classifier error: Bayes inversion, expected counts, multiple imputation by hashed draws.

Posteriors are long tables (draw, true, pred, p), a few classes squared for each draw.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.hashing import uniform
from quire.operators.quantiles import HDI, with_percentiles
from quire.operators.segments import documents, segmented


def smoothed_prior(rows: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """true, prior: (n + 1) / sum of each class of the vocabulary (column label)."""
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    out = classes.select("label").join(n, "label", "left").na.fill(0, ["n"]).withColumn("w", F.col("n") + F.lit(1.0))
    total = out.agg(F.sum("w").alias("t"))
    return out.crossJoin(F.broadcast(total)).select(F.col("label").alias("true"), (F.col("w") / F.col("t")).alias("prior"))  # one row


def row_normalised(counts: DataFrame, smoothing: float = 0.0) -> DataFrame:
    """true, pred, p: P(pred | true) of dense confusion counts."""
    w = Window.partitionBy("true")
    x = F.col("n") + F.lit(smoothing)
    return counts.select("true", "pred", (x / F.sum(x).over(w)).alias("p"))


def precision_by_class(counts: DataFrame) -> DataFrame:
    """class, precision of confusion counts: the diagonal over its predictions."""
    out = counts.groupBy("pred").agg(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("n"))
    return out.select(F.col("pred").alias("class"), F.when(F.col("n") > 0, F.col("hit") / F.col("n")).alias("precision"))


def inverted(posterior: DataFrame, prior: DataFrame, by=()) -> DataFrame:
    """by, pred, true, w: P(true | pred) in proportion to p and the prior."""
    w = Window.partitionBy(*by, "pred")
    x = posterior.join(F.broadcast(prior), "true").withColumn("x", F.col("p") * F.col("prior"))  # a row for each class
    return x.select(*by, "pred", "true", (F.col("x") / F.sum("x").over(w)).alias("w"))


def soft_counts(segs: DataFrame, correction: DataFrame) -> DataFrame:
    """dossier, type, expected: each segment counts for every true type with its probability."""
    return segs.join(correction, segs["type"] == correction["pred"]).groupBy("dossier", F.col("true").alias("type")).agg(F.sum("w").alias("expected"))


def expected_documents(pages: DataFrame, p_start: DataFrame, page: str = "page_num") -> DataFrame:
    """dossier, expected: the sum of each page's probability of being a true start (pred, p); the first page's is 1."""
    first = F.row_number().over(Window.partitionBy("dossier").orderBy(page)) == 1
    flag = F.when(F.col("predicted_start_page") == "yes", "yes").otherwise("no")
    rows = pages.select("dossier", first.alias("_first"), flag.alias("pred")).join(F.broadcast(p_start), "pred")  # two rows
    return rows.groupBy("dossier").agg(F.sum(F.when(F.col("_first"), 1.0).otherwise(F.col("p"))).alias("expected"))


def cumulative(correction: DataFrame, by=()) -> DataFrame:
    """by, pred, steps: for each predicted class the true classes in order, with the running sum of their probabilities; the last is 1."""
    w = Window.partitionBy(*by, "pred").orderBy("true").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.row_number().over(Window.partitionBy(*by, "pred").orderBy(F.desc("true"))) == 1
    cum = correction.withColumn("hi", F.when(last, 1.0).otherwise(F.sum("w").over(w)))
    return cum.groupBy(*by, "pred").agg(F.array_sort(F.collect_list(F.struct("hi", "true"))).alias("steps"))


def drawn(steps: Column, u: Column) -> Column:
    """The first class whose running sum is above u."""
    return F.element_at(F.filter(steps, lambda x: x["hi"] > u), 1)["true"]


def imputed_types(segs: DataFrame, correction: DataFrame, seed: str, key: list[str], by=("draw",)) -> DataFrame:
    """A row for each segment and draw: draw, the segment's columns, type as drawn. Boundaries stay."""
    steps = cumulative(correction, by)
    shared = [c for c in by if c in segs.columns]
    rows = segs.withColumnRenamed("type", "pred").join(F.broadcast(steps), [*shared, "pred"])  # a row for each draw and class
    u = uniform(F.lit(seed), *by, *key)
    return rows.withColumn("type", drawn(F.col("steps"), u)).drop("steps", "pred")


def imputed_starts(pages: DataFrame, correction: DataFrame, seed: str, page: str = "page_num") -> DataFrame:
    """draw, the page's columns, start: whether a page starts a document in that draw."""
    steps = cumulative(correction, ("draw",))
    flag = F.when(F.col("predicted_start_page") == "yes", "yes").otherwise("no")
    rows = pages.withColumn("pred", flag).join(F.broadcast(steps), "pred")  # two rows for each draw
    u = uniform(F.lit(seed), F.lit("start"), "draw", "dossier", page)
    return rows.withColumn("start", drawn(F.col("steps"), u) == "yes").drop("steps", "pred")


def imputed_documents(pages: DataFrame, starts: DataFrame, types: DataFrame, seed: str, label: str = "type", conf: str = "document_type_confidence") -> DataFrame:
    """draw, dossier, seg, type, first_page, order_in_dossier, n_segments, norm_position of each draw: starts are drawn anew, pages segmented by them, each segment's majority type taken and its true type drawn."""
    narrow = pages.select("dossier", "page_num", "predicted_start_page", F.col(label).alias("type"), F.col(conf).alias("conf"))
    by = ("draw", "dossier")
    seg = segmented(imputed_starts(narrow, starts, seed), F.col("start"), by, rule="bool")
    docs = documents(seg, "type", "conf", by)
    return imputed_types(docs, types, seed + "|type", ["dossier", "first_page"])


def draw_counts(docs: DataFrame) -> DataFrame:
    """draw, dossier, type, n."""
    return docs.groupBy("draw", "dossier", "type").agg(F.count(F.lit(1)).alias("n"))


#: Pages times draws that imputed_counts holds at once (a draw of one dossier at least).
_AT_ONCE = 200_000


def imputed_counts(pages: DataFrame, starts: DataFrame, types: DataFrame, seed: str, label: str = "type", conf: str = "document_type_confidence", page: str = "page_num") -> DataFrame:
    """draw (long), dossier, type, n: the draw_counts of imputed_documents, for many draws. A task takes a dossier's pages once and all draws from them, so no page is copied, sorted or shuffled for each draw.

    Both corrections (draws by classes squared) are read on the driver and sent with the function. Every page needs a number.
    """
    rows = pages.select("dossier", F.col("dossier").cast("string").alias("name"), F.col(page).alias("page"), F.col(page).cast("string").alias("number"),
                        F.when(F.col("predicted_start_page") == "yes", 1).otherwise(0).alias("flag"), F.col(label).alias("type"), F.col(conf).cast("double").alias("conf"))
    bounds = _start_bounds(cumulative(starts, ("draw",)).collect())
    count = _counter(bounds, _type_steps(cumulative(types, ("draw",)).collect(), list(bounds)), seed)
    return rows.groupBy("dossier").applyInArrow(count, f"draw long, dossier {rows.schema['dossier'].dataType.simpleString()}, type string, n long")


def _start_bounds(steps) -> dict:
    """For each draw the numbers from which and below which a page predicted as no or yes starts a document; nan where the correction doesn't know the prediction."""
    out = {}
    for r in steps:
        bounds = out.setdefault(r["draw"], np.full((2, 2), np.nan))
        names = [s["true"] for s in r["steps"]]
        if r["pred"] in ("no", "yes"):
            i = names.index("yes") if "yes" in names else len(names)
            his = [0.0, *[s["hi"] for s in r["steps"]], np.inf]
            bounds[int(r["pred"] == "yes")] = (his[i], his[i + 1]) if i < len(names) else (np.inf, np.inf)
    return dict(sorted(out.items()))


def _type_steps(steps, draws: list):
    """preds, trues, and by draw and pred: the running sums (inf beyond the last) and the places in trues that they belong to."""
    preds, trues = sorted({r["pred"] for r in steps}), sorted({s["true"] for r in steps for s in r["steps"]})
    at, place = {d: i for i, d in enumerate(draws)}, {t: i for i, t in enumerate(trues)}
    hi = np.full((len(draws), len(preds), max((len(r["steps"]) for r in steps), default=1)), np.inf)
    true = np.zeros(hi.shape, "int64")
    for r in steps:
        if r["draw"] in at:
            for k, s in enumerate(r["steps"]):
                hi[at[r["draw"]], preds.index(r["pred"]), k], true[at[r["draw"]], preds.index(r["pred"]), k] = s["hi"], place[s["true"]]
    return preds, trues, hi, true


def _uniforms(keys) -> np.ndarray:
    """``uniform`` of keys that are joined already: the first 52 bits of their md5."""
    first = np.frombuffer(b"".join([hashlib.md5(k).digest() for k in keys]), ">u8")[::2]
    return (first >> np.uint64(12)).astype("float64") / float(1 << 52)


def _counter(bounds: dict, steps, seed: str):
    """The function of imputed_counts over a dossier's pages."""
    preds, trues, hi, true = steps
    names, limits = list(bounds), np.array(list(bounds.values())).reshape(-1, 2, 2)
    start_keys, type_keys = ([f"{seed}|{what}|{d}".encode() for d in names] for what in ("start", "type"))

    def some(d0: int, d1: int, tails, flag, code, labels, conf, known):
        """draw, true type, n of the draws from d0 to d1."""
        draw, row = np.repeat(np.arange(d0, d1), len(flag)), np.tile(np.arange(len(flag)), d1 - d0)
        u = np.concatenate([_uniforms([start_keys[d] + t for t in tails]) for d in range(d0, d1)])
        low, high = limits[draw, flag[row]].T
        draw, row, start = (x[~np.isnan(low)] for x in (draw, row, (u >= low) & (u < high)))
        if not len(draw):
            return draw, draw, draw
        start |= np.r_[True, draw[1:] != draw[:-1]]
        seg, heads = np.cumsum(start) - 1, np.flatnonzero(start)
        pairs, first, inverse = np.unique(seg * (len(labels) + 1) + code[row], return_index=True, return_inverse=True)
        total = np.bincount(inverse, np.where(known, conf, 0.0)[row])
        total[np.bincount(inverse, known[row]) == 0] = -np.inf
        total[np.isnan(total)] = np.inf
        of = pairs // (len(labels) + 1)
        order = np.lexsort((first, -total, of))
        best = order[np.r_[True, np.diff(of[order]) > 0]]  # of each segment
        at = np.array([preds.index(t) if t in preds else -1 for t in [*labels, None]])[pairs[best] % (len(labels) + 1)]
        head, draw = row[heads], draw[heads]
        kept = at >= 0
        kept[kept] = np.isfinite(hi[draw[kept], at[kept], 0])
        head, draw, at = head[kept], draw[kept], at[kept]
        u = _uniforms([type_keys[d] + tails[h] for d, h in zip(draw.tolist(), head.tolist())])
        drawn = true[draw, at, (hi[draw, at] <= u[:, None]).sum(1)]
        found, n = np.unique(draw * len(trues) + drawn, return_counts=True)
        return found // len(trues), found % len(trues), n

    def count(key: tuple, pages: pa.Table) -> pa.Table:
        pages = pages.sort_by("page")
        labels = pages["type"].combine_chunks().dictionary_encode()
        code = labels.indices.fill_null(len(labels.dictionary)).to_numpy().astype("int64")
        conf, known = pages["conf"].fill_null(0.0).to_numpy(), pc.is_valid(pages["conf"]).to_numpy()
        tails = ["".join(f"|{x}" for x in pair if x is not None).encode() for pair in zip(pages["name"].to_pylist(), pages["number"].to_pylist())]
        many = max(1, _AT_ONCE // len(tails))
        parts = [some(d, min(d + many, len(names)), tails, pages["flag"].to_numpy(), code, labels.dictionary.to_pylist(), conf, known) for d in range(0, len(names), many)]
        draw, kind, n = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"draw": pa.array([names[i] for i in draw.tolist()], pa.int64()), "dossier": pa.repeat(key[0], len(draw)), "type": pa.array([trues[i] for i in kind.tolist()], pa.string()),
                         "n": pa.array(n, pa.int64())})

    return count


def long_counts(meta: DataFrame, wide: DataFrame, key: str, types: list[str], rounded: bool = False) -> DataFrame:
    """A row for each dossier of ``meta`` and type: doc_type, doc_count (rounded half to even if asked), and meta's columns."""
    joined = meta.join(wide, key)
    if rounded:
        joined = joined.withColumns({t: F.bround(F.col(f"`{t}`")).cast("int") for t in types})
    return joined.unpivot(meta.columns, [f"`{t}`" for t in types], "doc_type", "doc_count")


def pooled(estimates: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd (between imputations), hdi_3, hdi_97 of an estimate over imputations; missing ones don't count."""
    x = F.when(~F.isnan(value), F.col(value))
    return with_percentiles(estimates.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")), estimates, list(by), value, HDI)


def winner_shares(comparisons: DataFrame, by: list[str], model: str, score: str) -> DataFrame:
    """by, model, wins, share: in how many imputations each model has the largest score, the least name of several."""
    per = comparisons.groupBy(*by, "draw").agg(F.min_by(model, F.struct(-F.col(score), F.col(model))).alias(model))
    w = Window.partitionBy(*by)
    return per.groupBy(*by, model).agg(F.count(F.lit(1)).alias("wins")).withColumn("share", F.col("wins") / F.sum("wins").over(w))


def as_percent(draws: DataFrame, beta: str, out: str = "pct") -> DataFrame:
    """Draws of a log rate's slope as percents of change a unit."""
    return draws.withColumn(out, (F.exp(beta) - 1) * 100)


def pooled_effects(draws: DataFrame, by: list[str], beta: str, imputation: str = "imputation") -> DataFrame:
    """by, n_imputations, mean, hdi_3, hdi_97 of a slope's percents over the draws of all imputations that there are."""
    x = as_percent(draws, beta)
    return with_percentiles(x.groupBy(*by).agg(F.count_distinct(imputation).alias("n_imputations"), F.avg("pct").alias("mean")), x, list(by), "pct", HDI)


def paired_by_hash(draws: DataFrame, by: list[str], seed: str, *keys: str) -> DataFrame:
    """``draws`` with draw, their place in an order by hash within ``by``: two posteriors that are joined by it are paired at random, the longer one's rest going unpaired. ``keys`` tell a draw from all others."""
    from quire.functions.hashing import uniform
    from quire.operators.ranking import numbered

    out = draws.drop("draw").withColumn("_u", uniform(F.lit(seed), *keys))
    return numbered(out, ["_u", *keys], "draw", tuple(by)).drop("_u")


def difference(a: DataFrame, b: DataFrame, value: str, by: list[str]) -> DataFrame:
    """mean, hdi_3, hdi_97, p_below of b minus a, draws paired by their rank."""
    met = a.select(*by, "draw", F.col(value).alias("_a")).join(b.select(*by, "draw", F.col(value).alias("_b")), [*by, "draw"])
    met = met.withColumn("_d", F.col("_b") - F.col("_a"))
    return with_percentiles(met.groupBy(*by).agg(F.avg("_d").alias("mean"), F.avg((F.col("_d") < 0).cast("double")).alias("p_below")), met, list(by), "_d", HDI)
