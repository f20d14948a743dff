"""Classification metrics from long confusion tables. ``by``: columns of a configuration, each evaluated by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.quantiles import with_percentiles
from quire.operators.ranking import least_from_here, running_total


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, true: str, pred: str, by=()) -> DataFrame:
    """true, pred, n of the pairs that occur."""
    return df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def dense_confusion(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of ``classes`` (column label: a vocabulary), 0 where none occurred; labels beyond it are left out."""
    grid = classes.select(F.col("label").alias("true")).crossJoin(classes.select(F.col("label").alias("pred")))
    return grid.join(counts, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def per_class(counts: DataFrame, by=(), classes: DataFrame | None = None) -> DataFrame:
    """class, precision, recall, f1, support, of confusion counts.

    With ``classes`` (column label) the vocabulary is fixed: rows whose true label is outside aren't scored, a prediction outside is only a miss, and classes that
    don't occur are there with zeros. Without it the classes are those of either side; a null prediction is only a miss.
    """
    if classes is not None:
        counts = counts.join(F.broadcast(classes.select(F.col("label").alias("true"))), "true", "left_semi")
    sides = counts.filter("true is not null").select(*by, F.explode(F.array(
        F.struct(F.col("true").alias("class"), F.when(F.col("true").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("x")).select(*by, "x.*").filter("class is not null")
    sums = sides.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    if classes is not None:
        every = classes.select(F.col("label").alias("class"))
        if by:
            every = counts.select(*by).distinct().crossJoin(F.broadcast(every))  # a vocabulary
        sums = every.join(sums, [*by, "class"], "left").na.fill(0, ["tp", "support", "predicted"])
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    out = sums.withColumns({"precision": p, "recall": r})
    f1 = ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return out.select(*by, "class", "precision", "recall", f1.alias("f1"), F.col("support").cast("long").alias("support"), F.col("tp").cast("long").alias("tp"))


def summary(report: DataFrame, by=()) -> DataFrame:
    """accuracy, macro and weighted precision, recall and f1, n_classes and n of per_class rows. Accuracy is null without rows."""
    n = F.sum("support")
    w = lambda c: ratio(F.sum(F.col(c) * F.col("support")), n)
    return report.groupBy(*by).agg(
        F.when(n > 0, F.sum("tp") / n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        w("precision").alias("weighted_precision"), w("recall").alias("weighted_recall"), w("f1").alias("weighted_f1"),
        F.count(F.lit(1)).alias("n_classes"), n.alias("n"))


def report_rows(report: DataFrame) -> DataFrame:
    """The classes and the rows 'macro avg' and 'weighted avg': class, precision, recall, f1, support."""
    s = summary(report)
    cols = ["class", "precision", "recall", "f1", "support"]
    macro = s.select(F.lit("macro avg").alias("class"), *[F.col(f"macro_{c}").alias(c) for c in cols[1:4]], F.col("n").alias("support"))
    weighted = s.select(F.lit("weighted avg").alias("class"), *[F.col(f"weighted_{c}").alias(c) for c in cols[1:4]], F.col("n").alias("support"))
    return report.select(*cols).unionByName(macro).unionByName(weighted)


def binary(df: DataFrame, true: Column, pred: Column, by=()) -> DataFrame:
    """precision, recall, f1 of the positive class, accuracy and n, of two boolean columns (null: false)."""
    t, p = F.coalesce(true, F.lit(False)), F.coalesce(pred, F.lit(False))
    s = df.select(*by, t.alias("t"), p.alias("p")).groupBy(*by).agg(
        F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"), F.count(F.lit(1)).alias("n"))
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return s.select(*by, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    F.when(n > 0, (n - fp - fn) / n).alias("accuracy"), "tp", "fp", "fn", "n")


def roc_auc(df: DataFrame, label: Column, score: str, by=()) -> DataFrame:
    """auc: the chance that a positive row's score is above a negative one's, ties counting half; null unless both occur.

    Counted over distinct scores, so that ties meet before the window.
    """
    per = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(label).alias("pos"), F.count_if(~label).alias("neg"))
    per = running_total(per, ["s"], F.col("neg"), "below", tuple(by))
    wins = per.withColumn("w", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    out = wins.groupBy(*by).agg(F.sum("w").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def benjamini_hochberg(df: DataFrame, p: str, by=()) -> DataFrame:
    """q added: the adjusted p values within each family. A null p has none and doesn't count.

    Over the distinct p values of a family, in ranges of their order: equal ones have the rank of their last, and so one q.
    """
    per = df.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    m = per.groupBy(*by).agg(F.sum("_k").alias("_m"))
    ranked = running_total(per, ["_p"], F.col("_k"), "_below", tuple(by))
    ranked = ranked.join(m, list(by)) if by else ranked.crossJoin(F.broadcast(m))  # one row
    q = least_from_here(ranked, ["_p"], F.col("_p") * F.col("_m") / (F.col("_below") + F.col("_k")), "_q", tuple(by))
    q = q.select(*by, F.col("_p").alias(p), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_q")).alias("q"))
    return df.join(q, [*by, p], "left").select(*df.columns, "q")


def ranked(df: DataFrame, metric: str, model: str = "model", by=(), top: int | None = None) -> DataFrame:
    """rank (from 1) by a metric, missing ones as -1, ties by name; only the first ``top`` if given."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.coalesce(F.col(metric), F.lit(-1.0))), model)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.filter(F.col("rank") <= top)


def best_epoch(history: DataFrame, metric: str, by=(), keep: str = "last", epoch: str = "epoch") -> DataFrame:
    """epoch and metric where the metric is largest; of equal ones the last, or the first."""
    sign = 1 if keep == "last" else -1
    return history.groupBy(*by).agg(F.max_by(epoch, F.struct(F.col(metric), sign * F.col(epoch))).alias(epoch), F.max(metric).alias(metric))


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: a row for each metric."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")


def latency_summary(df: DataFrame, latency: str, error: Column, wall_time: float) -> DataFrame:
    """n, n_failed, pages_per_sec, and of the rows without an error mean, median and p95 of the latency.

    p95 is the exclusive quantile (place 0.95 (n + 1)); below 20 values it is the largest.
    """
    ok, count = df.filter(~error), F.count(F.lit(1))
    n = ok.count()
    # The exclusive place, as a share of the inclusive ones, is a plain percentile.
    share = min(1.0, (0.95 * (n + 1) - 1) / (n - 1)) if n >= 20 else 1.0
    stats = with_percentiles(ok.agg(F.avg(latency).alias("latency_mean")), ok, [], latency, {"latency_median": 0.5, "latency_p95": share})
    total = df.agg(count.alias("n"), F.count_if(error).alias("n_failed"))
    return total.crossJoin(stats).select("n", "n_failed", (F.col("n") / F.lit(float(wall_time))).alias("pages_per_sec"), "latency_mean", "latency_median", "latency_p95")  # one row each
