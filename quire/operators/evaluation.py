"""Evaluation of models: predictions met with keyed truth, a registry of metrics, significance, fusions of all pairs, dispatch by family."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import metrics, segmetrics
from quire.operators.graph import saved

KEYS = ("dossier", "page_num")


def with_truth(predictions: DataFrame, truth: DataFrame, columns: list[str], keys=KEYS, keep: bool = False) -> DataFrame:
    """``predictions`` with the truth's columns of the same keys, whatever the order of either: those without truth go, or stay with nulls (``keep``).

    A key that truth holds several times is an error, raised as it is met.
    """
    once = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    met = predictions.drop(*[c for c in columns if c not in keys]).join(once, list(keys), "left" if keep else "inner")
    checked = F.assert_true(F.coalesce(F.col("_n"), F.lit(1)) == 1, F.concat(F.lit("several true rows of "), F.concat_ws("/", *keys)))
    return met.filter(checked.isNull()).drop("_n")


def join_report(predictions: DataFrame, truth: DataFrame, label: str, keys=KEYS) -> DataFrame:
    """n_predicted, n_true, n_joined, n_without_truth, n_without_prediction, n_missing_label (joined, but truth has no label)."""
    a = predictions.select(*keys).withColumn("_p", F.lit(1))
    b = truth.select(*keys, F.col(label).alias("_l")).withColumn("_t", F.lit(1))
    met, p, t = a.join(b, list(keys), "full_outer"), F.col("_p").isNotNull(), F.col("_t").isNotNull()
    return met.agg(F.count("_p").alias("n_predicted"), F.count("_t").alias("n_true"), F.count_if(p & t).alias("n_joined"), F.count_if(p & ~t).alias("n_without_truth"),
                   F.count_if(t & ~p).alias("n_without_prediction"), F.count_if(p & t & F.col("_l").isNull()).alias("n_missing_label"))


def _over_vocabulary(true: str, pred: str, classes: str, value: str) -> Callable:
    def of(pages: DataFrame, vocabularies: dict[str, DataFrame], by: tuple[str, ...]) -> DataFrame:
        report = metrics.per_class(metrics.confusion(pages, true, pred, by), by, vocabularies[classes])
        return metrics.summary(report, by).select(*by, F.col(value).alias("value"))

    return of


def _start_f1(pages, vocabularies, by):
    return metrics.binary(pages, F.col("start_page") == "yes", F.col("predicted_start_page") == "yes", by).select(*by, F.col("f1").alias("value"))


def _pq(pages, vocabularies, by):
    return segmetrics.panoptic_quality(segmetrics.stream_quality(pages, (*by, "dossier")), by).select(*by, F.col("pq").alias("value"))


def _attached(key: str) -> Callable:
    def of(pages, vocabularies, by):
        rows = segmetrics.attachment_rows(pages, "document_type", "predicted_document_type", (*by, "dossier"))
        return segmetrics.attachment_scores(rows, by).select(*by, F.col(key).alias("value"))

    return of


#: metric -> (pages with heads, vocabularies, configuration columns) -> value of each configuration.
LABELS = ("document_type", "layout_type", "functional_category")
METRICS: dict[str, Callable] = {
    **{f"{c}_{kind}": _over_vocabulary(c, f"predicted_{c}", c, kind) for c in LABELS for kind in ("macro_f1", "weighted_f1")},
    "start_page_f1": _start_f1, "pq": _pq, "uas": _attached("uas"), "las": _attached("las"),
}


def evaluated(pages: DataFrame, vocabularies: dict[str, DataFrame], by=("config",), names: list[str] | None = None) -> DataFrame:
    """by, metric, value for each configuration and metric of the registry; metrics of label columns that ``pages`` lacks are left out.

    ``pages`` hold truth and prediction of each configuration; they are segmented once.
    """
    by = tuple(by)
    able = [n for n in names or METRICS if not any(n.startswith(c) and f"predicted_{c}" not in pages.columns for c in LABELS)]
    seg = saved(segmetrics.both(pages, (*by, "dossier")))
    rows = [METRICS[n](seg, vocabularies, by).select(*by, F.lit(n).alias("metric"), F.col("value").cast("double")) for n in able]
    return reduce(DataFrame.unionByName, rows)


def _unpivoted(df: DataFrame, by, task: str, cells: list[tuple[str, str, str]], support: str) -> DataFrame:
    """by, task, metric, average, value, support of (metric, average, column) triples."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(a).alias("average"), F.col(c).cast("double").alias("value")) for m, a, c in cells])
    return df.select(*by, F.lit(task).alias("task"), F.explode(rows).alias("_r"), F.col(support).cast("long").alias("support")).select(*by, "task", "_r.metric", "_r.average", "_r.value", "support")


def metric_rows(pages: DataFrame, vocabularies: dict[str, DataFrame], by=("config",)) -> DataFrame:
    """by, task, metric, average, value, support: all figures of each configuration as one long table.

    A task is a label column that ``pages`` and ``vocabularies`` hold (accuracy, macro and weighted scores over the vocabulary, then uas and las), start_page or segmentation.
    """
    by = tuple(by)
    seg = saved(segmetrics.both(pages, (*by, "dossier")))
    out = []
    for c in [c for c in LABELS if c in vocabularies and f"predicted_{c}" in pages.columns]:
        known = seg.join(F.broadcast(vocabularies[c].select(F.col("label").alias(c))), c, "left_semi")  # a vocabulary
        whole = metrics.summary(metrics.per_class(metrics.confusion(known, c, f"predicted_{c}", by), by, vocabularies[c]), by)
        cells = [("accuracy", "overall", "accuracy")] + [(m, a, f"{a}_{m}") for a in ("macro", "weighted") for m in ("precision", "recall", "f1")]
        out.append(_unpivoted(whole, by, c, cells, "n"))
        attached = segmetrics.attachment_scores(segmetrics.attachment_rows(seg, c, f"predicted_{c}", (*by, "dossier")), by)
        out.append(_unpivoted(attached, by, c, [("uas", "", "uas"), ("las", "", "las")], "n_pages"))
    start = metrics.binary(seg, F.col("start_page") == "yes", F.col("predicted_start_page") == "yes", by)
    out.append(_unpivoted(start, by, "start_page", [(m, "binary", m) for m in ("precision", "recall", "f1")], "n"))
    pq = segmetrics.panoptic_quality(segmetrics.stream_quality(seg, (*by, "dossier")), by)
    out.append(_unpivoted(pq, by, "segmentation", [(m, "", m) for m in ("pq", "sq", "rq", "tp", "fp", "fn")], "n_streams"))
    return reduce(DataFrame.unionByName, out)


def masked_accuracy(rows: DataFrame, tasks: list[str], classes: dict[str, int], ignore: int = -100) -> DataFrame:
    """task, n, accuracy, macro_f1 of index columns (task, predicted_task) over the rows whose target isn't ``ignore`` or null.

    macro_f1 is the mean over all ``classes`` of a task, those without rows counting 0; without any row, n is 0 and both are null.
    """
    spark = rows.sparkSession
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("true"), F.col(f"predicted_{t}").alias("pred")) for t in tasks])).alias("_r")).select("_r.*")
    counts = long.filter(F.col("true").isNotNull() & (F.col("true") != ignore)).groupBy("task", "true", "pred").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(t, k) for t in tasks for k in range(classes[t])], "task string, class int")
    truth = counts.groupBy("task", F.col("true").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    given = counts.filter(F.col("pred").isNotNull()).groupBy("task", F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    per = every.join(truth, ["task", "class"], "left").join(given, ["task", "class"], "left").na.fill(0, ["support", "tp", "predicted"])
    n = F.sum("support")
    return per.groupBy("task").agg(n.alias("n"), F.when(n > 0, F.sum("tp") / n).alias("accuracy"), F.when(n > 0, F.avg(metrics.ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))).alias("macro_f1"))


def stale(configs: DataFrame, predictions: DataFrame, checkpoints: DataFrame, key: str = "config", force: bool = False) -> DataFrame:
    """Configurations that have to predict anew: without predictions or checkpoint, or with predictions older than it. The others' are evaluated as they are."""
    if force:
        return configs
    p, c = (df.groupBy(key).agg(F.max("modified").alias(n)) for df, n in ((predictions, "_p"), (checkpoints, "_c")))
    fresh = p.join(c, key).filter(F.col("_p") >= F.col("_c")).select(key)
    return configs.join(fresh, key, "left_anti")


def significance(values: DataFrame, weights: DataFrame, alpha: float = 0.05) -> DataFrame:
    """metric, top_config, other_config, top_value, other_value, diff, p_value, q_value, significant.

    values: metric, config, dossier, num, den (a metric is sum(num) / sum(den)); weights: draw, dossier, weight. Of each metric the best configuration (of equal ones the least
    name) is held against all others by a paired bootstrap, whose p values are adjusted within the metric.
    """
    ratio = lambda w: metrics.ratio(F.sum(F.col("num") * w), F.sum(F.col("den") * w))
    whole = values.groupBy("metric", "config").agg(ratio(F.lit(1)).alias("value"))
    top = whole.groupBy("metric").agg(F.min_by("config", F.struct(-F.col("value"), F.col("config"))).alias("top_config"), F.max("value").alias("top_value"))
    drawn = saved(values.join(weights, "dossier").groupBy("metric", "config", "draw").agg(ratio(F.col("weight")).alias("v")))
    best = drawn.withColumnsRenamed({"config": "top_config", "v": "t"})
    rows = drawn.join(top, "metric").filter("config <> top_config").join(best, ["metric", "top_config", "draw"]).join(whole, ["metric", "config"])
    turned = F.col("t") <= F.col("v")  # the top one is above all others as a whole
    p = rows.groupBy("metric", "top_config", "config", "top_value", "value").agg(F.avg(turned.cast("double")).alias("p_value"))
    q = metrics.benjamini_hochberg(p, "p_value", ("metric",))
    return q.select("metric", "top_config", F.col("config").alias("other_config"), "top_value", F.col("value").alias("other_value"), (F.col("top_value") - F.col("value")).alias("diff"),
                    "p_value", F.col("q").alias("q_value"), (F.col("q") < alpha).alias("significant"))


def fused_pairs(probabilities: DataFrame, models: DataFrame, keys=KEYS) -> DataFrame:
    """model, keys, probs, predicted of the late fusion of every image with every text model of ``models`` (model, modality, backbone).

    probabilities: model, keys, probs. A pair whose models don't have the same keys and numbers of classes is left out.
    """
    own = probabilities.join(models, "model")
    side = lambda m, s: own.filter(F.col("modality") == m).select(*keys, F.col("model").alias(f"_{s}"), F.col("backbone").alias(f"_b{s}"), F.col("probs").alias(f"_p{s}"))
    sizes = own.groupBy("modality", "model").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.filter("modality = 'vision'").select(F.col("model").alias("_v"), F.col("n").alias("_nv")).crossJoin(sizes.filter("modality = 'text'").select(F.col("model").alias("_t"), F.col("n").alias("_nt")))  # models squared
    met = side("vision", "v").join(side("text", "t"), list(keys))
    whole = met.groupBy("_v", "_t").agg(F.count_if(F.size("_pv") == F.size("_pt")).alias("_k")).join(pairs, ["_v", "_t"]).filter("_k = _nv and _k = _nt").select("_v", "_t")
    from quire.functions.scalars import argmax, model_name

    out = met.join(whole, ["_v", "_t"]).withColumn("probs", F.zip_with("_pv", "_pt", lambda x, y: (x + y) / 2))
    return out.select(model_name("late-fusion", F.col("_bv"), F.col("_bt")).alias("model"), *keys, "probs", argmax(F.col("probs")).alias("predicted"))


def dispatched(rows: DataFrame, config: dict, families: dict[str, Callable[[DataFrame, dict], DataFrame]]) -> DataFrame:
    """What the predictor of the configuration's family makes of the rows; an unknown family is an error that names those known."""
    family = config.get("model_family")
    if family not in families:
        raise ValueError(f"unknown model family {family!r}; there are {sorted(families)}")
    return families[family](rows, config)


def confusion_grid(counts: DataFrame, labels: list[str]) -> DataFrame:
    """Confusion counts as a grid: a row for each true label of a vocabulary, a column for each predicted one."""
    grid = counts.groupBy("true").pivot("pred", labels).agg(F.sum("n")).na.fill(0)
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("true"))
    return grid.filter(order > 0).withColumn("place", (order - 1).cast("int")).select("place", "true", *labels)


def mapping_lines(mapping: DataFrame, by: str = "annotator") -> DataFrame:
    """One line for each annotator: 'label -> mapped' of a mapping table, in order."""
    pair = F.concat(F.col("label"), F.lit(" -> "), F.col("mapped"))
    return mapping.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(pair)), "; ").alias("line"))  # a vocabulary


def model_grid(scores: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """A grid of models: one row for each ``row``, the values of ``column`` side by side."""
    return scores.groupBy(row).pivot(column, columns).agg(F.first(value))


def summaries(spark, pattern: str, delimiter: str = "\t") -> DataFrame:
    """All summary tables that a glob finds, one below the other, with the file each row is of."""
    return spark.read.option("header", True).option("sep", delimiter).option("inferSchema", True).csv(pattern).withColumn("file", F.input_file_name())


def presence(rows: DataFrame, counts: list[str]) -> DataFrame:
    """``rows`` with <count>_present: whether a count is above 0 (null for a null one)."""
    return rows.withColumns({f"{c}_present": F.col(c) > 0 for c in counts})


def pooled_back(pages: DataFrame, vector: str, by=("dossier",), seg: str = "seg", out: str = "pooled") -> DataFrame:
    """``pages`` with the mean vector of their segment, in double precision."""
    from quire.operators.segments import mean_pooled

    per = mean_pooled(pages, vector, by, seg).groupBy(*by, seg).agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("_m"))  # as many as a vector has components
    return pages.join(per, [*by, seg], "left").withColumn(out, F.transform("_m", lambda x: x["mean"])).drop("_m")


def lift(tables: DataFrame, prior: float = 1.0) -> DataFrame:
    """type_a, type_b, lift: how much oftener two types meet than by chance, of presence counts plus ``prior`` each."""
    n = {c: F.col(c) + F.lit(float(prior)) for c in ("n11", "n10", "n01", "n00")}
    total = n["n11"] + n["n10"] + n["n01"] + n["n00"]
    return tables.select("type_a", "type_b", (n["n11"] * total / ((n["n11"] + n["n10"]) * (n["n11"] + n["n01"]))).alias("lift"))


def split_report(rows: DataFrame, label: str, split: str = "split") -> DataFrame:
    """split, n, n_classes, n_unlabelled of each split."""
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("n_classes"), F.count_if(F.col(label).isNull()).alias("n_unlabelled"))


def task_labels(rows: DataFrame, task: str) -> DataFrame:
    """The labelled rows of a task, start_page or doc_type."""
    from quire.operators.manifest import start_labels, type_labels

    return dispatched(rows, {"model_family": task}, {"start_page": lambda r, _: start_labels(r), "doc_type": lambda r, _: type_labels(r)})


def missing_features(rows: DataFrame, cached: DataFrame, keys=KEYS, force: bool = False) -> DataFrame:
    """Rows whose features aren't cached yet: all of them if forced."""
    return rows if force else rows.join(cached.select(*keys), list(keys), "left_anti")
