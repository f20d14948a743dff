"""Segmentation metrics: panoptic quality, attachment scores, end-to-end document types, bootstrap.

Pages carry true and predicted heads; segments meet by an equality join of pages (they are in the same row), never pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import is_start
from quire.operators import metrics
from quire.operators.graph import saved
from quire.operators.segments import segmented

DOSSIER = ("dossier",)


def both(pages: DataFrame, by=DOSSIER, true: str = "start_page", pred: str = "predicted_start_page", rule: str = "trim") -> DataFrame:
    """true_seg, true_head, pred_seg, pred_head of each page, in one pass over the sequence."""
    return segmented(segmented(pages, true, by, rule=rule, prefix="true_"), pred, by, rule=rule, prefix="pred_")


def overlaps(pages: DataFrame, by=DOSSIER) -> DataFrame:
    """true_head, pred_head, shared, n_true, n_pred of segments that share pages. A null head (a page of one side only) counts for the other side's size."""
    met = pages.groupBy(*by, "true_head", "pred_head").agg(F.count(F.lit(1)).alias("shared"))
    from pyspark.sql import Window

    return met.withColumns({"n_true": F.sum("shared").over(Window.partitionBy(*by, "true_head")), "n_pred": F.sum("shared").over(Window.partitionBy(*by, "pred_head"))})


def stream_quality(pages: DataFrame, by=DOSSIER) -> DataFrame:
    """tp, fp, fn, sq, rq, pq of each sequence with true segments. A match shares more than half of the union."""
    o = overlaps(pages, by)
    union = F.col("n_true") + F.col("n_pred") - F.col("shared")
    known = F.col("true_head").isNotNull() & F.col("pred_head").isNotNull()
    hit = known & (2 * F.col("shared") > union)
    s = o.groupBy(*by).agg(
        F.count_if(hit).alias("tp"), F.sum(F.when(hit, F.col("shared") / union)).alias("iou"),
        F.count_distinct("true_head").alias("t"), F.count_distinct("pred_head").alias("p")).filter("t > 0")
    tp = F.col("tp")
    s = s.withColumns({"fp": F.col("p") - tp, "fn": F.col("t") - tp, "sq": metrics.ratio(F.coalesce("iou", F.lit(0.0)), tp)})
    s = s.withColumn("rq", tp / (tp + 0.5 * F.col("fp") + 0.5 * F.col("fn")))
    return s.select(*by, "tp", "fp", "fn", "sq", "rq", (F.col("sq") * F.col("rq")).alias("pq"))


def panoptic_quality(streams: DataFrame, by=()) -> DataFrame:
    """pq, sq, rq as means over sequences; tp, fp, fn as totals."""
    avg = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("pq", "sq", "rq")]
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    return streams.groupBy(*by).agg(*avg, *total, F.count(F.lit(1)).alias("n_streams"))


def attachment_rows(pages: DataFrame, label: str | None, pred_label: str | None, by=DOSSIER) -> DataFrame:
    """n_pages, n_uas, n_las of each sequence. A page is attached if its heads are the same, and labelled if the segments' commonest labels are too (two missing ones are the same)."""
    from pyspark.sql import Window

    if label is not None:
        pages = pages.withColumns({
            "_t": F.mode(label, True).over(Window.partitionBy(*by, "true_head")), "_p": F.mode(pred_label, True).over(Window.partitionBy(*by, "pred_head"))})
    same = F.coalesce(F.col("true_head") == F.col("pred_head"), F.lit(False))
    las = same & F.col("_t").eqNullSafe(F.col("_p")) if label is not None else same
    return pages.filter("true_head is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(same).alias("n_uas"), F.count_if(las).alias("n_las"))


def attachment_scores(rows: DataFrame, by=()) -> DataFrame:
    n = F.sum("n_pages")
    return rows.groupBy(*by).agg(metrics.ratio(F.sum("n_uas"), n).alias("uas"), metrics.ratio(F.sum("n_las"), n).alias("las"), n.alias("n_pages"))


def end_to_end(pages: DataFrame, classes: DataFrame, by=()) -> DataFrame:
    """Confusion counts of document types over all true starts of known type: a start that wasn't predicted, or with an unknown type, has a null prediction."""
    known = F.broadcast(classes.select("label"))  # a vocabulary
    pred = pages.join(known.select(F.col("label").alias("predicted_document_type"), F.lit(True).alias("_known")), "predicted_document_type", "left")
    right = is_start(F.col("predicted_start_page"), "lower") & F.col("_known").isNotNull()
    scored = pred.filter(is_start(F.col("start_page"), "lower")).join(known.select(F.col("label").alias("document_type")), "document_type", "left_semi")
    return metrics.confusion(scored.withColumn("_pred", F.when(right, F.col("predicted_document_type"))), "document_type", "_pred", by)


def detection_conditional(pages: DataFrame, classes: DataFrame, by=()) -> DataFrame:
    """n, detected and end_to_end (shares of true starts of known type), conditional (accuracy on the detected ones)."""
    scored = pages.filter(is_start(F.col("start_page"), "lower")).join(F.broadcast(classes.select(F.col("label").alias("document_type"))), "document_type", "left_semi")
    found = is_start(F.col("predicted_start_page"), "lower")
    right = F.coalesce(F.col("document_type") == F.col("predicted_document_type"), F.lit(False))
    n, d = F.count(F.lit(1)), F.count_if(found)
    return scored.groupBy(*by).agg(n.alias("n"), metrics.ratio(d, n).alias("detected"), metrics.ratio(F.count_if(found & right), n).alias("end_to_end"), metrics.ratio(F.count_if(found & right), d).alias("conditional"))


def pair_metrics(pages: DataFrame, classes: DataFrame, by: list[str], score: str | None = None) -> DataFrame:
    """All metrics of each configuration (``by``, not empty): start, end to end, panoptic, attachment.

    Pages are segmented once, and those of the same pair of segments, labels and flags become one row of counts, which is written. All sums of a sequence follow from these in one pass,
    and configurations are sums over sequences and over pairs of labels.
    """
    from pyspark.sql import Window

    seq = (*by, "dossier")
    known = F.broadcast(classes.select(F.col("label").alias("_label"), F.lit(True).alias("_in")))  # a vocabulary
    seg = both(pages, seq).withColumns({"_t": is_start(F.col("start_page"), "lower"), "_p": is_start(F.col("predicted_start_page"), "lower")})
    cells = saved(seg.groupBy(*seq, "true_head", "pred_head", "document_type", "predicted_document_type", "_t", "_p").agg(F.count(F.lit(1)).alias("k")))

    def sums(keys, order=None):
        w = Window.partitionBy(*seq, *keys)
        return w.orderBy(*order) if order else w

    # the commonest label of a segment, the least of several, on its first row of counts
    labelled = cells
    for head, label, out in (("true_head", "document_type", "_tl"), ("pred_head", "predicted_document_type", "_pl")):
        labelled = labelled.withColumn("_n", F.when(F.col(label).isNotNull(), F.sum("k").over(sums([head, label])))).withColumn(out, F.first(label).over(sums([head], [F.col("_n").desc_nulls_last(), F.col(label).asc_nulls_last()])))
    met = ["true_head", "pred_head"]
    labelled = labelled.withColumns({"_shared": F.sum("k").over(sums(met)), "_nt": F.sum("k").over(sums(["true_head"])), "_np": F.sum("k").over(sums(["pred_head"])),
                                     "_first": F.row_number().over(sums(met, ["document_type", "predicted_document_type", "_t", "_p"])) == 1})
    union = F.col("_nt") + F.col("_np") - F.col("_shared")
    both_known = F.col("true_head").isNotNull() & F.col("pred_head").isNotNull()
    hit = F.col("_first") & both_known & (2 * F.col("_shared") > union)
    same = F.coalesce(F.col("true_head") == F.col("pred_head"), F.lit(False)) & F.col("true_head").isNotNull()
    of = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    t, p = F.coalesce("_t", F.lit(False)), F.coalesce("_p", F.lit(False))
    streams = labelled.groupBy(*seq).agg(
        F.count_if(hit).alias("tp"), F.coalesce(F.sum(F.when(hit, F.col("_shared") / union)), F.lit(0.0)).alias("iou"), F.count_distinct("true_head").alias("t"), F.count_distinct("pred_head").alias("p"),
        of(F.col("true_head").isNotNull()).alias("n_pages"), of(same).alias("n_uas"), of(same & F.col("_tl").eqNullSafe(F.col("_pl"))).alias("n_las"),
        of(t & p).alias("tt"), of(t & ~p).alias("tf"), of(~t & p).alias("ft"), of(~t & ~p).alias("ff"))
    tp = F.col("tp")
    one = F.when(F.col("t") > 0, 1)
    streams = streams.withColumns({"fp": F.col("p") - tp, "fn": F.col("t") - tp, "sq": metrics.ratio(F.col("iou"), tp)})
    streams = streams.withColumn("rq", tp / (tp + 0.5 * F.col("fp") + 0.5 * F.col("fn")))
    mean = lambda c: F.coalesce(F.avg(F.when(one == 1, c)), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(F.when(one == 1, F.col(c))), F.lit(0)).cast("long")
    n = F.sum("n_pages")
    out = streams.groupBy(*by).agg(
        mean(F.col("sq") * F.col("rq")).alias("pq"), mean(F.col("sq")).alias("sq"), mean(F.col("rq")).alias("rq"), total("tp").alias("pq_tp"), total("fp").alias("pq_fp"), total("fn").alias("pq_fn"), F.count(one).alias("pq_n_streams"),
        metrics.ratio(F.sum("n_uas"), n).alias("uas"), metrics.ratio(F.sum("n_las"), n).alias("las"), n.alias("n_pages_scored"), *[F.sum(c).alias(f"_{c}") for c in ("tt", "tf", "ft", "ff")]).filter("pq_n_streams > 0 OR n_pages_scored > 0")
    flags = F.array(*[F.struct(F.lit(a).alias("true"), F.lit(b).alias("pred"), F.col(f"_{c}").alias("n")) for a, b, c in ((True, True, "tt"), (True, False, "tf"), (False, True, "ft"), (False, False, "ff"))])
    out = saved(out)
    start = metrics.summary(metrics.per_class(out.select(*by, F.explode(flags).alias("f")).select(*by, "f.*").filter("n > 0"), by), by)
    start = start.select(*by, F.col("macro_precision").alias("start_macro_precision"), F.col("macro_recall").alias("start_macro_recall"), F.col("macro_f1").alias("start_macro_f1"), F.col("accuracy").alias("start_accuracy"))
    typed = cells.groupBy(*by, "document_type", "predicted_document_type", "_t", "_p").agg(F.sum("k").alias("n"))
    typed = typed.join(known.withColumnsRenamed({"_label": "document_type", "_in": "_kt"}), "document_type").join(known.withColumnsRenamed({"_label": "predicted_document_type", "_in": "_kp"}), "predicted_document_type", "left")
    typed = saved(typed)  # vocabularies squared
    scored = typed.filter("_kp").groupBy(*by).agg(F.sum("n").alias("n_doctype_pages_scored"))
    counts = typed.filter("_t").groupBy(*by, F.col("document_type").alias("true"), F.when(F.col("_p") & F.col("_kp").isNotNull(), F.col("predicted_document_type")).alias("pred")).agg(F.sum("n").alias("n"))
    doc = metrics.summary(metrics.per_class(counts, by, classes), by)
    doc = doc.select(*by, F.col("accuracy").alias("doc_accuracy_e2e"), F.col("macro_f1").alias("doc_macro_f1_e2e"), F.col("weighted_f1").alias("doc_weighted_f1_e2e"), F.col("n").alias("n_true_start_pages"))
    out = out.drop("_tt", "_tf", "_ft", "_ff").join(start, by).join(doc, by, "left").join(scored, by, "left").na.fill(0, ["n_doctype_pages_scored"])
    if score is not None:
        auc = metrics.roc_auc(pages.withColumn("_t", is_start(F.col("start_page"), "lower")), F.col("_t"), score, by)
        out = out.join(auc.withColumnRenamed("auc", "start_roc_auc"), by, "left")
    return out


def bootstrap_weights(dossiers: DataFrame, draws: int, seed: str) -> DataFrame:
    """draw, dossier, weight: how often a dossier is drawn, with replacement, as many as there are; those drawn at least once.

    ``dossiers`` has the columns dossier and place (from 0, without gaps). Place i of a draw goes to the dossier of a hashed place.
    """
    from quire.functions.hashing import uniform

    n = dossiers.agg(F.count(F.lit(1)).alias("_n"))
    draw = dossiers.sparkSession.range(draws).select(F.col("id").alias("draw"))
    picks = dossiers.select(F.col("place").alias("i")).crossJoin(draw).crossJoin(F.broadcast(n))  # one statistic a dossier, times draws
    picks = picks.select("draw", F.floor(uniform(F.lit(seed), "draw", "i") * F.col("_n")).cast("long").alias("place"))
    return picks.groupBy("draw", "place").agg(F.count(F.lit(1)).alias("weight")).join(dossiers.select("place", "dossier"), "place").select("draw", "dossier", "weight")


def paired_bootstrap(values: DataFrame, weights: DataFrame, top: str) -> DataFrame:
    """model, top_value, value, p of each model against ``top``: the share of draws in which the difference of the weighted means vanishes or turns round.

    values: model, dossier, num, den. A metric is sum(num) / sum(den), so resampled pages needn't be copied: weights multiply.
    """
    metric = lambda w: metrics.ratio(F.sum(F.col("num") * w), F.sum(F.col("den") * w))
    whole = values.groupBy("model").agg(metric(F.lit(1)).alias("value"))
    drawn = values.join(weights, "dossier").groupBy("model", "draw").agg(metric(F.col("weight")).alias("v"))
    best = whole.filter(F.col("model") == top).select(F.col("value").alias("top_value"))
    others = whole.filter(F.col("model") != top).crossJoin(F.broadcast(best))  # one row
    diff = drawn.join(drawn.filter(F.col("model") == top).select("draw", F.col("v").alias("t")), "draw").join(others, "model").withColumn("d", F.col("t") - F.col("v"))
    turned = F.when(F.col("top_value") >= F.col("value"), F.col("d") <= 0).otherwise(F.col("d") >= 0)
    return diff.groupBy("model", "top_value", "value").agg(F.avg(turned.cast("double")).alias("p"))
