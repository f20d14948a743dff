"""Segments, heads, carried labels, and how well they are predicted."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.scalars import is_start
from quire.operators import metrics, segments, segmetrics
from quire.operators.ranking import numbered
from quire.queries.registry import labels, query, rounded
from quire.sources import fixture_sql as S
from quire.sources import fixtures as X


@query("segments_from_start", f"WITH {S.CONVERSATIONS} SELECT dossier, true_seg AS seg, min(page_num) AS head, count(*) AS n_pages FROM ch GROUP BY 1, 2")
def segments_from_start(spark, d):
    return segments.segments(segments.segmented(X.conversation_pages(spark, d)))


@query("segments_from_lines", f"WITH {S.LINES} SELECT dossier, true_seg AS seg, min(page_num) AS head, count(*) AS n_pages FROM lh GROUP BY 1, 2")
def segments_from_lines(spark, d):
    return segments.segments(segments.segmented(X.line_pages(spark, d)))


@query("resegmented_ids", f"WITH {S.SEGMENTED} SELECT dossier, page_num, dossier || '::rseg' || pred_seg AS segment_id FROM es")
def resegmented_ids(spark, d):
    out = segments.segmented(X.event_pages(spark, d), "predicted_start_page", rule="exact")
    return out.select("dossier", "page_num", F.concat("dossier", F.lit("::rseg"), F.col("seg").cast("string")).alias("segment_id"))


@query("segments_norm_position", f"WITH {S.DOCUMENTS} SELECT dossier, seg, order_in_dossier, n_segments, round(norm_position, 8) AS norm_position FROM docs")
def segments_norm_position(spark, d):
    return rounded(_documents(spark, d).select("dossier", "seg", "order_in_dossier", "n_segments", "norm_position"))


def _documents(spark, d):
    pages = segments.segmented(X.event_pages(spark, d), "predicted_start_page")
    return segments.documents(pages, "predicted_document_type", "document_type_confidence")


@query("segment_majority_conf", f"WITH {S.DOCUMENTS} SELECT dossier, seg, n_pages, first_page, type, round(mean_confidence, 8) AS mean_confidence FROM docs")
def segment_majority_conf(spark, d):
    return rounded(_documents(spark, d).select("dossier", "seg", "n_pages", "first_page", "type", "mean_confidence"))


@query("segment_mode_label", f"WITH {S.CONVERSATIONS} SELECT dossier, true_seg AS seg, min(page_num) AS head, mode(document_type ORDER BY document_type) AS label FROM ch GROUP BY 1, 2")
def segment_mode_label(spark, d):
    return segments.labelled(segments.segmented(X.conversation_pages(spark, d)), "document_type")


@query("head_page_lookup", f"WITH {S.SEGMENTED} SELECT dossier, page_num, true_head, pred_head FROM eh")
def head_page_lookup(spark, d):
    return segmetrics.both(X.event_pages(spark, d)).select("dossier", "page_num", "true_head", "pred_head")


@query("heads_from_segment_ids", f"WITH {S.SEGMENTED} SELECT dossier, page_num, pred_head AS head FROM eh")
def heads_from_segment_ids(spark, d):
    pages = segments.segmented(X.event_pages(spark, d), "predicted_start_page").drop("head")
    return segments.heads_from_ids(pages, "seg").select("dossier", "page_num", "head")


@query("carry_forward", f"WITH {S.SEGMENTED} SELECT a.dossier, a.page_num, b.predicted_document_type AS carried, b.document_type_confidence AS confidence FROM eh a JOIN eh b ON a.dossier = b.dossier AND a.pred_head = b.page_num")
def carry_forward(spark, d):
    pages = segments.segmented(X.event_pages(spark, d), "predicted_start_page")
    return pages.select("dossier", "page_num", segments.carried("predicted_document_type").alias("carried"), segments.carried("document_type_confidence").alias("confidence"))


@query("predict_two_stage", f"""WITH {S.SEGMENTED} SELECT a.dossier, a.page_num, a.predicted_start_page, round(greatest(a.start_probability, 1 - a.start_probability), 6) AS start_page_confidence, a.pred_head AS predicted_segment_id,
  CASE WHEN b.predicted_start_page = 'yes' THEN b.predicted_document_type END AS predicted_document_type, CASE WHEN b.predicted_start_page = 'yes' THEN b.document_type_confidence END AS document_type_confidence
  FROM eh a JOIN eh b ON a.dossier = b.dossier AND a.pred_head = b.page_num""")
def predict_two_stage(spark, d):
    pages = X.event_pages(spark, d).withColumn("start_score", X.start_score(F.col("predicted_start_page")))
    types = pages.select("dossier", "page_num", "predicted_document_type", "document_type_confidence")
    # The probability as given decides; its six digits, which are shown, can be 0.5 on either side.
    base = pages.select("dossier", "page_num", "start_probability", "start_score")
    out = segments.predicted_documents(base, "start_score", lambda heads: heads.select("dossier", "page_num").join(types, ["dossier", "page_num"]))
    out = out.withColumn("start_page_confidence", F.greatest("start_probability", 1 - F.col("start_probability")))
    return rounded(out.select("dossier", "page_num", "predicted_start_page", "start_page_confidence", "predicted_segment_id", "predicted_document_type", "document_type_confidence"), 6)


_STREAM = """
ov AS (SELECT dossier, true_head, pred_head, count(*) AS i FROM {pages} GROUP BY 1, 2, 3),
oz AS (SELECT *, sum(i) OVER (PARTITION BY dossier, true_head) AS nt, sum(i) OVER (PARTITION BY dossier, pred_head) AS np FROM ov),
st0 AS (SELECT dossier, count(*) FILTER (2 * i > nt + np - i) AS tp, sum(i / (nt + np - i)) FILTER (2 * i > nt + np - i) AS iou, count(DISTINCT true_head) AS t, count(DISTINCT pred_head) AS p FROM oz GROUP BY 1),
st1 AS (SELECT dossier, tp, p - tp AS fp, t - tp AS fn, CASE WHEN tp = 0 THEN 0 ELSE iou / tp END AS sq FROM st0),
st AS (SELECT *, tp / (tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn) AS rq, sq * tp / (tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn) AS pq FROM st1)"""
_PQ = "SELECT round(avg(pq), 8) AS pq, round(avg(sq), 8) AS sq, round(avg(rq), 8) AS rq, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) AS n_streams FROM st"


@query("panoptic_per_stream", f"WITH {S.CONVERSATIONS}, {_STREAM.format(pages='ch')} SELECT dossier, tp, fp, fn, round(sq, 8) AS sq, round(rq, 8) AS rq, round(pq, 8) AS pq FROM st")
def panoptic_per_stream(spark, d):
    return rounded(segmetrics.stream_quality(segmetrics.both(X.conversation_pages(spark, d))))


@query("panoptic_quality", f"WITH {S.CONVERSATIONS}, {_STREAM.format(pages='ch')} {_PQ}")
def panoptic_quality(spark, d):
    return rounded(segmetrics.panoptic_quality(segmetrics.stream_quality(segmetrics.both(X.conversation_pages(spark, d)))))


@query("panoptic_quality_lines", f"WITH {S.LINES}, {_STREAM.format(pages='lh')} {_PQ}")
def panoptic_quality_lines(spark, d):
    return rounded(segmetrics.panoptic_quality(segmetrics.stream_quality(segmetrics.both(X.line_pages(spark, d)))))


@query("panoptic_quality_events", f"WITH {S.SEGMENTED}, {_STREAM.format(pages='eh')} {_PQ}")
def panoptic_quality_events(spark, d):
    return rounded(segmetrics.panoptic_quality(segmetrics.stream_quality(segmetrics.both(X.event_pages(spark, d)))))


_ATT = """
tl AS (SELECT dossier, true_head, mode(document_type ORDER BY document_type) AS t FROM eh GROUP BY 1, 2), pl AS (SELECT dossier, pred_head, mode(predicted_document_type ORDER BY predicted_document_type) AS p FROM eh GROUP BY 1, 2),
aa AS (SELECT eh.dossier, eh.true_head = eh.pred_head AS uas, eh.true_head = eh.pred_head AND t IS NOT DISTINCT FROM p AS las FROM eh JOIN tl USING (dossier, true_head) JOIN pl USING (dossier, pred_head))"""


@query("attachment_scores", f"WITH {S.SEGMENTED}, {_ATT} SELECT round(avg(uas::INT), 8) AS uas, round(avg(las::INT), 8) AS las, count(*) AS n_pages FROM aa")
def attachment_scores(spark, d):
    pages = segmetrics.both(X.event_pages(spark, d))
    return rounded(segmetrics.attachment_scores(segmetrics.attachment_rows(pages, "document_type", "predicted_document_type")))


_E2E = f"""
sc AS (SELECT document_type AS "true", CASE WHEN predicted_start_page = 'yes' THEN predicted_document_type END AS pred FROM ep WHERE start_page = 'yes')"""
_REPORT = """
cl AS (SELECT type AS class FROM types),
pc AS (SELECT class, (SELECT count(*) FROM sc WHERE "true" = class AND pred = class) AS tp, (SELECT count(*) FROM sc WHERE "true" = class) AS support, (SELECT count(*) FROM sc WHERE pred = class) AS predicted FROM cl),
pr AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
              CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1, support, tp FROM pc)"""
_SUMMARY = """SELECT round(sum(tp) / sum(support), 8) AS accuracy, round(avg(precision), 8) AS macro_precision, round(avg(recall), 8) AS macro_recall, round(avg(f1), 8) AS macro_f1,
  round(sum(precision * support) / sum(support), 8) AS weighted_precision, round(sum(recall * support) / sum(support), 8) AS weighted_recall, round(sum(f1 * support) / sum(support), 8) AS weighted_f1, count(*) AS n_classes, sum(support)::BIGINT AS n FROM pr"""


@query("doc_type_e2e", f"WITH {S.EVENTS}, {_E2E}, {_REPORT} {_SUMMARY}")
def doc_type_e2e(spark, d):
    known = labels(spark, X.EVENT_TYPES)
    return rounded(metrics.summary(metrics.per_class(segmetrics.end_to_end(X.event_pages(spark, d), known), classes=known)))


@query("doc_type_e2e_per_class", f"WITH {S.EVENTS}, {_E2E}, {_REPORT} SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support, tp FROM pr")
def doc_type_e2e_per_class(spark, d):
    known = labels(spark, X.EVENT_TYPES)
    return rounded(metrics.per_class(segmetrics.end_to_end(X.event_pages(spark, d), known), classes=known))


@query("detection_conditional", f"""WITH {S.EVENTS} SELECT count(*) AS n, round(avg((predicted_start_page = 'yes')::INT), 8) AS detected, round(avg((predicted_start_page = 'yes' AND document_type = predicted_document_type)::INT), 8) AS end_to_end,
  round(count(*) FILTER (predicted_start_page = 'yes' AND document_type = predicted_document_type) / count(*) FILTER (predicted_start_page = 'yes'), 8) AS conditional FROM ep WHERE start_page = 'yes'""")
def detection_conditional(spark, d):
    return rounded(segmetrics.detection_conditional(X.event_pages(spark, d), labels(spark, X.EVENT_TYPES)))


_ALL = '''sc AS (SELECT document_type AS "true", predicted_document_type AS pred FROM ep)'''


@query("confusion_dense", f"WITH {S.EVENTS}, {_ALL} SELECT a.type AS true, b.type AS pred, count(sc.true) AS n FROM types a CROSS JOIN types b LEFT JOIN sc ON sc.true = a.type AND sc.pred = b.type GROUP BY 1, 2")
def confusion_dense(spark, d):
    counts = metrics.confusion(X.event_pages(spark, d), "document_type", "predicted_document_type")
    return metrics.dense_confusion(counts, labels(spark, X.EVENT_TYPES))


@query("per_class_report", f"""WITH {S.EVENTS}, {_ALL}, {_REPORT}, sm AS ({_SUMMARY})
  SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM pr
  UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, n FROM sm UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, n FROM sm""")
def per_class_report(spark, d):
    counts = metrics.confusion(X.event_pages(spark, d), "document_type", "predicted_document_type")
    return rounded(metrics.report_rows(metrics.per_class(counts)))


@query("macro_weighted_f1", f"WITH {S.EVENTS}, {_ALL}, {_REPORT} {_SUMMARY}")
def macro_weighted_f1(spark, d):
    return rounded(metrics.summary(metrics.per_class(metrics.confusion(X.event_pages(spark, d), "document_type", "predicted_document_type"))))


_VOCAB = ["click", "error", "never", "view"]


@query("macro_report_vocabulary", f"""WITH {S.EVENTS.replace(f'unnest({X.EVENT_TYPES!r})', f'unnest({_VOCAB!r})')}, sc AS (SELECT document_type AS "true", predicted_document_type AS pred FROM ep WHERE document_type IN (SELECT type FROM types)), {_REPORT} {_SUMMARY}""")
def macro_report_vocabulary(spark, d):
    known = labels(spark, _VOCAB)
    return rounded(metrics.summary(metrics.per_class(metrics.confusion(X.event_pages(spark, d), "document_type", "predicted_document_type"), classes=known)))


@query("start_binary_report", f"""WITH {S.CONVERSATIONS}, b AS (SELECT count(*) FILTER (start_page = 'yes' AND predicted_start_page = 'yes') AS tp, count(*) FILTER (start_page = 'no' AND predicted_start_page = 'yes') AS fp,
  count(*) FILTER (start_page = 'yes' AND predicted_start_page = 'no') AS fn, count(*) AS n FROM cp)
  SELECT round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round((n - fp - fn) / n, 8) AS accuracy, tp, fp, fn, n FROM b""")
def start_binary_report(spark, d):
    return rounded(metrics.binary(X.conversation_pages(spark, d), is_start(F.col("start_page")), is_start(F.col("predicted_start_page"))))


@query("start_macro_report", f'''WITH {S.CONVERSATIONS}, types AS (SELECT unnest(['yes', 'no']) AS type), sc AS (SELECT start_page AS "true", predicted_start_page AS pred FROM cp), {_REPORT} {_SUMMARY}''')
def start_macro_report(spark, d):
    return rounded(metrics.summary(metrics.per_class(metrics.confusion(X.conversation_pages(spark, d), "start_page", "predicted_start_page"))))


@query("roc_auc", f"""WITH {S.EVENTS}, r AS (SELECT start_page = 'yes' AS y, rank() OVER (ORDER BY round(start_probability, 2)) + (count(*) OVER (PARTITION BY round(start_probability, 2)) - 1) / 2 AS rk FROM ep)
  SELECT round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 8) AS auc FROM r""")
def roc_auc(spark, d):
    pages = X.event_pages(spark, d).withColumn("s", F.round("start_probability", 2))
    return rounded(metrics.roc_auc(pages, F.col("start_page") == "yes", "s"))


def _variants(spark, d):
    """Two configurations side by side: the predictions as they are, and those with every start predicted."""
    pages = X.event_pages(spark, d)
    return pages.withColumn("pair", F.lit("a")).unionByName(pages.withColumn("predicted_start_page", F.lit("yes")).withColumn("pair", F.lit("b")))


@query("pair_metrics", f"""WITH {S.SEGMENTED}, v AS (SELECT 'a' AS pair, * FROM eh UNION ALL SELECT 'b', * REPLACE ('yes' AS predicted_start_page, page_num AS pred_head, page_num - 1 AS pred_seg) FROM eh),
  ov AS (SELECT pair, dossier, true_head, pred_head, count(*) AS i FROM v GROUP BY ALL),
  oz AS (SELECT *, sum(i) OVER (PARTITION BY pair, dossier, true_head) AS nt, sum(i) OVER (PARTITION BY pair, dossier, pred_head) AS np FROM ov),
  s0 AS (SELECT pair, dossier, count(*) FILTER (2 * i > nt + np - i) AS tp, coalesce(sum(i / (nt + np - i)) FILTER (2 * i > nt + np - i), 0) AS iou, count(DISTINCT true_head) AS t, count(DISTINCT pred_head) AS p FROM oz GROUP BY ALL),
  q AS (SELECT pair, avg(iou / (0.5::DOUBLE * (t + p))) AS pq, avg(CASE WHEN tp = 0 THEN 0 ELSE iou / tp END) AS sq, avg(tp / (0.5::DOUBLE * (t + p))) AS rq, sum(tp)::BIGINT AS pq_tp, sum(p - tp)::BIGINT AS pq_fp, sum(t - tp)::BIGINT AS pq_fn, count(*) AS pq_n_streams FROM s0 GROUP BY 1),
  tl AS (SELECT pair, dossier, true_head, mode(document_type ORDER BY document_type) AS tl FROM v GROUP BY ALL), pl AS (SELECT pair, dossier, pred_head, mode(predicted_document_type ORDER BY predicted_document_type) AS pl FROM v GROUP BY ALL),
  a AS (SELECT pair, avg((true_head = pred_head)::INT) AS uas, avg((true_head = pred_head AND tl = pl)::INT) AS las, count(*) AS n_pages_scored FROM v JOIN tl USING (pair, dossier, true_head) JOIN pl USING (pair, dossier, pred_head) GROUP BY 1),
  sc AS (SELECT pair, c, count(*) FILTER (start_page = c AND predicted_start_page = c) AS tp, count(*) FILTER (start_page = c) AS su, count(*) FILTER (predicted_start_page = c) AS pr FROM v, (SELECT unnest(['yes', 'no']) AS c) GROUP BY ALL),
  g AS (SELECT pair, avg(CASE WHEN pr = 0 THEN 0 ELSE tp / pr END) AS start_macro_precision, avg(CASE WHEN su = 0 THEN 0 ELSE tp / su END) AS start_macro_recall, avg(2 * tp / (su + pr)) AS start_macro_f1, sum(tp) / sum(su) AS start_accuracy FROM sc WHERE su + pr > 0 GROUP BY 1),
  dc AS (SELECT pair, type, count(*) FILTER (document_type = type AND predicted_document_type = type AND predicted_start_page = 'yes') AS tp, count(*) FILTER (document_type = type) AS su, count(*) FILTER (predicted_document_type = type AND predicted_start_page = 'yes') AS pr FROM v, types WHERE start_page = 'yes' GROUP BY ALL),
  e AS (SELECT pair, sum(tp) / sum(su) AS doc_accuracy_e2e, avg(CASE WHEN su + pr = 0 THEN 0 ELSE 2 * tp / (su + pr) END) AS doc_macro_f1_e2e, sum(CASE WHEN su + pr = 0 THEN 0 ELSE 2 * tp / (su + pr) END * su) / sum(su) AS doc_weighted_f1_e2e, sum(su)::BIGINT AS n_true_start_pages FROM dc GROUP BY 1),
  k AS (SELECT pair, count(*) AS n_doctype_pages_scored FROM v WHERE document_type IN (SELECT type FROM types) AND predicted_document_type IN (SELECT type FROM types) GROUP BY 1),
  rr AS (SELECT pair, start_page = 'yes' AS y, rank() OVER (PARTITION BY pair ORDER BY round(start_probability, 2)) + (count(*) OVER (PARTITION BY pair, round(start_probability, 2)) - 1) / 2 AS rk FROM v),
  ra AS (SELECT pair, (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS start_roc_auc FROM rr GROUP BY 1)
  SELECT pair, pq_tp, pq_fp, pq_fn, pq_n_streams, n_pages_scored, n_true_start_pages, n_doctype_pages_scored, round(pq, 8) AS pq, round(sq, 8) AS sq, round(rq, 8) AS rq, round(uas, 8) AS uas, round(las, 8) AS las, round(start_macro_precision, 8) AS start_macro_precision, round(start_macro_recall, 8) AS start_macro_recall, round(start_macro_f1, 8) AS start_macro_f1, round(start_accuracy, 8) AS start_accuracy, round(doc_accuracy_e2e, 8) AS doc_accuracy_e2e, round(doc_macro_f1_e2e, 8) AS doc_macro_f1_e2e, round(doc_weighted_f1_e2e, 8) AS doc_weighted_f1_e2e, round(start_roc_auc, 8) AS start_roc_auc
  FROM q JOIN a USING (pair) JOIN e USING (pair) JOIN g USING (pair) JOIN k USING (pair) JOIN ra USING (pair)""")
def pair_metrics(spark, d):
    pages = _variants(spark, d).withColumn("s", F.round("start_probability", 2))
    return rounded(segmetrics.pair_metrics(pages, labels(spark, X.EVENT_TYPES), ["pair"], "s"))


@query("pair_leaderboard", f"WITH {S.SEGMENTED}, v AS (SELECT 'a' AS pair, (true_head = pred_head)::INT AS ok FROM eh UNION ALL SELECT 'b', (true_head = page_num)::INT FROM eh), m AS (SELECT pair, round_even(avg(ok), 4) AS uas FROM v GROUP BY 1) SELECT pair, uas, row_number() OVER (ORDER BY uas DESC, pair) AS place FROM m")
def pair_leaderboard(spark, d):
    from quire.plans.jobs import leaderboard

    pages = segmetrics.both(_variants(spark, d), ("pair", "dossier"))
    scores = segmetrics.attachment_scores(segmetrics.attachment_rows(pages, None, None, ("pair", "dossier")), ("pair",)).select("pair", "uas")
    return leaderboard(scores, [("uas", True), ("pair", False)])


_BW = f"""
pl AS (SELECT dossier, row_number() OVER (ORDER BY dossier) - 1 AS place FROM (SELECT DISTINCT dossier FROM ep)),
nd AS (SELECT count(*) AS n FROM pl),
pk AS (SELECT draw, floor({S.u("'boot'", 'draw', 'place')} * n)::BIGINT AS place FROM pl, nd, range(0, 50) r(draw)),
wt AS (SELECT draw, pl.dossier, count(*) AS weight FROM pk JOIN pl USING (place) GROUP BY 1, 2)"""


def _places(pages):
    return numbered(pages.select("dossier").distinct(), ["dossier"])


@query("bootstrap_weights", f"WITH {S.EVENTS}, {_BW} SELECT draw, dossier, weight FROM wt")
def bootstrap_weights(spark, d):
    return segmetrics.bootstrap_weights(_places(X.event_pages(spark, d)), 50, "boot")


@query("bootstrap_paired", f"""WITH {S.SEGMENTED}, {_BW},
  v AS (SELECT 'a' AS model, dossier, count(*) FILTER (true_head = pred_head) AS num, count(*) AS den FROM eh GROUP BY 2 UNION ALL SELECT 'b', dossier, count(*) FILTER (true_head = page_num), count(*) FROM eh GROUP BY 2),
  w AS (SELECT model, sum(num) / sum(den) AS value FROM v GROUP BY 1), dr AS (SELECT model, draw, sum(num * weight) / sum(den * weight) AS x FROM v JOIN wt USING (dossier) GROUP BY 1, 2)
  SELECT 'b' AS model, round(a.value, 8) AS top_value, round(b.value, 8) AS value, round(avg((CASE WHEN a.value >= b.value THEN da.x - db.x <= 0 ELSE da.x - db.x >= 0 END)::INT), 8) AS p
  FROM w a, w b, dr da, dr db WHERE a.model = 'a' AND b.model = 'b' AND da.model = 'a' AND db.model = 'b' AND da.draw = db.draw GROUP BY a.value, b.value""")
def bootstrap_paired(spark, d):
    pages = segmetrics.both(_variants(spark, d), ("pair", "dossier"))
    values = segmetrics.attachment_rows(pages, None, None, ("pair", "dossier")).select(F.col("pair").alias("model"), "dossier", F.col("n_uas").alias("num"), F.col("n_pages").alias("den"))
    weights = segmetrics.bootstrap_weights(_places(X.event_pages(spark, d)), 50, "boot")
    return rounded(segmetrics.paired_bootstrap(values, weights, "a"))


@query("bh_fdr", f"""WITH p AS (SELECT event_type AS family, event_id, {S.u('event_id', "'p'")} AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS rk, count(*) OVER (PARTITION BY family) AS m FROM p)
  SELECT family, event_id, round(least(1, min(p * m / rk) OVER (PARTITION BY family ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM r""")
def bh_fdr(spark, d):
    p = X.table(spark, d, "events").select(F.col("event_type").alias("family"), "event_id", X.u("event_id", "p").alias("p"))
    return rounded(metrics.benjamini_hochberg(p, "p", ("family",)).select("family", "event_id", "q"))


@query("topn_models", "WITH m AS (SELECT label AS family, vec_id AS model, round(list_sum(embedding), 6) AS s FROM embeddings) SELECT family, model, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY s DESC, model)::INT AS rank FROM m) WHERE rank <= 3")
def topn_models(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("label").alias("family"), F.col("vec_id").alias("model"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("s"))
    return metrics.ranked(e, "s", by=("family",), top=3).select("family", "model", "rank")


@query("long_metric_table", f"WITH {S.EVENTS} SELECT dossier, unnest(['pages', 'starts']) AS metric, unnest([count(*)::DOUBLE, count(*) FILTER (start_page = 'yes')::DOUBLE]) AS value FROM ep GROUP BY dossier")
def long_metric_table(spark, d):
    pages = X.event_pages(spark, d)
    wide = pages.groupBy("dossier").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("start_page") == "yes").alias("starts"))
    return metrics.long_metrics(wide, ["dossier"], ["pages", "starts"])


@query("latency_summary", """WITH ok AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE event_type <> 'error'),
  p AS (SELECT 0.95::DOUBLE * (n + 1) AS pl FROM ok LIMIT 1)
  SELECT (SELECT count(*) FROM events) AS n, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_failed, round((SELECT count(*) FROM events) / 100.0::DOUBLE, 8) AS pages_per_sec, round(avg(value), 8) AS latency_mean,
    round(median(value), 8) AS latency_median, round(max(value) FILTER (i = floor(pl)) + (max(value) FILTER (i = floor(pl) + 1) - max(value) FILTER (i = floor(pl))) * (max(pl) - floor(max(pl))), 8) AS latency_p95 FROM ok, p""")
def latency_summary(spark, d):
    return rounded(metrics.latency_summary(X.table(spark, d, "events"), "value", F.col("event_type") == "error", 100.0))


@query("recompose_shuffle", f"""WITH {S.CONVERSATIONS}, sg AS (SELECT dossier, true_seg, min(page_num) AS head, mode(document_type ORDER BY document_type) AS label FROM ch GROUP BY 1, 2),
  dk AS (SELECT *, CASE WHEN label = 'system' THEN 0 ELSE 1 END AS rest, CASE WHEN label = 'system' THEN head::DOUBLE ELSE {S.u("'mix'", 'pass', 'dossier', 'head')} END AS r FROM sg, range(1, 3) t(pass))
  SELECT ch.dossier || '_shuffle' || pass AS dossier, row_number() OVER (PARTITION BY ch.dossier, pass ORDER BY rest, r, ch.page_num)::INT AS page_num, CASE WHEN ch.page_num = dk.head THEN 'yes' ELSE 'no' END AS start_page,
         ch.dossier AS source_dossier, ch.page_num AS source_page, ch.document_type FROM ch JOIN dk ON ch.dossier = dk.dossier AND ch.true_seg = dk.true_seg""")
def recompose_shuffle(spark, d):
    return segments.recomposed(X.conversation_pages(spark, d), 2, "mix", cover="system")


@query("segment_mean_pool", """SELECT label AS dossier, (vec_id // 7) AS seg, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 8) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2, 3""")
def segment_mean_pool(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("label").alias("dossier"), F.floor(F.col("vec_id") / 7).alias("seg"), "embedding")
    return rounded(segments.mean_pooled(e, "embedding"))


@query("boundary_lag", """WITH b AS (SELECT label AS dossier, vec_id AS page_num, embedding AS v, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings)
  SELECT dossier, page_num, round(CASE WHEN w IS NULL THEN 0 ELSE list_sum(list_transform(list_zip(v, w), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) END, 6) AS change FROM b""")
def boundary_lag(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("label").alias("dossier"), F.col("vec_id").alias("page_num"), "embedding")
    out = segments.boundary_features(e, "embedding")
    return out.select("dossier", "page_num", F.round(F.aggregate("boundary", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("change"))


@query("ordered_sequences", f"WITH {S.EVENTS} SELECT dossier, string_agg(document_type, ',' ORDER BY page_num) AS pages FROM ep GROUP BY 1")
def ordered_sequences(spark, d):
    out = segments.sequences(X.event_pages(spark, d), ["document_type"])
    return out.select("dossier", F.array_join(F.transform("pages", lambda x: x["document_type"]), ",").alias("pages"))


@query("page_budget_batches", f"""WITH RECURSIVE {S.EVENTS}, z AS (SELECT dossier, count(*) AS n_pages FROM ep GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY {S.u('dossier', "'batch'")}, dossier) AS i, 2 * max(n_pages) OVER () AS most FROM z),
  w(dossier, n_pages, i, batch, used) AS (SELECT dossier, n_pages, i, 0, n_pages FROM o WHERE i = 1
    UNION ALL SELECT o.dossier, o.n_pages, o.i, CASE WHEN used + o.n_pages > most THEN batch + 1 ELSE batch END, CASE WHEN used + o.n_pages > most THEN o.n_pages ELSE used + o.n_pages END FROM w JOIN o ON o.i = w.i + 1)
  SELECT dossier, n_pages, batch FROM w""")
def page_budget_batches(spark, d):
    sizes = X.event_pages(spark, d).groupBy("dossier").agg(F.count(F.lit(1)).alias("n_pages")).withColumn("u", X.u("dossier", "batch"))
    largest = sizes.agg(F.max("n_pages")).first()[0]
    return segments.page_budget_batches(sizes, 2 * largest)
