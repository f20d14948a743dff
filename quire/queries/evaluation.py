"""Models against truth: joins, the registry of metrics, significance, fusions, small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import composition as C
from quire.operators import evaluation as E
from quire.operators import metrics, segmetrics
from quire.operators.ranking import numbered
from quire.queries.registry import labels, query, rounded
from quire.sources import fixture_sql as S
from quire.sources import fixtures as X

_TRUTH = ["start_page", "document_type"]


def _apart(spark, d):
    """Predictions and truth as two tables: a tenth of the pages lack either, some truth lacks its type."""
    pages = X.event_pages(spark, d)
    predictions = pages.filter(X.u("row_id", "lost") >= 0.1).select("dossier", "page_num", "row_id", "predicted_start_page", "predicted_document_type")
    truth = pages.filter(X.u("row_id", "untold") >= 0.1).select("dossier", "page_num", "start_page", F.when(X.u("row_id", "blank") >= 0.05, F.col("document_type")).alias("document_type"))
    return predictions, truth


_APART = f"""pr AS (SELECT dossier, page_num, row_id, predicted_start_page, predicted_document_type FROM ep WHERE {S.u('row_id', "'lost'")} >= 0.1),
  tr AS (SELECT dossier, page_num, start_page, CASE WHEN {S.u('row_id', "'blank'")} >= 0.05 THEN document_type END AS document_type FROM ep WHERE {S.u('row_id', "'untold'")} >= 0.1)"""


@query("truth_join", f"WITH {S.EVENTS}, {_APART} SELECT * FROM pr JOIN tr USING (dossier, page_num)")
def truth_join(spark, d):
    predictions, truth = _apart(spark, d)
    return E.with_truth(predictions, truth, _TRUTH)


@query("truth_left_join", f"WITH {S.EVENTS}, {_APART} SELECT * FROM pr LEFT JOIN tr USING (dossier, page_num)")
def truth_left_join(spark, d):
    predictions, truth = _apart(spark, d)
    return E.with_truth(predictions, truth, _TRUTH, keep=True)


@query("truth_join_report", f"""WITH {S.EVENTS}, {_APART} SELECT count(p.row_id) AS n_predicted, count(t.start_page) AS n_true, count(*) FILTER (p.row_id IS NOT NULL AND t.start_page IS NOT NULL) AS n_joined,
  count(*) FILTER (t.start_page IS NULL) AS n_without_truth, count(*) FILTER (p.row_id IS NULL) AS n_without_prediction, count(*) FILTER (p.row_id IS NOT NULL AND t.start_page IS NOT NULL AND t.document_type IS NULL) AS n_missing_label
  FROM pr p FULL JOIN tr t USING (dossier, page_num)""")
def truth_join_report(spark, d):
    return E.join_report(*_apart(spark, d), "document_type")


def _configs(spark, d):
    """Two configurations: the predictions as they are, and those with every start predicted."""
    pages = X.event_pages(spark, d)
    return pages.withColumn("config", F.lit("a")).unionByName(pages.withColumn("predicted_start_page", F.lit("yes")).withColumn("config", F.lit("b")))


@query("metric_registry", f"""WITH {S.SEGMENTED}, v AS (SELECT 'a' AS config, * FROM eh UNION ALL SELECT 'b', * REPLACE ('yes' AS predicted_start_page, page_num AS pred_head) FROM eh),
  dc AS (SELECT config, type, count(*) FILTER (document_type = type AND predicted_document_type = type) AS tp, count(*) FILTER (document_type = type) AS su, count(*) FILTER (predicted_document_type = type) AS pr FROM v, types GROUP BY ALL),
  f AS (SELECT config, avg(2 * tp / (su + pr)) AS ma, sum(2 * tp / (su + pr) * su) / sum(su) AS we FROM dc GROUP BY 1),
  b AS (SELECT config, count(*) FILTER (start_page = 'yes' AND predicted_start_page = 'yes') AS tp, count(*) FILTER (start_page = 'yes') + count(*) FILTER (predicted_start_page = 'yes') AS n FROM v GROUP BY 1),
  ov AS (SELECT config, dossier, true_head, pred_head, count(*) AS i FROM v GROUP BY ALL), oz AS (SELECT *, sum(i) OVER (PARTITION BY config, dossier, true_head) AS nt, sum(i) OVER (PARTITION BY config, dossier, pred_head) AS np FROM ov),
  s0 AS (SELECT config, dossier, coalesce(sum(i / (nt + np - i)) FILTER (2 * i > nt + np - i), 0) AS iou, count(DISTINCT true_head) AS t, count(DISTINCT pred_head) AS p FROM oz GROUP BY ALL),
  q AS (SELECT config, avg(iou / (0.5::DOUBLE * (t + p))) AS pq FROM s0 GROUP BY 1),
  tl AS (SELECT config, dossier, true_head, mode(document_type ORDER BY document_type) AS tl FROM v GROUP BY ALL), pl AS (SELECT config, dossier, pred_head, mode(predicted_document_type ORDER BY predicted_document_type) AS pl FROM v GROUP BY ALL),
  a AS (SELECT config, avg((true_head = pred_head)::INT) AS uas, avg((true_head = pred_head AND tl = pl)::INT) AS las FROM v JOIN tl USING (config, dossier, true_head) JOIN pl USING (config, dossier, pred_head) GROUP BY 1),
  m AS (SELECT config, unnest(['document_type_macro_f1', 'document_type_weighted_f1', 'start_page_f1', 'pq', 'uas', 'las']) AS metric, unnest([ma, we, 2 * tp / n, pq, uas, las]) AS value FROM f JOIN b USING (config) JOIN q USING (config) JOIN a USING (config))
  SELECT config, metric, round(value, 8) AS value FROM m""")
def metric_registry(spark, d):
    return rounded(E.evaluated(_configs(spark, d), {"document_type": labels(spark, X.EVENT_TYPES)}))


_DRAWS = f"""
pl AS (SELECT dossier, row_number() OVER (ORDER BY dossier) - 1 AS place FROM (SELECT DISTINCT dossier FROM ep)), nd AS (SELECT count(*) AS n FROM pl),
wt AS (SELECT draw, pl.dossier, count(*) AS weight FROM (SELECT draw, floor({S.u("'sig'", 'draw', 'place')} * n)::BIGINT AS place FROM pl, nd, range(0, 40) r(draw)) JOIN pl USING (place) GROUP BY 1, 2)"""


@query("significance_table", f"""WITH {S.SEGMENTED}, {_DRAWS}, c AS (SELECT *, {S.u('row_id', "'third'")} < 0.9 AS k FROM eh),
  v AS (SELECT 'uas' AS metric, 'a' AS config, dossier, count(*) FILTER (true_head = pred_head) AS num, count(*) AS den FROM c GROUP BY 3 UNION ALL SELECT 'uas', 'b', dossier, count(*) FILTER (true_head = page_num), count(*) FROM c GROUP BY 3
    UNION ALL SELECT 'uas', 'c', dossier, count(*) FILTER (true_head = pred_head AND k), count(*) FROM c GROUP BY 3 UNION ALL SELECT 'type', 'a', dossier, count(*) FILTER (document_type = predicted_document_type), count(*) FROM c GROUP BY 3
    UNION ALL SELECT 'type', 'c', dossier, count(*) FILTER (document_type = predicted_document_type AND k), count(*) FROM c GROUP BY 3),
  w AS (SELECT metric, config, sum(num) / sum(den) AS value FROM v GROUP BY 1, 2), tp AS (SELECT metric, first(config ORDER BY value DESC, config) AS top_config, max(value) AS top_value FROM w GROUP BY 1),
  dr AS (SELECT metric, config, draw, sum(num * weight) / sum(den * weight) AS x FROM v JOIN wt USING (dossier) GROUP BY 1, 2, 3),
  p AS (SELECT w.metric, top_config, w.config AS other_config, top_value, value AS other_value, avg((t.x <= o.x)::INT) AS p_value FROM w JOIN tp USING (metric) JOIN dr o ON o.metric = w.metric AND o.config = w.config
    JOIN dr t ON t.metric = w.metric AND t.config = top_config AND t.draw = o.draw WHERE w.config <> top_config GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p_value) AS rk, count(*) OVER (PARTITION BY metric) AS m FROM p),
  q AS (SELECT *, least(1, min(p_value * m / rk) OVER (PARTITION BY metric ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r)
  SELECT metric, top_config, other_config, round(top_value, 8) AS top_value, round(other_value, 8) AS other_value, round(top_value - other_value, 8) AS diff, round(p_value, 8) AS p_value, round(q, 8) AS q_value, q < 0.05 AS significant FROM q""")
def significance_table(spark, d):
    pages = segmetrics.both(X.event_pages(spark, d)).withColumn("k", X.u("row_id", "third") < 0.9)
    head, right = F.col("true_head") == F.col("pred_head"), F.col("document_type") == F.col("predicted_document_type")
    cases = [("uas", "a", head), ("uas", "b", F.col("true_head") == F.col("page_num")), ("uas", "c", head & F.col("k")), ("type", "a", right), ("type", "c", right & F.col("k"))]
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("config"), ok.alias("ok")) for m, c, ok in cases])
    values = pages.select("dossier", F.inline(each)).groupBy("metric", "config", "dossier").agg(F.count_if("ok").alias("num"), F.count(F.lit(1)).alias("den"))
    places = numbered(pages.select("dossier").distinct(), ["dossier"])
    return rounded(E.significance(values, segmetrics.bootstrap_weights(places, 40, "sig")))


@query("late_fusion_pairs", f"""WITH f AS (SELECT v.b || '+' || t.b AS b, x.vec_id, list_transform(list_zip(x.probs, y.probs), lambda z: (z[1] + z[2]) / 2) AS p
    FROM (VALUES ('i1', 'v1'), ('i2', 'v2')) v(m, b), (VALUES ('t1', 'w1'), ('t2', 'w2')) t(m, b), (SELECT 'i1' AS m, * FROM {S.model('i1')} UNION ALL SELECT 'i2', * FROM {S.model('i2')}) x,
         (SELECT 't1' AS m, * FROM {S.model('t1')} UNION ALL SELECT 't2', * FROM {S.model('t2')}) y WHERE x.m = v.m AND y.m = t.m AND x.vec_id = y.vec_id)
  SELECT 'late-fusion-' || b AS model, vec_id, (list_position(p, list_max(p)) - 1)::INT AS predicted, round(list_max(p), 8) AS probability FROM f""")
def late_fusion_pairs(spark, d):
    """Two image and two text models; a third text model lacks a row and is left out."""
    own = [X.two_models(spark, d, m).select("vec_id", "probs", F.lit(m).alias("model")) for m in ("i1", "i2", "t1", "t2")]
    short = X.two_models(spark, d, "t3").select("vec_id", "probs", F.lit("t3").alias("model")).filter("vec_id <> 0")
    probabilities = own[0].unionByName(own[1]).unionByName(own[2]).unionByName(own[3]).unionByName(short)
    models = spark.createDataFrame([("i1", "vision", "v1"), ("i2", "vision", "v2"), ("t1", "text", "w1"), ("t2", "text", "w2"), ("t3", "text", "w3")], "model string, modality string, backbone string")
    out = E.fused_pairs(probabilities, models, ("vec_id",))
    return rounded(out.select("model", "vec_id", "predicted", F.array_max("probs").alias("probability")))


@query("family_dispatch", "SELECT vec_id, (label * 2)::INT AS predicted FROM embeddings")
def family_dispatch(spark, d):
    families = {"doubling": lambda rows, config: rows.select("vec_id", (F.col("label") * config["by"]).cast("int").alias("predicted"))}
    return E.dispatched(X.table(spark, d, "embeddings"), {"model_family": "doubling", "by": 2}, families)


@query("stale_configs", "SELECT DISTINCT o_custkey AS config FROM orders EXCEPT SELECT config FROM (SELECT o_custkey AS config, max(o_orderdate) FILTER (o_orderkey % 2 = 0) AS p, max(o_orderdate) FILTER (o_orderkey % 2 = 1) AS c FROM orders GROUP BY 1) WHERE p >= c")
def stale_configs(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_custkey").alias("config"), F.col("o_orderdate").alias("modified"), "o_orderkey")
    return E.stale(o.select("config").distinct(), o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"))


@query("confusion_grid", f"""WITH {S.EVENTS} SELECT list_position({X.EVENT_TYPES!r}, document_type)::INT - 1 AS place, document_type AS "true", {', '.join(f"count(*) FILTER (predicted_document_type = '{t}') AS {t}" for t in X.EVENT_TYPES)} FROM ep GROUP BY 1, 2""")
def confusion_grid(spark, d):
    return E.confusion_grid(metrics.confusion(X.event_pages(spark, d), "document_type", "predicted_document_type"), X.EVENT_TYPES)


@query("mapping_lines", "SELECT n_regionkey AS region, string_agg(n_name || ' -> ' || lower(n_name), '; ' ORDER BY n_name) AS line FROM nation GROUP BY 1")
def mapping_lines(spark, d):
    n = X.table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("label"), F.lower("n_name").alias("mapped"))
    return E.mapping_lines(n, "region")


@query("model_grid", "SELECT c_nationkey AS nation, max(s) FILTER (seg = 'BUILDING') AS BUILDING, max(s) FILTER (seg = 'MACHINERY') AS MACHINERY FROM (SELECT c_nationkey, c_mktsegment AS seg, round(sum(c_acctbal), 4) AS s FROM customer GROUP BY 1, 2) GROUP BY 1")
def model_grid(spark, d):
    s = X.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg")).agg(F.round(F.sum("c_acctbal"), 4).alias("s"))
    return E.model_grid(s, "nation", "seg", "s", ["BUILDING", "MACHINERY"])


@query("presence_indicator", f"WITH {S.META} SELECT dossier, n_a, n_r, n_a > 0 AS n_a_present, n_r > 0 AS n_r_present FROM meta")
def presence_indicator(spark, d):
    return E.presence(X.dossier_meta(spark, d).select("dossier", "n_a", "n_r"), ["n_a", "n_r"])


@query("segment_mean_back", "WITH m AS (SELECT vec_id, label, i - 1 AS dim, avg(embedding[i]::DOUBLE) OVER (PARTITION BY label, vec_id // 7, i) AS mean FROM embeddings, range(1, 65) r(i)) SELECT vec_id, label AS dossier, dim, round(mean, 8) AS mean FROM m")
def segment_mean_back(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("label").alias("dossier"), F.floor(F.col("vec_id") / 7).alias("seg"), "vec_id", "embedding")
    return rounded(E.pooled_back(e, "embedding").select("vec_id", "dossier", F.posexplode("pooled").alias("dim", "mean")).withColumn("dim", F.col("dim").cast("long")))


@query("cooccurrence_lift", f"""WITH {S.DOCUMENTS}, h AS (SELECT DISTINCT dossier, type FROM docs), n AS (SELECT count(*) AS n FROM dos),
  t AS (SELECT type_a, type_b, (SELECT count(*) FROM h x JOIN h y USING (dossier) WHERE x.type = type_a AND y.type = type_b) AS b, (SELECT count(*) FROM h WHERE type = type_a) AS ka, (SELECT count(*) FROM h WHERE type = type_b) AS kb FROM pairs)
  SELECT type_a, type_b, round((b + 1.0::DOUBLE) * (n + 4) / ((ka + 2) * (kb + 2)), 8) AS lift FROM t, n""")
def cooccurrence_lift(spark, d):
    from quire.queries.composition import _parts

    _, counts, dossiers, t = _parts(spark, d)
    return rounded(E.lift(C.presence_tables(counts, dossiers, t)))


@query("split_report", f"WITH {S.PARTS} SELECT split, count(*) AS n, count(DISTINCT document_type) AS n_classes, count(*) FILTER (document_type IS NULL) AS n_unlabelled FROM pt GROUP BY 1")
def split_report(spark, d):
    return E.split_report(X.typed_parts(spark, d), "document_type")


@query("task_labels", f"WITH {S.EVENTS}, k AS (SELECT document_type, row_number() OVER (ORDER BY document_type)::INT - 1 AS i FROM (SELECT DISTINCT document_type FROM ep WHERE start_page = 'yes')) SELECT 'start_page' AS task, row_id, (start_page = 'yes')::INT AS label FROM ep UNION ALL SELECT 'doc_type', row_id, i FROM ep JOIN k USING (document_type) WHERE start_page = 'yes'")
def task_labels(spark, d):
    pages = X.event_pages(spark, d)
    one = lambda t: E.task_labels(pages, t).select(F.lit(t).alias("task"), "row_id", "label")
    return one("start_page").unionByName(one("doc_type"))


@query("missing_features", f"WITH {S.EVENTS} SELECT dossier, page_num FROM ep WHERE {S.u('row_id', "'cached'")} >= 0.6")
def missing_features(spark, d):
    pages = X.event_pages(spark, d)
    return E.missing_features(pages, pages.filter(X.u("row_id", "cached") < 0.6)).select("dossier", "page_num")
