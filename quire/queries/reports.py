"""Long metric tables, masked scores, pooled effects, matched meta rows and priors, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import evaluation as E
from quire.operators import imputation as I
from quire.operators import manifest as M
from quire.operators import metrics
from quire.queries.evaluation import _configs
from quire.queries.registry import labels, query, rounded
from quire.sources import fixture_sql as S
from quire.sources import fixtures as X


@query("metric_rows", f"""WITH {S.SEGMENTED}, v AS (SELECT 'a' AS config, * FROM eh UNION ALL SELECT 'b', * REPLACE ('yes' AS predicted_start_page, page_num AS pred_head) FROM eh),
  dc AS (SELECT config, type, count(*) FILTER (document_type = type AND predicted_document_type = type) AS tp, count(*) FILTER (document_type = type) AS su, count(*) FILTER (predicted_document_type = type) AS pr FROM v, types GROUP BY ALL),
  dp AS (SELECT *, CASE WHEN pr = 0 THEN 0 ELSE tp / pr END AS p, CASE WHEN su = 0 THEN 0 ELSE tp / su END AS r, CASE WHEN su + pr = 0 THEN 0 ELSE 2 * tp / (su + pr) END AS f FROM dc),
  d AS (SELECT config, 'document_type' AS task, unnest(['accuracy', 'precision', 'recall', 'f1', 'precision', 'recall', 'f1']) AS metric, unnest(['overall', 'macro', 'macro', 'macro', 'weighted', 'weighted', 'weighted']) AS average,
    unnest([sum(tp) / sum(su), avg(p), avg(r), avg(f), sum(p * su) / sum(su), sum(r * su) / sum(su), sum(f * su) / sum(su)]) AS value, sum(su)::BIGINT AS support FROM dp GROUP BY config),
  b AS (SELECT config, count(*) FILTER (start_page = 'yes' AND predicted_start_page = 'yes') AS tp, count(*) FILTER (start_page = 'yes') AS t, count(*) FILTER (predicted_start_page = 'yes') AS p, count(*) AS n FROM v GROUP BY 1),
  st AS (SELECT config, 'start_page' AS task, unnest(['precision', 'recall', 'f1']) AS metric, 'binary' AS average, unnest([tp / p, tp / t, 2 * tp / (t + p)]) AS value, n AS support FROM b),
  ov AS (SELECT config, dossier, true_head, pred_head, count(*) AS i FROM v GROUP BY ALL), oz AS (SELECT *, sum(i) OVER (PARTITION BY config, dossier, true_head) AS nt, sum(i) OVER (PARTITION BY config, dossier, pred_head) AS np FROM ov),
  s0 AS (SELECT config, dossier, coalesce(sum(i / (nt + np - i)) FILTER (2 * i > nt + np - i), 0) AS iou, count(*) FILTER (2 * i > nt + np - i) AS tp, count(DISTINCT true_head) AS t, count(DISTINCT pred_head) AS p FROM oz GROUP BY ALL),
  q AS (SELECT config, 'segmentation' AS task, unnest(['pq', 'sq', 'rq', 'tp', 'fp', 'fn']) AS metric, '' AS average,
    unnest([avg(iou / (0.5::DOUBLE * (t + p))), avg(CASE WHEN tp = 0 THEN 0 ELSE iou / tp END), avg(tp / (0.5::DOUBLE * (t + p))), sum(tp)::DOUBLE, sum(p - tp)::DOUBLE, sum(t - tp)::DOUBLE]) AS value, count(*) AS support FROM s0 GROUP BY config),
  tl AS (SELECT config, dossier, true_head, mode(document_type ORDER BY document_type) AS tl FROM v GROUP BY ALL), pl AS (SELECT config, dossier, pred_head, mode(predicted_document_type ORDER BY predicted_document_type) AS pl FROM v GROUP BY ALL),
  a AS (SELECT config, 'document_type' AS task, unnest(['uas', 'las']) AS metric, '' AS average, unnest([avg((true_head = pred_head)::INT), avg((true_head = pred_head AND tl = pl)::INT)]) AS value, count(*) AS support
    FROM v JOIN tl USING (config, dossier, true_head) JOIN pl USING (config, dossier, pred_head) GROUP BY config)
  SELECT config, task, metric, average, round(value, 8) AS value, support FROM (SELECT * FROM d UNION ALL SELECT * FROM st UNION ALL SELECT * FROM q UNION ALL SELECT * FROM a)""")
def metric_rows(spark, d):
    return rounded(E.metric_rows(_configs(spark, d), {"document_type": labels(spark, X.EVENT_TYPES)}))


def _targets(spark, d):
    """Start flags and type numbers of pages as targets, types of other pages than true starts being masked."""
    pages = X.event_pages(spark, d)
    number = lambda c: (F.array_position(F.lit(X.EVENT_TYPES), F.col(c)) - 1).cast("int")
    start = F.col("start_page") == "yes"
    return pages.select(start.cast("int").alias("start"), (F.col("predicted_start_page") == "yes").cast("int").alias("predicted_start"),
                        F.when(start, number("document_type")).otherwise(-100).alias("type"), number("predicted_document_type").alias("predicted_type"))


@query("masked_metrics", f"""WITH {S.EVENTS}, r AS (SELECT 'start' AS task, (start_page = 'yes')::INT AS t, (predicted_start_page = 'yes')::INT AS p FROM ep
    UNION ALL SELECT 'type', list_position({X.EVENT_TYPES!r}, document_type) - 1, list_position({X.EVENT_TYPES!r}, predicted_document_type) - 1 FROM ep WHERE start_page = 'yes'),
  c AS (SELECT 'start' AS task, unnest(range(0, 2)) AS k UNION ALL SELECT 'type', unnest(range(0, 7))),
  f AS (SELECT c.task, k, count(*) FILTER (t = k) AS su, count(*) FILTER (p = k) AS pr, count(*) FILTER (t = k AND p = k) AS tp FROM c JOIN r USING (task) GROUP BY 1, 2)
  SELECT task, sum(su)::BIGINT AS n, round(sum(tp) / sum(su), 8) AS accuracy, round(avg(CASE WHEN su + pr = 0 THEN 0 ELSE 2 * tp / (su + pr) END), 8) AS macro_f1 FROM f GROUP BY 1""")
def masked_metrics(spark, d):
    """Two classes of the type's vocabulary never occur and count 0."""
    return rounded(E.masked_accuracy(_targets(spark, d), ["start", "type"], {"start": 2, "type": 7}))


@query("annotation_paths", "SELECT p_partkey, '/i/' || p_brand || '/' || p_brand || '_page_' || lpad(p_size::VARCHAR, 4, '0') || '.png' AS image_path, '/t/' || p_brand || '/' || p_brand || '_page_' || lpad(p_size::VARCHAR, 4, '0') || '.txt' AS text_path, '/m/' || p_brand || '/' || p_brand || '_page_' || lpad(p_size::VARCHAR, 4, '0') || '.markdown.md' AS markdown_path, '/x/' || p_brand || '/page/page_' || lpad(p_size::VARCHAR, 4, '0') || '.xml' AS pagexml_path FROM part")
def annotation_paths(spark, d):
    paths = scalars.annotation_paths(F.col("p_brand"), F.col("p_size"), {"image": "/i", "text": "/t/", "markdown": "/m", "pagexml": "/x"})
    return X.table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in paths.items()])


@query("all_splits_vocabulary", f"WITH {S.PARTS} SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS idx FROM (SELECT DISTINCT document_type AS label FROM pt)")
def all_splits_vocabulary(spark, d):
    """Classes of all splits, where label_vocabulary has those of training rows."""
    return M.vocabulary(X.typed_parts(spark, d), "document_type")


@query("matched_meta", "WITH n AS (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY 1) SELECT 'file-' || o_orderkey AS dossier, o_orderkey AS identifier, year(o_orderdate)::INT AS travel_year, o_orderpriority AS priority, pages FROM orders JOIN n ON o_orderkey = l_orderkey")
def matched_meta(spark, d):
    """Orders with lines as meta rows, line items as their dossiers' pages."""
    x = X.table(spark, d, "lineitem")
    pages = x.select(F.concat(F.lit("file-"), F.col("l_orderkey").cast("string")).alias("dossier"), "l_linenumber")
    known = x.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    meta = X.table(spark, d, "orders").join(known, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("identifier"), F.year("o_orderdate").alias("travel_year"), F.col("o_orderpriority").alias("priority"))
    kept, out = M.matched_meta(pages, meta, scalars.identifier)
    return out.join(kept.groupBy("dossier").agg(F.count(F.lit(1)).alias("pages")), "dossier")


@query("pooled_effects", "SELECT event_type AS type, count(DISTINCT user_id % 20) AS n_imputations, round(avg(p), 8) AS mean, round(quantile_cont(p, 0.03), 8) AS hdi_3, round(quantile_cont(p, 0.97), 8) AS hdi_97 FROM (SELECT *, (exp(value / 200) - 1) * 100 AS p FROM events) GROUP BY 1")
def pooled_effects(spark, d):
    draws = X.table(spark, d, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 20).alias("imputation"), (F.col("value") / 200).alias("beta"))
    return rounded(I.pooled_effects(draws, ["type"], "beta"))


@query("imputed_difference", f"""WITH e AS (SELECT event_type AS type, user_id % 2 AS late, (exp(value / 200) - 1) * 100 AS p, {S.u("'pair'", 'event_id')} AS u, event_id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY type, late ORDER BY u, event_id) AS draw FROM e),
  j AS (SELECT type, b.p - a.p AS x FROM n a JOIN n b USING (type, draw) WHERE a.late = 0 AND b.late = 1) SELECT type, round(avg(x), 8) AS mean, round(quantile_cont(x, 0.03), 8) AS hdi_3, round(quantile_cont(x, 0.97), 8) AS hdi_97, round(avg((x < 0)::INT), 8) AS p_below FROM j GROUP BY 1""")
def imputed_difference(spark, d):
    """Two periods' pooled draws of each type, paired at random."""
    e = X.table(spark, d, "events").select(F.col("event_type").alias("type"), (F.col("user_id") % 2).alias("late"), "event_id", (F.col("value") / 200).alias("beta"))
    drawn = I.paired_by_hash(I.as_percent(e, "beta"), ["type", "late"], "pair", "event_id")
    early, late = (drawn.filter(F.col("late") == k).select("type", "draw", "pct") for k in (0, 1))
    return rounded(I.difference(early, late, "pct", ["type"]))


@query("baseline_prior", f"""WITH {S.EVENTS}, p AS (SELECT type, count(row_id) AS n FROM types LEFT JOIN ep ON predicted_document_type = type GROUP BY 1), m AS (SELECT type, greatest(n / sum(n) OVER (), 1e-6) AS m FROM p), s AS (SELECT type, m / sum(m) OVER () AS m FROM m)
  SELECT types.type AS "true", s.type AS pred, round(CASE WHEN types.type = s.type THEN 0.7::DOUBLE ELSE 0 END + 0.3::DOUBLE * m, 8) AS p FROM types, s""")
def baseline_prior(spark, d):
    from quire.operators import posterior as P

    return rounded(P.baseline_prior(_dense(spark, d, "document_type", "predicted_document_type", X.EVENT_TYPES)).drop("n"))


def grid_sql(counts: str) -> str:
    """The posterior mean over the grid, of dense counts dn (true, pred, n)."""
    return f"""WITH {counts}, c AS (SELECT "true", pred, n, sum(n) OVER (PARTITION BY pred) AS s, greatest(sum(n) OVER (), 1) AS t FROM dn), q AS (SELECT DISTINCT pred, greatest(s / t, 1e-6) AS m FROM c), m AS (SELECT pred, m / sum(m) OVER () AS m FROM q),
  b AS (SELECT dn."true", pred, n, CASE WHEN dn."true" = pred THEN 0.7::DOUBLE ELSE 0 END + 0.3::DOUBLE * m AS p FROM dn JOIN m USING (pred)),
  g AS (SELECT i, exp(ln(4) - 5 * 0.75::DOUBLE + i * 7.5::DOUBLE / 399) AS k FROM range(0, 400) r(i)),
  x AS (SELECT i, k, "true", pred, n, k * p AS a, sum(k * p) OVER (PARTITION BY i, "true") AS sa, sum(n) OVER (PARTITION BY i, "true") AS r FROM b, g),
  w AS (SELECT i, sum(lgamma(a + n) - lgamma(a)) + sum((lgamma(sa) - lgamma(sa + r)) / (SELECT count(DISTINCT pred) FROM dn)) - 0.5::DOUBLE * pow((ln(max(k)) - ln(4)) / 0.75::DOUBLE, 2) AS l FROM x GROUP BY 1),
  v AS (SELECT i, exp(l - max(l) OVER ()) AS w FROM w)
  SELECT "true", pred, round(sum(w * (a + n) / (sa + r)) / sum(w), 6) AS p FROM x JOIN v USING (i) GROUP BY 1, 2"""


@query("start_posterior", grid_sql(f"""{S.EVENTS}, yn AS (SELECT unnest(['no', 'yes']) AS v), dn AS (SELECT a.v AS "true", b.v AS pred, count(row_id) AS n FROM yn a CROSS JOIN yn b LEFT JOIN ep ON start_page = a.v AND predicted_start_page = b.v GROUP BY 1, 2)"""))
def start_posterior(spark, d):
    from quire.operators import posterior as P

    return rounded(P.confusion_posterior(_dense(spark, d, "start_page", "predicted_start_page", ["no", "yes"])), 6)


def _dense(spark, d, true, pred, classes):
    return metrics.dense_confusion(metrics.confusion(X.event_pages(spark, d), true, pred), labels(spark, classes))


@query("before_pairs")
def before_pairs(spark, d):
    """How likely each type comes before each other one, by the fitted order."""
    from quire.operators import posterior as P
    from quire.queries.composition import bradley_terry

    return rounded(P.before_pairs(bradley_terry(spark, d)))
