"""How documents compose dossiers, as predicted and corrected for the classifier's errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import composition as C
from quire.operators import imputation as I
from quire.operators import metrics, segments
from quire.operators.graph import saved
from quire.queries.reports import grid_sql
from quire.queries.registry import SQL, labels, query, rounded, types
from quire.sources import fixture_sql as S
from quire.sources import fixtures as X


def _docs(spark, d):
    pages = segments.segmented(X.event_pages(spark, d), "predicted_start_page")
    return segments.documents(pages, "predicted_document_type", "document_type_confidence")


def _parts(spark, d):
    docs = _docs(spark, d)
    return docs, C.type_counts(docs), docs.select("dossier").distinct(), types(spark, X.EVENT_TYPES)


@query("occurrence_naive", f"""WITH {S.DOCUMENTS} SELECT t.type, round(count(n) / (SELECT count(*) FROM dos), 8) AS prevalence, round(sum(n) / (SELECT count(*) FROM dos), 8) AS mean_count, round(sum(n) / count(n), 8) AS mean_count_given_present,
  round(count(*) FILTER (n = 1) / count(n), 8) AS frac_single_given_present FROM types t LEFT JOIN cnt USING (type) GROUP BY 1""")
def occurrence_naive(spark, d):
    _, counts, dossiers, t = _parts(spark, d)
    return rounded(C.occurrence(counts, dossiers, t))


@query("occurrence_lines", """WITH cnt AS (SELECT l_orderkey AS dossier, l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT count(DISTINCT l_orderkey) AS k FROM lineitem)
  SELECT type, round(count(n) / max(k), 8) AS prevalence, round(sum(n) / max(k), 8) AS mean_count, round(sum(n) / count(n), 8) AS mean_count_given_present, round(count(*) FILTER (n = 1) / count(n), 8) AS frac_single_given_present FROM cnt, k GROUP BY 1""")
def occurrence_lines(spark, d):
    x = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dossier"), F.col("l_returnflag").alias("type"))
    return rounded(C.occurrence(C.type_counts(x), x.select("dossier").distinct(), types(spark, ["A", "N", "R"])))


@query("type_counts_dense", f"WITH {S.DOCUMENTS} SELECT dos.dossier, types.type, coalesce(n, 0) AS n FROM dos CROSS JOIN types LEFT JOIN cnt ON cnt.dossier = dos.dossier AND cnt.type = types.type")
def type_counts_dense(spark, d):
    _, counts, dossiers, t = _parts(spark, d)
    return C.dense(counts, dossiers, t)


_PRES = """
pa AS (SELECT dossier, type_a, type_b, bool_or(cnt.type = type_a) AS a, bool_or(cnt.type = type_b) AS b, count(*) - (bool_or(cnt.type = type_a))::INT - (bool_or(cnt.type = type_b))::INT AS rest FROM pairs, cnt GROUP BY 1, 2, 3)"""


@query("cooccurrence_2x2", f"WITH {S.DOCUMENTS}, {_PRES} SELECT type_a, type_b, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (b AND NOT a) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM pa GROUP BY 1, 2")
def cooccurrence_2x2(spark, d):
    _, counts, dossiers, t = _parts(spark, d)
    return C.presence_tables(counts, dossiers, t)


_WEEKS = """
wk AS (SELECT DISTINCT user_id || '-' || week(ts) AS dossier, event_type AS type FROM events), types AS (SELECT DISTINCT event_type AS type FROM events), pairs AS (SELECT a.type AS type_a, b.type AS type_b FROM types a JOIN types b ON a.type < b.type),
pa AS (SELECT dossier, type_a, type_b, bool_or(wk.type = type_a) AS a, bool_or(wk.type = type_b) AS b, count(*) - (bool_or(wk.type = type_a))::INT - (bool_or(wk.type = type_b))::INT AS rest FROM pairs, wk GROUP BY 1, 2, 3),
sr AS (SELECT *, ntile(4) OVER (PARTITION BY type_a, type_b ORDER BY rest, dossier) AS k FROM pa),
sk AS (SELECT type_a, type_b, k, count(*)::DOUBLE AS n, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (b AND NOT a) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM sr GROUP BY 1, 2, 3),
sx AS (SELECT *, n11 * n00 / n AS r, n10 * n01 / n AS s, (n11 + n00) / n AS p, (n10 + n01) / n AS q FROM sk),
mh AS (SELECT type_a, type_b, sum(r) AS r, sum(s) AS s, sum(p * r) AS pr, sum(p * s + q * r) AS mx, sum(q * s) AS qs FROM sx GROUP BY 1, 2)"""


def _weeks(spark, d):
    e = X.table(spark, d, "events")
    segs = e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.weekofyear("ts").cast("string")).alias("dossier"), F.col("event_type").alias("type"))
    return C.type_counts(segs), segs.select("dossier").distinct(), types(spark, X.EVENT_TYPES)


@query("cooccurrence_mh", f"WITH {_WEEKS} SELECT type_a, type_b, CASE WHEN r > 0 AND s > 0 THEN round(ln(r / s), 8) END AS log_or, CASE WHEN r > 0 AND s > 0 THEN round(pr / (2 * r * r) + mx / (2 * r * s) + qs / (2 * s * s), 8) END AS var_log_or FROM mh")
def cooccurrence_mh(spark, d):
    return rounded(C.mantel_haenszel(*_weeks(spark, d)))


def _digamma(x: str) -> str:
    """As SQL: eight steps up and the asymptotic series."""
    y = f"({x} + 8.0::DOUBLE)"
    return f"(ln{y} - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8)) - 1 / (132 * pow({y}, 10)){''.join(f' - 1.0::DOUBLE / ({x} + {k})' for k in range(8))})"


def _trigamma(x: str) -> str:
    y = f"({x} + 8.0::DOUBLE)"
    return f"(1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)) - 1 / (30 * pow({y}, 9)) + 5 / (66 * pow({y}, 11)){''.join(f' + 1.0::DOUBLE / pow({x} + {k}, 2)' for k in range(8))})"


_CELLS = ("n11", "n10", "n01", "n00")


@query("cooccurrence_log_odds", f"""WITH {_WEEKS}, ct AS (SELECT type_a, type_b, {', '.join(f"sum({c}) + 1.0::DOUBLE AS {c}" for c in _CELLS)} FROM sk GROUP BY 1, 2)
  SELECT type_a, type_b, round({_digamma('n11')} + {_digamma('n00')} - {_digamma('n10')} - {_digamma('n01')}, 8) AS log_or_mean, round({' + '.join(_trigamma(c) for c in _CELLS)}, 8) AS log_or_var FROM ct""")
def cooccurrence_log_odds(spark, d):
    return rounded(C.log_odds_posterior(C.presence_tables(*_weeks(spark, d))))


_RUNS = f"""
ru0 AS (SELECT dossier, type, order_in_dossier, count(*) OVER (PARTITION BY dossier) AS length, coalesce(lag(type) OVER (PARTITION BY dossier ORDER BY order_in_dossier) <> type, true) AS fresh FROM docs),
ru AS (SELECT dossier, type, count(*) AS k, count(*) FILTER (fresh) AS runs, any_value(length) AS length FROM ru0 GROUP BY 1, 2)"""


@query("dispersion_runs", f"WITH {S.DOCUMENTS}, {_RUNS} SELECT * FROM ru")
def dispersion_runs(spark, d):
    return C.runs(_docs(spark, d))


@query("dispersion_z", f"""WITH {S.DOCUMENTS}, {_RUNS}, z AS (SELECT *, k::DOUBLE AS kk, length::DOUBLE AS nn FROM ru WHERE k >= 2),
  m AS (SELECT type, count(*) AS n_qualifying, avg((runs - 1) / (kk - 1)) AS mean_contiguity, sum(runs - (1 + 2 * kk * (nn - kk) / nn)) AS d1,
    sum(CASE WHEN nn > 1 THEN greatest(0, 2 * kk * (nn - kk) * (2 * kk * (nn - kk) - nn) / (nn * nn * (nn - 1))) ELSE 0 END) AS v1, sum(runs - kk * (nn - kk + 1) / nn) AS d2,
    sum(CASE WHEN nn > 1 THEN kk * (kk - 1) * (nn - kk) * (nn - kk + 1) / (nn * nn * (nn - 1)) ELSE 0 END) AS v2 FROM z GROUP BY 1)
  SELECT type, round(d1 / sqrt(v1), 6) AS z_score, round(d2 / sqrt(v2), 6) AS z_score_type_runs, round(mean_contiguity, 6) AS mean_contiguity, n_qualifying, n_qualifying < 15 AS low_support FROM m""")
def dispersion_z(spark, d):
    return rounded(C.dispersion(C.runs(_docs(spark, d))), 6)


@query("position_stats", f"WITH {S.DOCUMENTS} SELECT type, count(*) AS n, round(avg(norm_position), 8) AS mean, round(stddev_samp(norm_position), 8) AS sd, round(stddev_samp(norm_position) / sqrt(count(*)), 8) AS se_mean, round(stddev_samp(norm_position) / sqrt(2 * (count(*) - 1)), 8) AS se_sd FROM docs GROUP BY 1")
def position_stats(spark, d):
    return rounded(C.positions(_docs(spark, d)))


@query("first_wins", f"WITH {S.DOCUMENTS}, fo AS (SELECT dossier, type, min(order_in_dossier) AS f FROM docs GROUP BY 1, 2) SELECT a.type AS type_a, b.type AS type_b, count(*) FILTER (a.f < b.f) AS a_first, count(*) FILTER (a.f >= b.f) AS b_first FROM fo a JOIN fo b USING (dossier) WHERE a.type < b.type GROUP BY 1, 2")
def first_wins(spark, d):
    return C.first_wins(C.first_occurrences(_docs(spark, d)), types(spark, X.EVENT_TYPES))


@query("richness", f"WITH {S.DOCUMENTS}, r AS (SELECT dossier, count(*) AS r FROM cnt GROUP BY 1) SELECT min(r) AS min_richness, max(r) AS max_richness, round(avg(r), 8) AS mean_richness FROM r")
def richness(spark, d):
    return rounded(C.richness(_docs(spark, d)))


@query("richness_strata", f"WITH {_WEEKS} SELECT dossier, type_a, type_b, k::INT AS stratum FROM sr")
def richness_strata(spark, d):
    return C._strata(*_weeks(spark, d), 4).select("dossier", "type_a", "type_b", "stratum")


# A literal posterior: right with 0.8, else any other type; starts right with 0.9.
_POST = '''po AS (SELECT a.type AS "true", b.type AS pred, CASE WHEN a.type = b.type THEN 0.8::DOUBLE ELSE 0.05::DOUBLE END AS p FROM types a, types b)'''
_PRIOR = '''pi AS (SELECT type AS "true", (count(t) + 1.0::DOUBLE) / (sum(count(t)) OVER () + count(*) OVER ()) AS prior FROM (SELECT types.type, ep.document_type AS t FROM types LEFT JOIN ep ON ep.document_type = types.type) GROUP BY 1)'''
_INV = '''iv AS (SELECT pred, "true", p * prior / sum(p * prior) OVER (PARTITION BY pred) AS w FROM po JOIN pi USING ("true"))'''


def _posterior(spark):
    rows = [(t, p, 0.8 if t == p else 0.05) for t in X.EVENT_TYPES for p in X.EVENT_TYPES]
    return spark.createDataFrame(rows, "true string, pred string, p double")


def _correction(spark, d):
    prior = I.smoothed_prior(X.event_pages(spark, d), "document_type", labels(spark, X.EVENT_TYPES))
    return I.inverted(_posterior(spark), prior)


@query("laplace_prior", f'''WITH {S.EVENTS}, {_PRIOR} SELECT "true", round(prior, 10) AS prior FROM pi''')
def laplace_prior(spark, d):
    return rounded(I.smoothed_prior(X.event_pages(spark, d), "document_type", labels(spark, X.EVENT_TYPES)), 10)


@query("bayes_invert", f'''WITH {S.EVENTS}, {_POST}, {_PRIOR}, {_INV} SELECT pred, "true", round(w, 10) AS w FROM iv''')
def bayes_invert(spark, d):
    return rounded(_correction(spark, d), 10)


@query("precision_by_class", f"WITH {S.EVENTS} SELECT predicted_document_type AS class, round(avg((document_type = predicted_document_type)::INT), 8) AS precision FROM ep GROUP BY 1")
def precision_by_class(spark, d):
    return rounded(I.precision_by_class(metrics.confusion(X.event_pages(spark, d), "document_type", "predicted_document_type")))


@query("confusion_row_shares", f'''WITH {S.EVENTS} SELECT "true", pred, round(n / sum(n) OVER (PARTITION BY "true"), 8) AS p FROM (SELECT document_type AS "true", predicted_document_type AS pred, count(*) AS n FROM ep GROUP BY 1, 2)''')
def confusion_row_shares(spark, d):
    return rounded(I.row_normalised(metrics.confusion(X.event_pages(spark, d), "document_type", "predicted_document_type")))


@query("soft_counts", f'''WITH {S.DOCUMENTS}, {_POST}, {_PRIOR}, {_INV} SELECT dossier, "true" AS type, round(sum(w), 8) AS expected FROM docs JOIN iv ON docs.type = iv.pred GROUP BY 1, 2''')
def soft_counts(spark, d):
    return rounded(I.soft_counts(_docs(spark, d), _correction(spark, d)))


@query("expected_num_docs", f"WITH {S.EVENTS} SELECT dossier, round(sum(CASE WHEN page_num = 1 THEN 1.0 WHEN predicted_start_page = 'yes' THEN 0.9 ELSE 0.05 END)::DOUBLE, 8) AS expected FROM ep GROUP BY 1")
def expected_num_docs(spark, d):
    return rounded(I.expected_documents(X.event_pages(spark, d), spark.createDataFrame([("yes", 0.9), ("no", 0.05)], "pred string, p double")))


def _draws(spark, n, rows, columns):
    return spark.range(n).select(F.col("id").alias("draw")).crossJoin(F.broadcast(spark.createDataFrame(rows, columns)))


@query("impute_types", f"""WITH {S.DOCUMENTS}, {_POST}, {_PRIOR}, {_INV}, cu AS (SELECT pred, "true", CASE WHEN row_number() OVER (PARTITION BY pred ORDER BY "true" DESC) = 1 THEN 1 ELSE sum(w) OVER (PARTITION BY pred ORDER BY "true") END AS hi FROM iv),
  dw AS (SELECT draw, dossier, seg, docs.type, {S.u("'types'", 'draw', 'dossier', 'seg')} AS x FROM docs, range(0, 10) r(draw))
  SELECT draw, dossier, type, count(*) AS n FROM (SELECT draw, dossier, seg, min("true") AS type FROM dw JOIN cu ON dw.type = cu.pred WHERE cu.hi > x GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""")
def impute_types(spark, d):
    correction = spark.range(10).select(F.col("id").alias("draw")).crossJoin(F.broadcast(_correction(spark, d)))  # a vocabulary squared
    docs = _docs(spark, d).select("dossier", "seg", "type")
    return I.draw_counts(I.imputed_types(docs, correction, "types", ["dossier", "seg"]))


_STARTS = [("yes", "yes", 0.9), ("yes", "no", 0.1), ("no", "yes", 0.05), ("no", "no", 0.95)]


DRAWS = 200  # the reference's number of imputations


def _joint_sql(draws: int) -> str:
    return f"""WITH {S.EVENTS}, {_POST}, {_PRIOR}, {_INV}, cu AS (SELECT pred, "true", CASE WHEN row_number() OVER (PARTITION BY pred ORDER BY "true" DESC) = 1 THEN 1 ELSE sum(w) OVER (PARTITION BY pred ORDER BY "true") END AS hi FROM iv),
  j0 AS (SELECT draw, dossier, page_num, predicted_document_type AS t, document_type_confidence AS c, {S.u("'joint'", "'start'", 'draw', 'dossier', 'page_num')} >= CASE WHEN predicted_start_page = 'yes' THEN 0.1 ELSE 0.95 END AS st FROM ep, range(0, {draws}) r(draw)),
  j1 AS (SELECT *, sum((st OR page_num = 1)::INT) OVER (PARTITION BY draw, dossier ORDER BY page_num) AS seg FROM j0),
  j2 AS (SELECT draw, dossier, seg, t, sum(c) AS s, min(page_num) AS f FROM j1 GROUP BY 1, 2, 3, 4),
  j3 AS (SELECT draw, dossier, seg, first(t ORDER BY s DESC, f) AS t, min(f) AS first_page FROM j2 GROUP BY 1, 2, 3),
  j4 AS (SELECT *, {S.u("'joint|type'", 'draw', 'dossier', 'first_page')} AS x FROM j3)
  SELECT draw, dossier, type, count(*) AS n FROM (SELECT draw, dossier, seg, min("true") AS type FROM j4 JOIN cu ON j4.t = cu.pred WHERE cu.hi > x GROUP BY 1, 2, 3) GROUP BY 1, 2, 3"""


def _joint(spark, d, draws):
    """Pages, and the corrections of starts and types in each draw."""
    pages = X.event_pages(spark, d).withColumn("type", F.col("predicted_document_type"))
    kinds = spark.range(draws).select(F.col("id").alias("draw")).crossJoin(F.broadcast(_correction(spark, d)))
    return pages, _draws(spark, draws, _STARTS, "pred string, true string, w double"), kinds


@query("impute_joint_counts", _joint_sql(DRAWS))
def impute_joint_counts(spark, d):
    return I.imputed_counts(*_joint(spark, d, DRAWS), "joint")


@query("occurrence_corrected", f"""WITH jc AS ({_joint_sql(5)}), k AS (SELECT draw, count(DISTINCT dossier) AS k FROM jc GROUP BY 1), t AS (SELECT unnest({X.EVENT_TYPES!r}) AS type),
  p AS (SELECT k.draw, t.type, count(jc.n) / max(k) AS x FROM k CROSS JOIN t LEFT JOIN jc ON jc.draw = k.draw AND jc.type = t.type GROUP BY 1, 2)
  SELECT type, count(x) AS n, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS sd, round(quantile_cont(x, 0.03), 8) AS hdi_3, round(quantile_cont(x, 0.97), 8) AS hdi_97 FROM p GROUP BY 1""")
def occurrence_corrected(spark, d):
    counts = saved(I.draw_counts(I.imputed_documents(*_joint(spark, d, 5), "joint")))
    dossiers = counts.select("draw", "dossier").distinct()
    per = saved(C.occurrence(counts, dossiers, types(spark, X.EVENT_TYPES), ("draw",)))  # the percentiles read it several times
    return rounded(I.pooled(per, ["type"], "prevalence"))


@query("hdi_summary", f"""WITH {S.EVENTS} SELECT document_type, round(avg(value - 20), 8) AS mean, round(quantile_cont(value - 20, 0.03), 8) AS hdi_3, round(quantile_cont(value - 20, 0.97), 8) AS hdi_97, round(avg((value - 20 > 0)::INT), 8) AS p_positive,
  avg((value - 20 > 0)::INT) > 0.975 OR avg((value - 20 > 0)::INT) < 0.025 AS credible, quantile_cont(value - 20, 0.03) > 0 OR quantile_cont(value - 20, 0.97) < 0 AS excludes_zero FROM ep GROUP BY 1""")
def hdi_summary(spark, d):
    return rounded(C.summarised(X.event_pages(spark, d).withColumn("x", F.col("value") - 20), "x", ["document_type"]))


@query("pair_draws_mh", f"""WITH {_WEEKS}, es AS (SELECT type_a, type_b, ln(r / s) AS m, pr / (2 * r * r) + mx / (2 * r * s) + qs / (2 * s * s) AS v FROM mh WHERE r > 0 AND s > 0),
  dw AS (SELECT type_a, type_b, m + sqrt(v) * sqrt(-2 * ln(greatest({S.u("'mh'", 'type_a', 'type_b', 'i', "'a'")}, 1e-300))) * cos(2 * pi() * {S.u("'mh'", 'type_a', 'type_b', 'i', "'b'")}) AS x FROM es, range(0, 200) r(i) WHERE v > 0)
  SELECT type_a, type_b, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.03), 6) AS hdi_3, round(quantile_cont(x, 0.97), 6) AS hdi_97 FROM dw GROUP BY 1, 2""")
def pair_draws_mh(spark, d):
    draws = C.pair_draws(C.mantel_haenszel(*_weeks(spark, d)), 200, "mh")
    return rounded(C.summarised(draws, "x", ["type_a", "type_b"]).select("type_a", "type_b", "mean", "hdi_3", "hdi_97"), 6)


@query("posterior_difference", f"""WITH a AS (SELECT event_id AS draw, value AS x FROM events), b AS (SELECT event_id AS draw, {S.u('event_id', "'d'")} * 50 AS y FROM events)
  SELECT 1 AS g, round(avg(y - x), 8) AS mean, round(quantile_cont(y - x, 0.03), 8) AS hdi_3, round(quantile_cont(y - x, 0.97), 8) AS hdi_97, round(avg((y - x < 0)::INT), 8) AS p_below FROM a JOIN b USING (draw)""")
def posterior_difference(spark, d):
    e = X.table(spark, d, "events").withColumn("g", F.lit(1)).withColumn("draw", F.col("event_id"))
    a = e.select("g", "draw", F.col("value").alias("x"))
    b = e.select("g", "draw", (X.u("event_id", "d") * 50).alias("x"))
    return rounded(I.difference(a, b, "x", ["g"]))


@query("winner_shares", "WITH p AS (SELECT user_id AS draw, event_type AS model, sum(value) AS s FROM events GROUP BY 1, 2), w AS (SELECT draw, first(model ORDER BY s DESC, model) AS model FROM p GROUP BY 1) SELECT 1 AS g, model, count(*) AS wins, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM w GROUP BY model")
def winner_shares(spark, d):
    p = X.table(spark, d, "events").groupBy(F.col("user_id").alias("draw"), F.col("event_type").alias("model")).agg(F.sum("value").alias("s")).withColumn("g", F.lit(1))
    return rounded(I.winner_shares(p, ["g"], "model", "s"))


@query("posterior_grid", grid_sql(f"""{S.EVENTS}, dn AS (SELECT a.type AS "true", b.type AS pred, count(row_id) AS n FROM types a CROSS JOIN types b LEFT JOIN ep ON document_type = a.type AND predicted_document_type = b.type GROUP BY 1, 2)"""))
def posterior_grid(spark, d):
    from quire.operators import posterior as P

    dense = metrics.dense_confusion(metrics.confusion(X.event_pages(spark, d), "document_type", "predicted_document_type"), labels(spark, X.EVENT_TYPES))
    return rounded(P.confusion_posterior(dense), 6)


@query("bradley_terry")
def bradley_terry(spark, d):
    from quire.operators import posterior as P

    rows = first_wins(spark, d).collect()  # pairs of a vocabulary
    at = {t: i for i, t in enumerate(X.EVENT_TYPES)}
    theta, _ = P.bradley_terry({(at[r["type_a"]], at[r["type_b"]]): (r["a_first"], r["b_first"]) for r in rows}, len(at))
    return spark.createDataFrame([(t, float(theta[i])) for t, i in at.items()], "type string, theta double")


@query("negative_binomial_map")
def negative_binomial_map(spark, d):
    """Documents of a dossier by persons and era, with an effect for each year, from distinct rows."""
    from quire.operators import size_models as M

    rows = X.dossier_meta(spark, d).withColumn("era", (F.col("travel_year") >= 1995).cast("int"))
    fit = M.fitted(rows, M.Model("map", "num_docs", {"num_persons": "num_persons", "era": "era"}))
    return rounded(M.coefficients(spark, [fit]).drop("model"), 6)
