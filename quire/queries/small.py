"""Small functions and operators, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import labels as L
from quire.operators import manifest as M
from quire.operators import segments, splits
from quire.plans import jobs
from quire.queries.registry import query, rounded
from quire.sources import fixture_sql as S
from quire.sources import fixtures as X


@query("padded_sequences", f"WITH {S.EVENTS}, s AS (SELECT dossier, list((start_page = 'yes')::INT ORDER BY page_num) AS v FROM ep GROUP BY 1), m AS (SELECT max(len(v)) AS t FROM s) SELECT dossier, i - 1 AS at, CASE WHEN i <= len(v) THEN v[i] ELSE -100 END AS label, i <= len(v) AS real FROM s, m, range(1, t + 1) r(i)")
def padded_sequences(spark, d):
    """Start flags of each dossier, filled up to the longest one, with the mask of real pages."""
    pages = X.event_pages(spark, d).withColumn("flag", (F.col("start_page") == "yes").cast("int"))
    rows = segments.sequences(pages, ["flag"]).select("dossier", F.transform("pages", lambda x: x["flag"]).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    out = rows.select("dossier", F.size("v").alias("n"), F.posexplode(segments.padded(F.col("v"), longest, -100)).alias("at", "label"))
    return out.select("dossier", F.col("at").cast("long").alias("at"), "label", (F.col("at") < F.col("n")).alias("real"))


@query("tracked_types", f"WITH {S.EVENTS} SELECT row_id, CASE WHEN document_type IN ('click', 'view') THEN document_type ELSE 'Other' END AS type FROM ep")
def tracked_types(spark, d):
    return X.event_pages(spark, d).select("row_id", scalars.tracked(F.col("document_type"), ["click", "view"]).alias("type"))


@query("model_name_compose", "SELECT p_partkey, 'lstm-' || replace(p_brand || '/' || p_type, '/', '__') || '+' || p_brand AS model FROM part")
def model_name_compose(spark, d):
    return X.table(spark, d, "part").select("p_partkey", scalars.model_name("lstm", F.concat_ws("/", "p_brand", "p_type"), F.col("p_brand")).alias("model"))


@query("dossier_identifier", "SELECT o_orderkey, o_custkey::VARCHAR AS identifier FROM orders")
def dossier_identifier(spark, d):
    name = F.concat_ws("-", F.lit("a"), F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return X.table(spark, d, "orders").select("o_orderkey", scalars.identifier(name).alias("identifier"))


@query("top_pairs", "WITH m AS (SELECT p_brand AS model, round(avg(p_retailprice), 6) AS a, round(avg(p_size), 6) AS b FROM part GROUP BY 1), x AS (SELECT model FROM m ORDER BY a DESC, model LIMIT 3), y AS (SELECT model FROM m ORDER BY b DESC, model LIMIT 3) SELECT x.model AS start_model, y.model AS doc_model FROM x, y")
def top_pairs(spark, d):
    p = X.table(spark, d, "part").groupBy(F.col("p_brand").alias("model"))
    return jobs.model_pairs(p.agg(F.round(F.avg("p_retailprice"), 6).alias("macro_f1")), p.agg(F.round(F.avg("p_size"), 6).alias("macro_f1")), 3)


@query("annotator_union", f"WITH {S.ANNOTATIONS} SELECT pdf, page_num, document_type, annotator, annotator_order FROM an")
def annotator_union(spark, d):
    """One table an annotator, put together again."""
    rows = X.annotations(spark, d).select("pdf", "page_num", "document_type", "annotator")
    return L.annotator_rows({a: rows.filter(F.col("annotator") == a).drop("annotator") for a in X.ANNOTATORS})


@query("first_rows", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_rows(spark, d):
    return L.first_rows(X.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("numeric_page_order", "SELECT vec_id, row_number() OVER (ORDER BY label, try_cast(CASE WHEN vec_id % 7 = 0 THEN 'x' ELSE vec_id::VARCHAR END AS INT) NULLS LAST, vec_id) - 1 AS place FROM embeddings")
def numeric_page_order(spark, d):
    """Pages whose number is text, some of it no number: their place in page order."""
    from quire.operators.ranking import numbered

    e = X.table(spark, d, "embeddings").select("vec_id", F.col("label").alias("dossier"), F.when(F.col("vec_id") % 7 == 0, "x").otherwise(F.col("vec_id").cast("string")).alias("page"))
    typed = M.normalised(e, "dossier", "page").withColumns({"_odd": F.col("page_num").isNull(), "_page": F.coalesce("page_num", F.lit(0))})
    return numbered(typed, ["dossier", "_odd", "_page", "vec_id"]).select("vec_id", "place")


@query("split_from_column", f"WITH {S.PARTS} SELECT row_id, split FROM pt")
def split_from_column(spark, d):
    return splits.from_column(X.typed_parts(spark, d).withColumnRenamed("split", "given"), "given").select("row_id", "split")


@query("pareto_counts", "WITH k AS (SELECT value / 100 AS k FROM events) SELECT count(*) FILTER (k > 0.7::DOUBLE) AS bad, count(*) FILTER (k > 0.5::DOUBLE AND k <= 0.7::DOUBLE) AS ok, count(k) AS n FROM k")
def pareto_counts(spark, d):
    return M.pareto_counts(X.table(spark, d, "events").select((F.col("value") / 100).alias("pareto_k")))


@query("mirrored_paths", "SELECT p_partkey, '/out/' || p_brand || '/' || p_partkey || '.txt' AS path FROM part")
def mirrored_paths(spark, d):
    path = F.concat(F.lit("/data/in/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".xml"))
    return X.table(spark, d, "part").select("p_partkey", M.mirrored(path, "/data/in", "/out", ".txt").alias("path"))


@query("outdated_targets", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE s IS NULL OR s < o_orderdate + INTERVAL 60 DAY")
def outdated_targets(spark, d):
    """Orders as sources that change sixty days after their date, line items as what was made of them."""
    o = X.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit(".xml")).alias("path"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).cast("timestamp").alias("modified"))
    made = X.table(spark, d, "lineitem").select(F.concat(F.lit("/out/"), F.col("l_orderkey").cast("string"), F.lit(".txt")).alias("path"), F.col("l_shipdate").cast("timestamp").alias("modified"))
    return M.outdated(o, made).select("o_orderkey")


@query("start_flags", f"WITH {S.EVENTS} SELECT row_id, (start_page = 'yes')::INT AS label FROM ep")
def start_flags(spark, d):
    return M.start_labels(X.event_pages(spark, d)).select("row_id", "label")


@query("softmax", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings) SELECT vec_id, i - 1 AS at, round(e[i] / list_sum(e), 8) AS p FROM e, range(1, 65) r(i)")
def softmax(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return rounded(X.table(spark, d, "embeddings").select("vec_id", F.posexplode(scalars.softmax(x)).alias("at", "p")).withColumn("at", F.col("at").cast("long")))
