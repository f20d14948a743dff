"""Trees, fused networks, feature sequences, cached embeddings, lines with one header, jobs run once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions.hashing import uniform
from quire.operators import network, sequences, trees
from quire.operators.graph import saved
from quire.plans import runner
from quire.queries.registry import query, rounded
from quire.sources import cache, lines
from quire.sources import fixture_sql as Q
from quire.sources import fixtures as X
from quire.sources.tables import write_table


def folder(spark) -> str:
    """A new folder beside the tables that operators write."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/quire-query-{uuid.uuid4().hex}"


# -- trees ------------------------------------------------------------------------------------------------------------


def _marked_lines(spark, d):
    """Lines with two features and a label that a quantity decides, but for one in ten."""
    x = X.table(spark, d, "lineitem")
    noise = uniform("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.lit("stump")) < 0.1
    label = ((F.col("l_quantity") > 24) != noise).cast("int")
    return x.select(F.col("l_linenumber").cast("double").alias("line"), F.col("l_quantity").alias("quantity"), label.alias("y")).withColumn("v", F.array("quantity", "line"))


@query("stump_predictions", f"""WITH x AS (SELECT l_linenumber::DOUBLE AS line, l_quantity AS quantity, ((l_quantity > 24) <> ({Q.u('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', "'stump'")} < 0.1))::INT AS y FROM lineitem),
  f AS (SELECT 'quantity' AS feature, quantity AS v, y FROM x UNION ALL SELECT 'line', line, y FROM x),
  g AS (SELECT feature, v, count(*) AS n, sum(y) AS p FROM f GROUP BY 1, 2),
  c AS (SELECT feature, v, lead(v) OVER w AS nv, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS ln, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS lp, sum(n) OVER (PARTITION BY feature) AS tn, sum(p) OVER (PARTITION BY feature) AS tp FROM g WINDOW w AS (PARTITION BY feature ORDER BY v)),
  s AS (SELECT feature, (v + nv) / 2 AS cut, lp / ln AS left_p, (tp - lp) / (tn - ln) AS right_p FROM c WHERE nv IS NOT NULL ORDER BY lp * (ln - lp) / ln + (tp - lp) * (tn - ln - tp + lp) / (tn - ln) LIMIT 1)
  SELECT quantity, line, count(*) AS n, max(((CASE WHEN (CASE WHEN feature = 'quantity' THEN quantity ELSE line END) <= cut THEN left_p ELSE right_p END) > 0.5)::INT) AS predicted FROM x, s GROUP BY 1, 2""")
def stump_predictions(spark, d):
    """A single split, on all lines."""
    rows = _marked_lines(spark, d)
    out = trees.forest_scored(trees.stump(rows, "v", "y"), rows, "v")
    return out.groupBy("quantity", "line").agg(F.count(F.lit(1)).alias("n"), F.max("predicted").cast("int").alias("predicted"))


def _vectors(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    part = uniform("vec_id", F.lit("part"))
    return saved(e.filter("v IS NOT NULL").withColumn("split", F.when(part < 0.7, "train").when(part < 0.85, "val").otherwise("test")))


@query("boosted_tree_scores")
def boosted_tree_scores(spark, d):
    """Every vector's probability of the first label, by boosted trees with early selection."""
    rows = _vectors(spark, d).withColumn("y", (F.col("label") == 0).cast("int"))
    model = trees.boosted(rows.filter("split = 'train'"), rows.filter("split = 'val'"), "v", "y", 2, trees.Settings(rounds=10, depth=3, rate=0.2))
    return rounded(model.scored(rows, "v").select("vec_id", "split", "y", "predicted", "probability"), 6)


@query("forest_scores")
def forest_scores(spark, d):
    """Every vector's label by a forest, over all labels at once."""
    rows = _vectors(spark, d)
    model = trees.forest(rows.filter("split = 'train'"), "v", "label", 20, 6)
    return rounded(trees.forest_scored(model, rows, "v").select("vec_id", "split", "label", "predicted", "probability"), 6)


@query("fused_network_epochs")
def fused_network_epochs(spark, d):
    """Loss and validation score of each epoch of a network on the two halves of each vector, and which one it kept."""
    rows = _vectors(spark, d).withColumns({"image": F.slice("v", 1, 32), "text": F.slice("v", 33, 32)})
    net = network.fit(rows.filter("split = 'train'"), rows.filter("split = 'val'"), ["image", "text"], "label", 10, ["vec_id"], network.Settings(epochs=4, hidden=32, rate=1e-2))
    return rounded(net.epochs(spark).withColumn("kept", F.col("epoch") == net.epoch), 6)


# -- sequences --------------------------------------------------------------------------------------------------------


@query("sequence_chunks", """WITH p AS (SELECT conv_id::VARCHAR AS dossier, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS y, length(coalesce(text, '')) AS len, count(*) OVER (PARTITION BY conv_id) AS length FROM conversations),
  g AS (SELECT dossier, (i // 3)::INT AS chunk, max(length) AS length, count(*)::INT AS n, string_agg(turn || ',' || len, ',' ORDER BY i) AS f, string_agg(coalesce(y, -1)::VARCHAR, ',' ORDER BY i) AS y FROM p GROUP BY 1, 2)
  SELECT dossier, chunk, length, n, f || repeat(',0,0', 3 - n) AS features, repeat('1', n) || repeat('0', 3 - n) AS mask, y || repeat(',-1', 3 - n) AS labels FROM g""")
def sequence_chunks(spark, d):
    """Turns of a conversation in chunks of three steps, with two features each."""
    c = X.table(spark, d, "conversations")
    v = F.array(F.col("turn").cast("double"), F.length(F.coalesce("text", F.lit(""))).cast("double"))
    pages = c.select(F.col("conv_id").cast("string").alias("dossier"), F.col("turn").alias("page_num"), v.alias("v"), F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 0).alias("y"))
    out = sequences.chunks(pages, "v", "y", 3, 2)
    text = lambda name, kind: F.array_join(F.transform(name, lambda x: x.cast(kind).cast("string")), ",")
    return out.select("dossier", "chunk", "length", "n", text("features", "long").alias("features"), F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), "").alias("mask"), text("labels", "int").alias("labels"))


# -- cached embeddings ------------------------------------------------------------------------------------------------


def _toy():
    """Length, and the number of spaces, of a content, the latter times the pass."""
    import numpy as np

    return lambda b: np.stack([b["text"].fillna("").str.len(), b["text"].fillna("").str.count(" ") * b["pass"]], axis=1) if len(b) else np.zeros((0, 2))


@query("cached_embeddings", "SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS v0, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS v1 FROM documents")
def cached_embeddings(spark, d):
    """The mean over three passes, of a cache that already holds a half of the documents."""
    docs, path = X.table(spark, d, "documents").select("doc_id", "text"), folder(spark)
    cache.build(docs.filter("doc_id % 2 = 0"), path, "toy", _toy, ["text"], 2, ["doc_id"], 3)
    vectors, _ = cache.build(docs, path, "toy", _toy, ["text"], 2, ["doc_id"], 3)
    return cache.mean_over_passes(vectors, ["doc_id"]).select("doc_id", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"))


@query("cache_builds", """WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), h AS (SELECT DISTINCT text FROM t WHERE doc_id % 2 = 0)
  SELECT 1 AS build, (SELECT count(*) * 2 FROM t WHERE doc_id % 2 = 0) AS n_rows, (SELECT count(*) * 2 FROM t WHERE doc_id % 2 = 0 AND trim(text) = '') AS n_empty, (SELECT count(*) * 2 FROM h) AS n_embedded
  UNION ALL SELECT 2, (SELECT count(*) * 2 FROM t), (SELECT count(*) * 2 FROM t WHERE trim(text) = ''), (SELECT count(DISTINCT text) * 2 FROM t WHERE text NOT IN (SELECT text FROM h))""")
def cache_builds(spark, d):
    """What each of two builds, of a half and of all, had to embed in two passes."""
    docs, path, out = X.table(spark, d, "documents").select("doc_id", "text"), folder(spark), []
    for build, rows in ((1, docs.filter("doc_id % 2 = 0")), (2, docs)):
        _, f = cache.build(rows, path, "toy", _toy, ["text"], 2, ["doc_id"], 2)
        out.append((build, f["rows"], f["empty"], f["embedded"]))
    return spark.createDataFrame(out, "build int, n_rows long, n_empty long, n_embedded long")


# -- lines and jobs ---------------------------------------------------------------------------------------------------


@query("lines_with_one_header", "SELECT doc_id, text, lang, source FROM documents")
def lines_with_one_header(spark, d):
    """All documents, written in chunks of lines with one header and read again."""
    path = folder(spark)
    lines.write_lines(X.table(spark, d, "documents").select("doc_id", "text", "lang", "source"), path, rows_per_chunk=100)
    return lines.read_lines(spark, path, "doc_id long, text string, lang string, source string")


@query("lines_of_chunks", "SELECT 'header' AS kind, 1::BIGINT AS n UNION ALL SELECT 'rows', count(*) FROM lineitem")
def lines_of_chunks(spark, d):
    """How many lines of such a folder are headers, and how many rows."""
    path = folder(spark)
    lines.write_lines(X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), path, rows_per_chunk=5000)
    kind = F.when(F.col("value").startswith("l_orderkey"), "header").otherwise("rows")
    return spark.read.text(path).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("jobs_run_once", "SELECT event_type AS job, 'done' AS state, count(*) AS n FROM events GROUP BY 1")
def jobs_run_once(spark, d):
    """A job for each type of event counts its rows; two runners share them."""
    from concurrent.futures import ThreadPoolExecutor

    events, ledger, results = X.table(spark, d, "events"), folder(spark), folder(spark)
    names = [r[0] for r in events.select("event_type").distinct().collect()]  # a job matrix

    def run(job):
        write_table(events.filter(F.col("event_type") == job).groupBy(F.col("event_type").alias("job")).agg(F.count(F.lit(1)).alias("n")), f"{results}/{job}")

    with ThreadPoolExecutor(2) as two:
        list(two.map(lambda _: runner.run_jobs(spark, names, run, ledger, 2), range(2)))
    return runner.Ledger(spark, ledger).states().select("job", "state").join(spark.read.parquet(f"{results}/*"), "job")
