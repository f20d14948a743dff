import pytest
from pyspark.sql import functions as F

from quire.functions import scalars, text
from quire.functions.hashing import uniform
from quire.operators import labels as L
from quire.operators import manifest as M
from quire.operators import splits, vectors
from quire.operators.graph import connected_components
from quire.plans import jobs


def values(spark, items, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_uniform_is_portable(spark):
    import hashlib

    got = spark.range(5).select(uniform("id", F.lit("a"))).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(f"{i}|a".encode()).hexdigest()[:13], 16) / 2**52 for i in range(5)]


def test_label_rules(spark):
    got = values(spark, ["Divorce paper", "proof", "Proof", "Form 9", None, "LETTER", "Birth Certificate", "medical officers advise"], scalars.by_rules)
    assert got == ["Testimonial status (Application Documents)"] * 2 + ["Letter (Other)", "Form 9", None, "Letter (Other)", "Testimonial status (Application Documents)", "Report of selection and medical officers"]
    assert values(spark, ["D.1", "x", None], scalars.tracked) == ["D.1", "Other", "Other"]
    assert values(spark, [" Straße\t", "STRASSE"], scalars.casefolded) == ["strasse", "strasse"]


def test_vectors(spark):
    assert values(spark, [[0.0, 0.0], [3.0, 4.0]], scalars.unit, "array<double>") == [[0.0, 0.0], [0.6, 0.8]]
    assert values(spark, [[0.2, 0.4, 0.4], [], None], scalars.argmax, "array<double>") == [1, None, None]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, [1.0, 1.0])], "id int, v array<double>")
    got = vectors.nearest(df.filter("id = 1"), df, 3).orderBy("rank").collect()
    assert [(r["neighbour"], round(r["similarity"], 6)) for r in got] == [(3, 1.0), (4, 0.707107), (2, 0.0)]


def test_late_fusion_needs_the_same_keys(spark):
    import pytest

    a = spark.createDataFrame([(1, [0.2, 0.8]), (2, [1.0, 0.0])], "k int, probs array<double>")
    with pytest.raises(Exception, match="same keys"):
        vectors.late_fusion(a, a.filter("k = 1"), ["k"]).collect()


def test_texts(spark):
    md = "# Title\n\nSome **bold** and `code`, a [link](http://x).\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n- item\n![pic](data:x)\n"
    assert values(spark, [md, None, "  "], text.markdown_text) == ["Title\nSome bold and code, a link.\na\nb\n1\n2\nitem", "", ""]
    html = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><h1>A &amp; B</h1><p>x <b>y</b></p><!-- no --><ul><li>i</li></ul></body></html>"
    assert values(spark, [html, None, "<p>open"], text.html_text) == ["A & B\nx y\ni", "", "open"]
    assert values(spark, [html], text.html_markdown) == ["# A & B\nx **y**\n- i"]
    xml = "<a:P xmlns:a='u'><a:TextLine><a:TextEquiv><a:Unicode/></a:TextEquiv><a:TextEquiv><a:Unicode> two </a:Unicode></a:TextEquiv></a:TextLine><a:TextLine/></a:P>"
    assert values(spark, [xml, "", None, "<broken"], text.pagexml_text) == ["two", "", "", ""]
    assert values(spark, ["a  ( b ) , c"], text.tidy) == ["a (b), c"]


def test_votes(spark):
    rows = [("p", 1, "a", 0, "x"), ("p", 1, "b", 1, "y"), ("p", 2, "a", 0, None), ("p", 3, "a", 0, "y"), ("p", 4, "a", 0, "x"), ("p", 4, "b", 1, "x"), ("p", 4, "c", 2, "y"), ("p", 5, "a", 0, "y"), ("p", 5, "b", 1, "y")]
    df = spark.createDataFrame(rows, "pdf string, page int, annotator string, annotator_order int, t string")
    got = {r["page"]: (r["value"], r["status"]) for r in L.votes(df, ["pdf", "page"], ["t"]).collect()}
    assert got == {1: ("y", "tie"), 2: (None, "no-data"), 3: ("y", "single"), 4: ("x", "majority"), 5: ("y", "unanimous")}


def test_class_absent_from_training_is_not_rare(spark):
    df = spark.createDataFrame([("a", "l", "f", "train")] * 3 + [("b", "l", "f", "train"), ("c", "l", "f", "test")], "t string, l string, f string, split string")
    assert {r["label"]: r["merged"] for r in L.rare_merge(df, "t", "l", "f", 2, split="split").collect()} == {"b": "Other (l, f)"}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "src int, dst int")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[51] == 50


def test_split_sizes(spark):
    for n in (1, 2, 3, 7, 20, 101):
        counts = {r["split"]: r["count"] for r in splits.split_70_15_15(spark.range(n).withColumnRenamed("id", "dossier")).groupBy("split").count().collect()}
        assert tuple(counts.get(s, 0) for s in splits.SPLITS) == splits.quantile_sizes(n)


def test_group_stratified_covers(spark):
    rows = [(f"d{i}", "common") for i in range(20)] + [("d1", "rare"), ("d2", "rare"), ("d3", "pair"), ("d4", "pair"), ("d5", "pair")]
    found, unmet = splits.group_stratified(spark.createDataFrame(rows, "dossier string, t string"), "dossier", "t")
    given = {r["dossier"]: r["split"] for r in found.collect()}
    assert len(given) == 20 and unmet == [("rare", "test")] and {given["d3"], given["d4"], given["d5"]} == set(splits.SPLITS)
    assert sum(v == "train" for v in given.values()) == 14


def test_group_stratified_sizes_and_every_class(spark):
    rows = [(f"d{i}", f"t{(i * 7 + k) % 9}") for i in range(400) for k in range(i % 3)] + [(f"d{i}", None) for i in range(400)]
    found, unmet = splits.group_stratified(spark.createDataFrame(rows, "dossier string, t string"), "dossier", "t")
    given = {r["dossier"]: r["split"] for r in found.collect()}
    assert len(given) == 400 == found.count() and unmet == []
    assert [sum(v == s for v in given.values()) for s in splits.SPLITS] == [280, 60, 60]
    assert all({given[d] for d, t in rows if t == f"t{c}"} == set(splits.SPLITS) for c in range(9))
    none, unmet = splits.group_stratified(spark.createDataFrame([], "dossier string, t string"), "dossier", "t")
    assert none.count() == 0 and unmet == []


@pytest.mark.parametrize("n, room", [(10, [7, 2, 1]), (10, [12, -3, 1]), (0, [0, 0, 0]), (5, [1, 1, 1]), (7, [-1, -2, 3]), (1, [5, 5, 5])])
def test_levelled(n, room):
    """As if each went to where most room is left."""
    got, left = splits._levelled(n, room), list(room)
    for _ in range(n):
        left[left.index(max(left))] -= 1
    assert sum(got) == n and sorted(r - g for r, g in zip(room, got)) == sorted(left)


def test_manifest(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        M.normalised(spark.range(1), "pdf", "page")
    df = spark.createDataFrame([("b", "10"), ("a", "x"), ("b", "9")], "pdf string, page string")
    assert [tuple(r) for r in M.in_page_order(M.normalised(df, "pdf", "page")).collect()] == [("a", None), ("b", 9), ("b", 10)]
    (tmp_path / "one.txt").write_text("x")
    files = M.existing_files(spark, str(tmp_path))
    rows = spark.createDataFrame([(f"file:{tmp_path}/one.txt",), ("file:/nowhere",), (None,)], "p string")
    assert M.missing_files(rows, files, "p").count() == 2 and M.checked_files(rows, files, "p", True).count() == 1
    with pytest.raises(FileNotFoundError):
        M.checked_files(rows, files, "p")
    new = spark.createDataFrame([("/in/a.png", 5), ("/in/b.png", 5), ("/in/c.png", 5)], "path string, modified int")
    done = spark.createDataFrame([("/out/a.txt", 6), ("/out/b.txt", 4)], "path string, modified int")
    assert {r["path"] for r in M.outdated(new, done).collect()} == {"/in/b.png", "/in/c.png"}


def test_plans(spark):
    assert jobs.job_matrix(spark).count() == 96 and jobs.job_matrix(spark).distinct().count() == 96 and jobs.derived_fusions(spark).count() == 8
    assert jobs.sweep(spark).filter("name = 'vision_quality_4_2'").first()["args"].endswith("--n-heads 4 --n-layers 2")
    names = spark.createDataFrame([("early-fusion-vgg16+x__y",), ("mystery",)], "model string")
    assert [(r["regime"], r["backbones"]) for r in jobs.parsed(names).collect()] == [("fusion", ["VGG16", "x/y"]), ("other", ["mystery"])]


def test_tables(spark, tmp_path):
    import gzip

    from quire.sources import tables as S

    df = spark.createDataFrame([("a\tb", 1, None), ('say "x"', 2, "z")], "t string, n int, o string")
    S.write_table(df, str(tmp_path / "x.tsv"))
    assert sorted(r["t"] for r in S.read_table(spark, str(tmp_path / "x.tsv")).collect()) == ["a\tb", 'say "x"']
    with gzip.open(tmp_path / "ann.tsv.gz", "wt") as f:
        f.write("pdf\tpage\tlabel\nd\t1\tfirst\nd\t1\tsecond\n \t2\tblank\n")
    assert [r["label"] for r in S.read_annotations(spark, str(tmp_path / "ann.tsv.gz"), "pdf", "page").collect()] == ["first"]
    m = spark.createDataFrame([("t", "m1", "macro_f1", 0.5), ("t", "m2", "macro_f1", 0.7), ("u", "m3", "macro_f1", 0.9)], "task string, model string, metric string, value double")
    S.save_result(m, str(tmp_path / "results"))
    S.save_result(m.filter("model = 'm1'").withColumn("value", F.lit(0.8)), str(tmp_path / "results"))
    assert [(r["model"], r["macro_f1"]) for r in S.load_results(spark, str(tmp_path / "results"), "t").collect()] == [("m1", 0.8), ("m2", 0.7)]


def test_streams_segment_as_batches_do(spark, tmp_path):
    from quire.operators import segments
    from quire.streaming.pages import streaming_segments

    rows = [("A", 1, "no"), ("A", 2, "yes"), ("B", 1, "yes"), ("A", 3, "no"), ("A", 4, " YES "), ("B", 2, None)]
    schema = "dossier string, page_num int, start_page string"
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = streaming_segments(stream).writeStream.format("memory").queryName("seg").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = segments.segmented(spark.createDataFrame(rows, schema)).select("dossier", "page_num", "seg", "head")
    assert sorted(map(tuple, spark.table("seg").collect())) == sorted(map(tuple, want.collect()))


def test_fields_of_a_turned_page(spark):
    """Anchors inside longer detections, one of them met in a wrong place too; a page with two anchors has no fields."""
    import numpy as np

    from quire.operators import forms

    anchors = [("Name", 100.0, 100.0), ("Date", 400.0, 100.0), ("Place of birth", 100.0, 300.0), ("Signature", 420.0, 310.0)]
    t = np.deg2rad(5)
    m = np.array([[0.97 * np.cos(t), -0.97 * np.sin(t), 50.0], [0.97 * np.sin(t), 0.97 * np.cos(t), 30.0]])
    at = lambda x, y: [float(v) for v in m @ (x, y, 1)]
    rows = [(1, f"1. {a.upper()} (given)", *at(x, y), 90.0) for a, x, y in anchors] + [(1, "Sginature", 5.0, 5.0, 95.0), (2, "Name", 1.0, 1.0, 90.0), (2, "Date", 2.0, 1.0, 90.0), (2, "Place of b1rth", 2.0, 9.0, 20.0)]
    seen = forms.confident(spark.createDataFrame(rows, "page long, text string, x double, y double, confidence double"))
    found = forms.found_anchors(seen, spark.createDataFrame(anchors, "anchor string, ax double, ay double"))
    assert found.filter("page = 1").count() == 4 and found.filter("page = 2").count() == 2
    got = forms.located_fields(found, [("date", 420.0, 90.0, 520.0, 115.0)]).collect()
    assert len(got) == 1 and np.allclose(got[0][2:], [*at(420, 90), *at(520, 115)], atol=1e-6)


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    """Chains in a hashed order: least labels that only spread to neighbours took rounds in proportion to their length."""
    from pyspark.sql import Window

    from quire.operators import graph

    ids = spark.range(4000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    chain = ids.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("g").orderBy(F.xxhash64("id"))).alias("dst"))
    written, save = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: written.append(1) or save(df))
    got = {r["id"]: r["component"] for r in graph.connected_components(chain).collect()}
    assert got == {i: i % 2 for i in range(4000)} and len(written) < 80


def test_tables_of_a_folder_are_files_or_folders(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "sub" / "b.parquet"))
    (tmp_path / "c.parquet").write_bytes(b"x")
    got = {r["name"]: r["length"] > 0 for r in M.existing_tables(spark, str(tmp_path)).collect()}
    assert got == {"a.parquet": True, "b.parquet": True, "c.parquet": True}


def test_page_paths_are_the_statements_beyond_four_digits(spark, tmp_path):
    from quire import catalog

    spark.createDataFrame([(7, "http://a.b/x"), (12345, "http://a.b/y")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["path"] for r in catalog.QUERIES["page_paths"](spark, str(tmp_path)).collect()}
    assert got == {7: "/root/img/a.b/a.b_0007.png", 12345: "/root/img/a.b/a.b_1234.png"}


def test_hashes_below_a_share_are_their_numbers_below_it(spark):
    from quire.functions.hashing import below

    shares = [0.0, 0.1, 0.25, 0.5000001, 1.0]
    rows = spark.range(2000).select(*[(below(p, "id", F.lit("s")) == (uniform("id", F.lit("s")) < p)).alias(f"c{i}") for i, p in enumerate(shares)])
    assert rows.filter(" AND ".join(rows.columns)).count() == 2000


def test_least_values_from_here_look_back_from_the_end(spark):
    """A frame up to the end of a partition is taken anew for each row, in quadratic time; one from its start isn't."""
    from quire.operators.ranking import least_from_here

    rows = spark.range(500).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) + F.col("id")).alias("x"))
    found = least_from_here(rows, ["id"], F.col("x"), "m")
    assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().executedPlan().toString().lower().split("_own")[-1]
    x = {r["id"]: r["x"] for r in rows.collect()}
    assert {r["id"]: r["m"] for r in found.collect()} == {i: min(x[j] for j in range(i, 500)) for i in x}


def test_large_tables_are_dealt_to_more_tasks(spark):
    from quire.operators.ranking import dealt

    assert dealt(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100 and dealt(spark.range(10), "id", 10).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_draws_of_lines_are_not_shuffled(spark):
    from quire.queries import sizes

    assert sizes.imputed_line_types(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_pages_leave_nothing_to_collect(spark):
    """A class for each page was garbage in cycles, and held the page's text."""
    import gc

    gc.collect()
    gc.disable()
    try:
        assert [text._visible(f"<p>{i} <b>x</b>", True) for i in range(20)] == [f"{i} **x**" for i in range(20)]
        assert gc.collect() < 20
    finally:
        gc.enable()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    text.small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
