import pytest
from pyspark.errors import PySparkException

from quire.operators import evaluation as E
from quire.operators import metrics


def test_truth_that_repeats_a_key_is_an_error(spark):
    p = spark.createDataFrame([("d", 1, "x")], "dossier string, page_num int, pred string")
    t = spark.createDataFrame([("d", 1, "a"), ("d", 1, "b")], "dossier string, page_num int, label string")
    with pytest.raises(PySparkException):
        E.with_truth(p, t, ["label"]).collect()
    assert E.with_truth(p, t.limit(1), ["label"]).count() == 1 and E.with_truth(p, t.filter("false"), ["label"]).count() == 0


def test_unknown_family(spark):
    with pytest.raises(ValueError, match="unknown model family"):
        E.dispatched(spark.range(1), {"model_family": "x"}, {"y": lambda r, c: r})


def test_summaries_of_a_glob(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "summary.tsv").write_text(f"model\tf1\n{n}1\t0.5\n{n}2\t0.7\n")
    got = E.summaries(spark, f"file:{tmp_path}/*/summary.tsv").collect()
    assert sorted((r["model"], r["f1"]) for r in got) == [("a1", 0.5), ("a2", 0.7), ("b1", 0.5), ("b2", 0.7)] and all("summary.tsv" in r["file"] for r in got)


def test_pairs_with_other_keys_or_classes_are_left_out(spark):
    rows = [("v", 1, [0.2, 0.8]), ("v", 2, [0.6, 0.4]), ("t", 1, [0.4, 0.6]), ("t", 2, [0.8, 0.2]), ("short", 1, [0.5, 0.5]), ("wide", 1, [0.1, 0.2, 0.7]), ("wide", 2, [0.1, 0.2, 0.7])]
    models = [("v", "vision", "V"), ("t", "text", "T"), ("short", "text", "S"), ("wide", "text", "W")]
    out = E.fused_pairs(spark.createDataFrame(rows, "model string, k int, probs array<double>"), spark.createDataFrame(models, "model string, modality string, backbone string"), ("k",))
    assert sorted((r["model"], r["k"], [round(x, 6) for x in r["probs"]], r["predicted"]) for r in out.collect()) == [("late-fusion-V+T", 1, [0.3, 0.7], 1), ("late-fusion-V+T", 2, [0.7, 0.3], 0)]


def test_stale(spark):
    c = spark.createDataFrame([(x,) for x in "abcd"], "config string")
    p, k = (spark.createDataFrame(r, "config string, modified int") for r in ([("a", 5), ("b", 3), ("c", 9)], [("a", 5), ("b", 4), ("d", 1)]))
    assert sorted(r[0] for r in E.stale(c, p, k).collect()) == ["b", "c", "d"] and E.stale(c, p, k, force=True).count() == 4


@pytest.mark.parametrize("seed", range(3))
def test_adjusted_p_values(spark, seed):
    import random

    r = random.Random(seed)
    rows = [(i % 3, i, r.choice([0.001, 0.01, 0.02, 0.5, r.random()])) for i in range(90)] + [(0, 999, None)]
    got = {x["i"]: x["q"] for x in metrics.benjamini_hochberg(spark.createDataFrame(rows, "f int, i int, p double"), "p", ("f",)).collect()}
    for f in range(3):
        own = sorted((p, i) for g, i, p in rows if g == f and p is not None)
        least = 1.0
        for k in range(len(own), 0, -1):
            least = min(least, own[k - 1][0] * len(own) / k)
            assert abs(got[own[k - 1][1]] - least) < 1e-12
    assert got[999] is None


def test_meta_rows_meet_one_dossier(spark):
    from quire.functions import scalars
    from quire.operators import manifest as M

    pages = spark.createDataFrame([("a-1", 1), ("a-1", 2), ("b-2", 1), ("c-3", 1)], "dossier string, page_num int")
    meta = spark.createDataFrame([(1, 5), (2, 6)], "identifier long, num_docs int")
    kept, out = M.matched_meta(pages, meta, scalars.identifier)
    assert sorted(tuple(r) for r in out.collect()) == [("a-1", 1, 5), ("b-2", 2, 6)] and kept.count() == 3
    for bad in ([(9, 1)], [(3, 1), (1, 1), (4, 1)]):
        with pytest.raises(Exception, match="not one dossier"):
            M.matched_meta(pages, spark.createDataFrame(bad, "identifier long, num_docs int"), scalars.identifier)[1].collect()
    with pytest.raises(Exception, match="not one dossier"):
        M.matched_meta(pages.union(spark.createDataFrame([("z-1", 1)], pages.schema)), meta, scalars.identifier)[1].collect()
    assert M.matched_meta(pages, meta.limit(0), scalars.identifier)[1].count() == 0


def test_masked_rows_and_absent_classes(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (-100, 1), (None, 1), (1, None)], "type int, predicted_type int").selectExpr("*", "-100 AS other", "0 AS predicted_other")
    got = {r["task"]: r for r in E.masked_accuracy(rows, ["type", "other"], {"type": 3, "other": 2}).collect()}
    assert got["type"]["n"] == 3 and abs(got["type"]["accuracy"] - 1 / 3) < 1e-12 and abs(got["type"]["macro_f1"] - (2 / 3) / 3) < 1e-12
    assert got["other"]["n"] == 0 and got["other"]["accuracy"] is None and got["other"]["macro_f1"] is None
