from pyspark.sql import functions as F

from quire.operators import composition, imputation, metrics, segments, segmetrics

PAGES = "dossier string, page_num int, start_page string"


def flags(spark):
    rows = [("A", i + 1, f) for i, f in enumerate("TFTFF")] + [("B", i + 1, f) for i, f in enumerate("TFT")] + [("C", i + 1, f) for i, f in enumerate("FFTF")]
    return spark.createDataFrame([(d, p, "yes" if f == "T" else "no") for d, p, f in rows], PAGES)


def test_resegmentation_in_any_row_order(spark):
    for df in (flags(spark), flags(spark).orderBy(F.hash("dossier", "page_num"))):
        got = {(r["dossier"], r["page_num"]): r["seg"] for r in segments.segmented(df).collect()}
        assert [got["A", i] for i in range(1, 6)] == [0, 0, 1, 1, 1]
        assert [got["B", i] for i in range(1, 4)] == [0, 0, 1]
        assert [got["C", i] for i in range(1, 5)] == [0, 0, 1, 1]
        assert len(set(segments.segments(segments.segmented(df)).collect())) == 6


def test_start_rules(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, " Yes\t"), ("A", 3, "YES"), ("A", 4, "yes")], PAGES)
    for rule, want in (("trim", [0, 1, 2, 3]), ("lower", [0, 0, 1, 2]), ("exact", [0, 0, 0, 1])):
        assert [r["seg"] for r in segments.segmented(df, rule=rule).orderBy("page_num").collect()] == want


def test_iou_of_a_half_is_no_match(spark):
    df = spark.createDataFrame([("A", 1, 1, 1), ("A", 2, 1, 2)], "dossier string, page_num int, true_head int, pred_head int")
    r = segmetrics.stream_quality(df).first()
    assert (r["tp"], r["fp"], r["fn"]) == (0, 2, 1) and r["pq"] == 0


def test_predicted_only_dossiers_are_ignored(spark):
    df = spark.createDataFrame([("A", 1, 1, 1), ("B", 1, None, 1)], "dossier string, page_num int, true_head int, pred_head int")
    assert segmetrics.panoptic_quality(segmetrics.stream_quality(df)).first()["n_streams"] == 1


def test_las_counts_two_missing_labels_as_equal(spark):
    df = spark.createDataFrame([("A", 1, 1, 1, None, None), ("A", 2, 1, 1, None, None)], "dossier string, page_num int, true_head int, pred_head int, t string, p string")
    r = segmetrics.attachment_scores(segmetrics.attachment_rows(df, "t", "p")).first()
    assert r["uas"] == r["las"] == 1.0


def test_majority_ties(spark):
    df = spark.createDataFrame([("A", 1, "yes", "b", 0.5), ("A", 2, "no", "a", 0.5), ("A", 3, "no", None, None)], PAGES + ", t string, c double")
    seg = segments.segmented(df)
    assert segments.labelled(seg, "t").first()["label"] == "a"  # by count: the least
    assert segments.documents(seg, "t", "c").first()["type"] == "b"  # by confidence: the first


def test_segment_without_labels(spark):
    df = spark.createDataFrame([("A", 1, "yes", None)], PAGES + ", t string")
    assert segments.labelled(segments.segmented(df), "t").first()["label"] is None


def test_dispersion_needs_two_segments(spark):
    segs = spark.createDataFrame([("A", "x", 0), ("A", "y", 1), ("B", "x", 0), ("B", "y", 1), ("B", "x", 2)], "dossier string, type string, order_in_dossier int")
    rows = composition.dispersion(composition.runs(segs)).collect()
    assert [(r["type"], r["n_qualifying"]) for r in rows] == [("x", 1)]


def test_run_moments_by_enumeration():
    from itertools import combinations

    n, k = 8, 3
    runs = [sum(i - 1 not in c for i in c) for c in map(set, combinations(range(n), k))]
    mean = sum(runs) / len(runs)
    assert abs(mean - k * (n - k + 1) / n) < 1e-12
    assert abs(sum((r - mean) ** 2 for r in runs) / len(runs) - k * (k - 1) * (n - k) * (n - k + 1) / (n * n * (n - 1))) < 1e-12


def test_mantel_haenszel_without_a_cell(spark):
    counts = spark.createDataFrame([("1", "a", 1), ("1", "b", 1), ("2", "a", 1), ("2", "b", 1)], "dossier string, type string, n long")
    r = composition.mantel_haenszel(counts, counts.select("dossier").distinct(), spark.createDataFrame([("a",), ("b",)], "type string"), 2).first()
    assert r["log_or"] is None and r["var_log_or"] is None


def test_special_functions(spark):
    df = spark.createDataFrame([(1.0,), (10.0,)], "x double")
    rows = df.select(composition.digamma("x").alias("d"), composition.trigamma("x").alias("t")).collect()
    assert abs(rows[0]["d"] + 0.5772156649) < 1e-9 and abs(rows[1]["d"] - 2.2517525891) < 1e-9 and abs(rows[0]["t"] - 1.6449340668) < 1e-8


def test_out_of_vocabulary_predictions_are_misses(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("q", "a")], "t string, p string")
    r = metrics.summary(metrics.per_class(metrics.confusion(df, "t", "p"), classes=spark.createDataFrame([("a",), ("b",)], "label string"))).first()
    assert r["n"] == 2 and r["accuracy"] == 0.5 and r["n_classes"] == 2 and abs(r["macro_f1"] - (2 / 3) / 2) < 1e-12


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, F.col("y") == 1, "s").first()["auc"] == 0.875
    assert metrics.roc_auc(df.filter("y = 1"), F.col("y") == 1, "s").first()["auc"] is None


def test_drawing_the_last_class(spark):
    steps = spark.createDataFrame([(0, "p", "a", 0.25), (0, "p", "b", 0.75)], "draw int, pred string, true string, w double")
    cum = imputation.cumulative(steps, ("draw",))
    got = cum.select(imputation.drawn(F.col("steps"), F.lit(0.2499)).alias("x"), imputation.drawn(F.col("steps"), F.lit(0.25)).alias("y"), imputation.drawn(F.col("steps"), F.lit(0.9999999999999999)).alias("z")).first()
    assert tuple(got) == ("a", "b", "b")


def test_joint_counts_take_all_draws(spark):
    """The reference's 200; five were taken, in which a percentile of 3 or 97 is the least or largest."""
    from quire import catalog

    got = catalog.QUERIES["impute_joint_counts"](spark, "/root/testdata/sf0.001")
    per = {r["draw"]: r["k"] for r in got.groupBy("draw").agg(F.count_distinct("dossier").alias("k")).collect()}
    assert sorted(per) == list(range(200)) and len(set(per.values())) == 1


def test_counts_of_draws_are_those_of_imputed_documents(spark, monkeypatch):
    """Ties, one-page dossiers, nulls, types without a correction, draws that lack one, dossiers of more pages than are held at once."""
    kinds = ["a", "b", "c", "unknown", None]
    rows = [(None if g == 6 else f"d{g}", p, ["yes", "no", None, "no", "x"][(p * 7 + g) % 5], kinds[(p * p + g) % 5], [0.5, 0.5, None, 0.25, 0.75, float("nan")][(p + g * g) % 6])
            for g in range(7) for p in range(1, 2 + 6 * g)]
    pages = spark.createDataFrame(rows[::-1], "dossier string, page_num int, predicted_start_page string, type string, document_type_confidence double")
    starts = [(d, p, t, w) for d in range(9) for p, t, w in [("yes", "no", 0.2), ("yes", "yes", 0.8), ("no", "no", 0.7), ("no", "yes", 0.3)] if not (d == 3 and p == "no") and not (d == 4 and (p, t) == ("yes", "yes"))]
    types = [(d, p, t, 0.6 if p == t else 0.2) for d in range(12) for p in "abc" for t in "abc" if d != 5 and not (d == 6 and p == "b")]
    starts, types = spark.createDataFrame(starts, "draw long, pred string, true string, w double"), spark.createDataFrame(types, "draw long, pred string, true string, w double")
    want = sorted(map(tuple, imputation.draw_counts(imputation.imputed_documents(pages, starts, types, "s")).collect()), key=str)
    assert {r[0] for r in want} == {0, 1, 2, 3, 4, 6, 7, 8} and None in {r[1] for r in want}
    for held in (200_000, 40):
        monkeypatch.setattr(imputation, "_AT_ONCE", held)
        assert sorted(map(tuple, imputation.imputed_counts(pages, starts, types, "s").collect()), key=str) == want
    assert imputation.imputed_counts(pages.filter("page_num < 0"), starts, types, "s").count() == 0


def test_page_budget(spark):
    import pytest

    df = spark.createDataFrame([("a", 3, 0.1), ("b", 3, 0.2), ("c", 2, 0.3), ("d", 5, 0.4)], "dossier string, n_pages int, u double")
    assert {r["dossier"]: r["batch"] for r in segments.page_budget_batches(df, 5).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    with pytest.raises(ValueError):
        segments.page_budget_batches(df, 4)


def test_empty_tables(spark):
    empty = flags(spark).filter("page_num < 0").withColumn("predicted_start_page", F.col("start_page"))
    both = segmetrics.both(empty)
    r = segmetrics.panoptic_quality(segmetrics.stream_quality(both)).first()
    assert (r["pq"], r["n_streams"]) == (0.0, 0)


def test_probabilities_that_round_to_a_half_are_no_starts(spark, tmp_path, monkeypatch):
    from quire import catalog
    from quire.sources import fixtures

    real = fixtures.u
    monkeypatch.setattr(fixtures, "u", lambda c, salt: F.lit(0.9999999) if salt == "sp" else real(c, salt))
    rows = [(i, 1, "view", 1.0, i) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts long").write.parquet(str(tmp_path / "events.parquet"))
    flags = {r["page_num"]: r["predicted_start_page"] for r in fixtures.event_pages(spark, str(tmp_path)).collect()}
    got = {r["page_num"]: r["predicted_start_page"] for r in catalog.QUERIES["predict_two_stage"](spark, str(tmp_path)).collect()}
    assert got == flags and set(flags.values()) == {"yes", "no"}
