import math
import os
import subprocess
import sys
import textwrap
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import metrics, network, sequences, trees
from quire.plans.runner import Ledger, run_jobs
from quire.sources import cache, lines

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 3, 600)
    a, b = rng.standard_normal((600, 4)) * 0.4, rng.standard_normal((600, 3)) * 0.4
    a[np.arange(600), label] += 2
    rows = [(i, int(y), x.tolist(), z.tolist(), "train" if i < 400 else "val" if i < 500 else "test") for i, (y, x, z) in enumerate(zip(label, a, b))]
    return spark.createDataFrame(rows + [(600, None, [0.0] * 4, [0.0] * 3, "train"), (601, 1, None, [0.0] * 3, "train")], "id long, y int, a array<double>, b array<double>, split string").cache()


def test_separable_classes_are_told_apart(vectors):
    rows = vectors.filter("y IS NOT NULL AND a IS NOT NULL").withColumn("v", F.concat("a", "b"))
    clear = rows.withColumn("v", F.array([(F.col("y") == k).cast("double") for k in range(3)] + [F.col("b")[0]]))
    model = trees.boosted(clear.filter("split = 'train'"), clear.filter("split = 'val'"), "v", "y", 3, trees.Settings(rounds=5, depth=2, rate=0.5, rows=1.0, features=1.0))
    out = model.scored(clear, "v").collect()
    assert len(out) == 600 and all(r["predicted"] == r["y"] and abs(sum(r["probs"]) - 1) < 1e-9 and r["probability"] == max(r["probs"]) for r in out)


def test_boosting_stops_early_and_comes_back(spark, vectors, tmp_path):
    rows = vectors.withColumns({"v": F.concat("a", "b"), "z": (F.col("y") == 1).cast("int")})
    settings = trees.Settings(rounds=40, depth=2, rate=0.3, tolerance=0.2)
    early = trees.boosted(rows.filter("split = 'train'"), rows.filter("split = 'val'"), "v", "z", 2, settings)
    assert early.models[0].getNumTrees < 40
    again = trees.boosted(rows.filter("split = 'train'").repartition(3), rows.filter("split = 'val'"), "v", "z", 2, settings)
    test = rows.filter("split = 'test'")
    got = {r["id"]: r["probs"] for r in early.scored(test, "v").collect()}
    hits = sum((p[1] > 0.5) == (r["z"] == 1) for r in test.collect() for p in [got[r["id"]]])
    assert hits >= 92 and len(again.models) == 1
    early.save(spark, str(tmp_path / "model"))
    back = trees.BoostedTrees.load(spark, str(tmp_path / "model"))
    assert {r["id"]: r["probs"] for r in back.scored(test, "v").collect()} == got
    assert math.isclose(trees.positive_weight(rows.filter("z IS NOT NULL"), "z"), rows.filter("z = 0").count() / rows.filter("z = 1").count())
    with pytest.raises(ValueError):
        trees.boosted(rows.filter("false"), None, "v", "z", 2)


def test_forest(vectors):
    rows = vectors.withColumn("v", F.concat("a", "b"))
    model = trees.forest(rows.filter("split = 'train'"), "v", "y", 15, 5)
    out = trees.forest_scored(model, rows.filter("split = 'test'"), "v").collect()
    assert sum(r["predicted"] == r["y"] for r in out) >= 92 and all(len(r["probs"]) == 3 for r in out)


def test_gradient_is_a_derivative():
    rng = np.random.default_rng(1)
    w = [rng.standard_normal((5, 4)), rng.standard_normal(4), rng.standard_normal((4, 3)), rng.standard_normal(3)]
    x, y, cw = rng.standard_normal((7, 5)), rng.integers(0, 3, 7), np.array([0.5, 1.0, 1.5])
    _, grad = network._gradient(w, x, y, cw)
    for i in range(4):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w[i].shape)
            up, down = [a.copy() for a in w], [a.copy() for a in w]
            up[i][at] += 1e-6
            down[i][at] -= 1e-6
            assert abs(grad[i][at] - (network._gradient(up, x, y, cw)[0] - network._gradient(down, x, y, cw)[0]) / 2e-6) < 1e-6


def test_network_keeps_its_best_epoch(spark, vectors):
    s = network.Settings(hidden=16, epochs=5, rate=1e-2, shards=4)
    train, valid = vectors.filter("split = 'train'"), vectors.filter("split = 'val'")
    net = network.fit(train, valid, ["a", "b"], "y", 3, ["id"], s)
    history = net.epochs(spark)
    best = metrics.best_epoch(history, "score").first()
    assert net.epoch == best["epoch"] and [r["epoch"] for r in history.orderBy("epoch").collect()] == [1, 2, 3, 4, 5]
    out = net.scored(vectors.filter("split = 'test'"), ["a", "b"]).collect()
    assert sum(r["predicted"] == r["y"] for r in out) >= 90
    kept = net.scored(valid, ["a", "b"])
    assert abs(network.validation_score(kept, "y", 3) - best["score"]) < 1e-12
    same = network.fit(train.repartition(7), valid.repartition(2), ["a", "b"], "y", 3, ["id"], s)
    assert all(np.allclose(p, q, atol=1e-12) for p, q in zip(net.weights, same.weights)) and same.epoch == net.epoch
    more = network.fit(train, valid, ["a", "b"], "y", 3, ["id"], network.Settings(hidden=16, epochs=1, rate=1e-3, shards=4), start=net)
    assert more.history[0][1] < net.history[0][1]
    with pytest.raises(ValueError):
        network.fit(train.filter("false"), valid, ["a", "b"], "y", 3, ["id"], s)


def test_chunks_of_ragged_sequences(spark):
    pages = [("a", p, [float(p), 1.0], p % 3) for p in (5, 1, 9, 3, 7)] + [("b", 2, None, None), (None, 1, [0.0, 0.0], 1), ("c", 1, [1.0, 2.0], 0), ("c", 2, [3.0, 4.0], 1)]
    df = spark.createDataFrame(pages, "dossier string, page_num int, v array<double>, y int").repartition(3)
    got = {(r["dossier"], r["chunk"]): r for r in sequences.chunks(df, "v", "y", 2, 2).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)}
    a = got["a", 2]
    assert a["length"] == 5 and a["n"] == 1 and a["features"] == [9.0, 1.0, 0.0, 0.0] and a["mask"] == [True, False] and a["labels"] == [0, -1]
    assert got["a", 0]["features"] == [1.0, 1.0, 3.0, 1.0] and got["b", 0]["features"] == [0.0] * 4 and got["b", 0]["mask"] == [True, False] and got["b", 0]["labels"] == [-1, -1]
    with pytest.raises(Exception, match="another length"):
        sequences.chunks(df.withColumn("v", F.array(F.lit(1.0))), "v", "y", 2, 2).collect()
    assert sequences.chunks(df.filter("false"), "v", None, 2, 2).count() == 0


def test_a_long_dossier_and_a_model_over_chunks(spark):
    df = spark.range(100_000).select(F.when(F.col("id") < 99_000, "long").otherwise("short").alias("dossier"), F.col("id").alias("page_num"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    padded = sequences.chunks(df, "v", None, 64, 2).cache()
    assert padded.agg(F.max("n")).first()[0] == 64 and padded.filter("dossier = 'long'").count() == math.ceil(99_000 / 64)

    def make():
        return lambda x, mask: np.stack([x[:, :, 0] * mask, 1 - x[:, :, 1]], axis=2)

    out = sequences.predicted(padded, make, 64, 2, 2)
    assert out.count() == 100_000
    bad = out.filter("(dossier = 'long' AND probs[0] <> page) OR (dossier = 'short' AND probs[0] <> page + 99000) OR probs[1] <> 0")
    assert bad.isEmpty()


def test_one_header_and_all_kinds_of_fields(spark, tmp_path):
    rows = [(1, "plain"), (2, None), (3, ""), (4, 'a "quoted"\tfield'), (5, "two\nlines"), (None, "k\tv")]
    df = spark.createDataFrame(rows * 50, "k\tey long, v string".replace("\t", "")).repartition(4)
    path = str(tmp_path / "out")
    lines.write_lines(df, path, rows_per_chunk=20)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    whole = "".join(open(f"{path}/{f}").read() for f in files)
    assert whole.startswith("key\tv\n") and whole.count("key\tv\n") == 1 and len(files) > 15
    back = lines.read_lines(spark, path, "key long, v string")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    import csv

    parsed = list(csv.reader(whole.splitlines(keepends=True), delimiter="\t"))
    assert len(parsed) == 301 and ["4", 'a "quoted"\tfield'] in parsed
    lines.write_lines(df.filter("false"), str(tmp_path / "empty"))
    assert lines.read_lines(spark, str(tmp_path / "empty"), "key long, v string").count() == 0


def test_a_task_tried_again_leaves_no_row_twice(tmp_path):
    code = f"""
        import sys; sys.path.insert(0, {HERE!r})
        from pyspark.sql import SparkSession
        from quire.sources import lines
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
        def flaky(batches):
            from pyspark import TaskContext
            for i, b in enumerate(batches):
                yield b
                if i == 1 and TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() % 2:
                    raise RuntimeError("lost")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
        df = spark.range(1000).repartition(4).mapInArrow(flaky, "id long")
        lines.write_lines(df, {str(tmp_path / "out")!r}, rows_per_chunk=30)
        print("rows", lines.read_lines(spark, {str(tmp_path / "out")!r}, "id long").distinct().count(), spark.read.text({str(tmp_path / "out")!r}).count())
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": HERE})
    assert "rows 1000 1001" in out.stdout, out.stderr[-2000:]


def _embedder(log):
    def make():
        def run(b):
            with open(log, "a") as f:
                f.writelines(f"{p}:{t}\n" for p, t in zip(b["pass"], b["text"]))
            return np.stack([b["text"].fillna("").str.len(), b["pass"]], axis=1) if len(b) else np.zeros((0, 2))

        return run

    return make


def test_only_new_contents_are_embedded(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "")], "id long, text string")
    first, f = cache.build(df, path, "m", _embedder(log), ["text"], 2, ["id"], 2)
    assert f == {"rows": 10, "empty": 4, "distinct": 6, "embedded": 6} and len(open(log).read().splitlines()) == 6
    assert sorted((r["id"], r["pass"], r["v"]) for r in first.collect()) == [(i, p, [float(n), float(p)]) for i, n in ((1, 2), (2, 1), (3, 2), (4, 0), (5, 0)) for p in (0, 1)]
    more = df.filter("id < 3").unionAll(spark.createDataFrame([(6, "ccc")], df.schema))
    second, f = cache.build(more, path, "m", _embedder(log), ["text"], 2, ["id"], 2)
    assert f["embedded"] == 2 and sorted((r["id"], r["v"][0]) for r in second.filter("pass = 0").collect()) == [(1, 2.0), (2, 1.0), (6, 3.0)]
    _, f = cache.build(more, path, "other", _embedder(log), ["text"], 2, ["id"], 1)
    assert f["embedded"] == 3
    again, f = cache.build(more, path, "m", _embedder(log), ["text"], 2, ["id"], 1, force=True)
    assert f["embedded"] == 3 and again.count() == 3
    third, f = cache.build(df, path, "m", _embedder(log), ["text"], 2, ["id"], 2)
    assert f["embedded"] == 0 and third.count() == 10
    mean = {r["id"]: r["v"] for r in cache.mean_over_passes(third, ["id"]).collect()}
    assert mean[1] == [2.0, 0.5]
    with warnings.catch_warnings(record=True) as got:
        warnings.simplefilter("always")
        cache.build(df.filter("id > 3"), path, "m", _embedder(log), ["text"], 2, ["id"])
    assert any("2 of 2 contents are empty" in str(w.message) for w in got)


def test_jobs_run_once_and_failed_ones_again(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Lock

    done, lock, broken = [], Lock(), {"j3"}

    def run(job):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        if job in broken:
            raise RuntimeError("no luck")
        spark.range(10).count()
        with lock:
            done.append(job)

    jobs, folder = [f"j{i}" for i in range(12)], str(tmp_path / "ledger")
    with ThreadPoolExecutor(2) as two:
        a, b = two.map(lambda _: run_jobs(spark, jobs, run, folder, 3), range(2))
    assert sorted(done) == sorted(set(jobs) - broken)
    assert all({a[j], b[j]} == {"done", "skipped"} for j in jobs if j != "j3") and "failed" in {a["j3"], b["j3"]}
    states = {r["job"]: r for r in Ledger(spark, folder).states().collect()}
    assert states["j3"]["state"] == "failed" and "no luck" in states["j3"]["error"] and len(states) == 12
    broken.clear()
    assert run_jobs(spark, jobs, run, folder)["j3"] == "done" and sorted(done) == sorted(jobs)
    assert set(run_jobs(spark, jobs, run, folder).values()) == {"skipped"}
    assert run_jobs(spark, jobs[:2], run, folder, force=True) == {"j0": "done", "j1": "done"} and len(done) == 14
    assert {r["state"] for r in Ledger(spark, folder).states().collect()} == {"done"}


def test_a_dead_runners_claim_is_taken_over(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.claim("x") and not ledger.claim("x") and not ledger.claim("x", stale=3600)
    assert run_jobs(spark, ["x"], lambda j: None, str(tmp_path / "ledger")) == {"x": "skipped"}
    os.utime(next((tmp_path / "ledger").glob("*.claimed")), (1, 1))
    assert run_jobs(spark, ["x"], lambda j: None, str(tmp_path / "ledger"), stale=3600) == {"x": "done"}
    calls = []

    def twice(job):
        calls.append(job)
        if len(calls) < 2:
            raise RuntimeError

    assert run_jobs(spark, ["y"], twice, str(tmp_path / "ledger"), attempts=2) == {"y": "done"}


def test_contents_are_neither_written_nor_multiplied_by_passes(spark, tmp_path, monkeypatch):
    written, save = [], cache.saved
    monkeypatch.setattr(cache, "saved", lambda df: written.append(df.columns) or save(df))
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b c"), (4, None)], "doc_id long, text string")
    make = lambda: lambda b: np.stack([b["text"].fillna("").str.len(), b["pass"]], axis=1) if len(b) else np.zeros((0, 2))
    out, figures = cache.build(docs, str(tmp_path / "c"), "m", make, ["text"], 2, ["doc_id"], 3)
    assert figures == {"rows": 12, "empty": 3, "distinct": 9, "embedded": 9} and all("text" not in columns for columns in written)
    got = {(r["doc_id"], r["pass"]): r["v"] for r in out.collect()}
    assert got == {(i, k): [float(n), float(k)] for i, n in ((1, 1), (2, 1), (3, 3), (4, 0)) for k in range(3)}
    assert cache.build(docs, str(tmp_path / "c"), "m", make, ["text"], 2, ["doc_id"], 4)[1]["embedded"] == 3
