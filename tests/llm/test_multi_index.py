import heapq

import numpy as np
import pytest

from quire.llm import multi_index as I

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=5):
    out = {}
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, np.float32).astype(float))
    for q in queries:
        if q in ok:
            s = [(-float((ok[q] * v).sum() / np.sqrt((v**2).sum()) / np.sqrt((ok[q] ** 2).sum())), i) for i, v in ok.items() if i != q]
            out[q] = [i for _, i in heapq.nsmallest(k, s)]
    return out


def test_walk_is_by_rising_distance():
    r = np.random.default_rng(0)
    a, b = r.random(9), r.random(7)
    cells = I.walk(a, b, np.ones(63, np.int64), 63)
    d = [(a[c // 7] + b[c % 7]) for c in cells]
    assert len(set(cells)) == 63 and d == sorted(d)
    assert I.walk(a, b, np.ones(63, np.int64), 5) == cells[:5]


def test_only_walked_cells_are_scored():
    r = np.random.default_rng(3)
    rows, ids, cells = r.normal(size=(200, 6)), np.arange(200), r.integers(0, 12, 200)
    queries, walked = r.normal(size=(30, 6)), [np.unique(r.integers(0, 12, r.integers(0, 6))).astype(np.int32) for _ in range(30)]
    got = {}
    for q, row, s in I.best(queries, np.arange(1000, 1030), rows, ids, 4, cells, walked):
        got.setdefault(q - 1000, []).append((row, round(s, 12)))
    for q in range(30):
        inside = [i for i in range(200) if cells[i] in walked[q]]
        cos = {i: float(rows[i] @ queries[q] / np.linalg.norm(rows[i]) / np.linalg.norm(queries[q])) for i in inside}
        assert got.get(q, []) == [(i, round(cos[i], 12)) for i in sorted(inside, key=lambda i: (-cos[i], i))[:4]]


def test_clustered_vectors_take_a_small_share(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(60, 8))
    rows = [(i, (centres[i % 60] + 0.05 * r.normal(size=8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame([(i, v, "mine", "other") for i, v in rows], "vec_id long, embedding array<float>, cell string, block string")
    index = I.build(df, 5)
    found = I.search(index, index.rows.filter("vec_id % 50 = 0").select("vec_id", "vec")).collect()
    want = brute(rows, range(0, 3000, 50))
    hits = sum(x["vec_id"] in want[x["query_id"]] for x in found)
    assert hits / (5 * len(want)) >= 0.9 and len({x["query_id"] for x in found}) == 60
    assert np.mean([x["n_scored"] for x in found]) / 3000 < 0.2


@pytest.mark.parametrize("block, part", [(4096, 4096), (16, 4096), (64, 3)])
def test_recall_and_scores(spark, monkeypatch, block, part):
    monkeypatch.setattr(I, "BLOCK_ROWS", block)
    monkeypatch.setattr(I, "PART_QUERIES", part)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(500)] + [(600 + i, [1.0] * 8) for i in range(60)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] + [1.0] * 7), (703, [None] + [1.0] * 7), (704, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    index = I.build(df, 5)
    assert index.total == 560
    q = index.rows.filter("vec_id % 50 = 0").select("vec_id", "vec")
    got = {}
    for x in I.search(index, q).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x)
    want = brute(rows, range(0, 800, 50))
    assert set(got) == set(want)
    assert np.mean([len({x["vec_id"] for x in got[i]} & set(want[i])) / 5 for i in want]) >= 0.9
    assert [x["vec_id"] for x in got[600]] == [601, 602, 603, 604, 605]  # ties to the least id
    assert all([x["rank"] for x in xs] == [1, 2, 3, 4, 5] for xs in got.values())
    whole = I.build(df, 5, share=1.0)
    exact = {}
    for x in I.search(whole, whole.rows.filter("vec_id % 50 = 0").select("vec_id", "vec")).orderBy("query_id", "rank").collect():
        exact.setdefault(x["query_id"], []).append(x["vec_id"])
    assert exact == want


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (3, [1.0, 1.0], 1)], SCHEMA)
    index = I.build(df, 5)
    got = I.search(index, index.rows.select("vec_id", "vec")).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"]) for x in got) == [(0, 1, 3), (3, 1, 0)]
    empty = I.build(df.filter("false"), 5)
    assert I.search(empty, empty.rows.select("vec_id", "vec")).count() == 0


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist(), 0) for i in range(60)], SCHEMA)
    other = df
    for c in ("id", "v", "query_id", "rank", "score", "cell", "part", "row", "_id", "_v", "block"):
        other = other.withColumn(c, F.lit("x"))
    indexes = [I.build(d, 5) for d in (df, other)]
    a, b = (sorted((x["query_id"], x["rank"], x["vec_id"]) for x in I.search(i, i.rows.filter("vec_id < 9").select("vec_id", "vec")).collect()) for i in indexes)
    assert a == b and len(a) == 45
