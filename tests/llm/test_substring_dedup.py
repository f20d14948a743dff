import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import byte_words
from quire.llm.byte_words import Scanner, buffers, in_slices
from quire.llm.substring_dedup import Windows, drop_repeats, mark_repeats

SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def brute(rows, words):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - words + 1):
                key = tuple(w[k : k + words])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - words + 1):
            if i is not None and least[tuple(w[k : k + words])] < i:
                gone |= set(range(k, k + words))
        spans = [k for k in sorted(gone) if k - 1 not in gone], [k + 1 for k in sorted(gone) if k + 1 not in gone]
        out.append((i, len(w), len(gone), list(zip(*spans)), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def result(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept_text) for r in df.collect()], key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 7, 16])
def test_words_and_their_hashes(monkeypatch, chunk):
    monkeypatch.setattr(byte_words, "_CHUNK", chunk)
    r = random.Random(chunk)
    scan = Scanner(bytes(set(range(256)) - set(SPACES)), LOWER)
    by = {}
    for _ in range(100):
        texts = ["".join(r.choice("aB é\n\tcd ") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 9))]
        data, offsets = buffers(pa.array(["left out", *texts], pa.string())[1:])
        found = scan.words(data, offsets)
        got = [(int(i), bytes(data[a:b])) for i, a, b in zip(found.text, found.first, found.end)]
        assert got == [(i, x) for i, t in enumerate(texts) for x in t.encode().split()]
        for (_, x), h in zip(got, zip(found.h1.tolist(), found.h2.tolist())):
            assert by.setdefault(x.translate(LOWER), h) == h
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("limit", [1, 10, 25, 1000])
def test_slices_keep_all_rows_and_the_limit(limit):
    r = random.Random(limit)
    texts = ["x" * r.randint(0, 30) for _ in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a : a + 7], pa.string())], names=["t"]) for a in range(0, 100, 7)]
    got = [b.column(0).to_pylist() for b in in_slices(batches, "t", limit)]
    assert [t for g in got for t in g] == texts
    assert all(len("".join(g)) <= limit or len([t for t in g if t]) == 1 for g in got)


def test_windows_are_equal_where_their_words_are():
    texts = ["a b c d e a b c d", "b c", "", "x a  b c\td"]
    data, offsets = buffers(pa.array(texts))
    w = Windows(data, offsets, 3)
    words = [t.split() for t in texts]
    by = {}
    for t, p, h in zip(w.text, w.place, zip(w.high.tolist(), w.low.tolist())):
        by.setdefault(h, set()).add(tuple(words[t][p : p + 3]))
    assert len(w.text) == 7 + 0 + 0 + 3 and len(by) == 6 and all(len(v) == 1 for v in by.values())
    assert np.array_equal(w.n_words, [9, 2, 0, 5])


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 200, "block_windows": 50}])
def test_against_brute_force(spark, docs_of, prose, sizes):
    r = random.Random(5)
    texts = prose(120, 5, words=60)
    passages = prose(4, 6)
    rows = []
    for i, t in enumerate(texts):
        w = t.split()
        if r.random() < 0.6:  # several times in one text, too
            for _ in range(r.randint(1, 3)):
                k = r.randint(0, len(w))
                w[k:k] = r.choice(passages).split()
        rows.append((r.randint(0, 80), " ".join(w) if r.random() < 0.8 else "\n\t".join(w)))
    rows += [(90, "a a a a a a a a a a a a"), (91, "b a a a a a a a c"), (92, "a a a a a")]
    want = brute(rows, 6)
    assert sum(x[2] for x in want) > 500
    assert result(mark_repeats(docs_of(spark, rows).repartition(5), words=6, **sizes)) == want


def test_odd_rows(spark, docs_of, odd_rows):
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [*odd_rows, (8, "x y z " + long), (9, "\x0b\x0c"), (None, long)]
    assert result(mark_repeats(docs_of(spark, rows), words=5)) == brute(rows, 5)


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert mark_repeats(docs_of(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (2, "x a b c d e f y"), (3, None)]
    docs = docs_of(spark, rows)
    for c in ("n_words", "kept_text", "_id", "_key", "_runs", "_body", "part", "block", "c0"):
        docs = docs.selectExpr("*", f"'{c}' AS {c}")
    got = {r.doc_id: r for r in mark_repeats(docs, words=6).collect()}
    assert got[2].kept_text == "x y" and got[2].n_removed == 6 and got[2]._key == "_key" and got[2].c0 == "c0" and got[1].n_removed == 0
    kept = drop_repeats(docs, words=6)
    assert kept.columns == docs.columns
    assert {r.doc_id: (r.text, r.kept_text) for r in kept.collect()} == {1: ("a b c d e f", "kept_text"), 2: ("x y", "kept_text"), 3: (None, "kept_text")}
