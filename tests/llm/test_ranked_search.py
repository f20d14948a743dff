import math
import random
import re

import numpy as np
import pytest

from quire.llm import ranked_search
from quire.llm.ranked_search import Index, accumulate, radix_order, rank

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=10):
    docs = [(i, terms_of(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n_docs, total = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for x, d in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, t in docs:
            m = 10 + 90 * len(t) * n_docs // total
            s = sum(w[x] * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in wanted & set(t))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


def result(df):
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()], key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_radix_order_and_sums():
    r = np.random.default_rng(1)
    for top in (1, 100, 1 << 20, 1 << 40):
        keys = r.integers(0, top, 5000)
        assert np.array_equal(radix_order(keys), np.argsort(keys, kind="stable"))
    item, doc, impact = r.integers(0, 7, 900), r.integers(0, 11, 900), r.integers(0, 10**12, 900)
    want = {}
    for i, d, x in zip(item, doc, impact):
        want[i, d] = want.get((i, d), 0) + x
    got = accumulate(item, doc, impact, 11)
    assert list(zip(*(x.tolist() for x in got))) == [(i, d, x) for (i, d), x in sorted(want.items())]
    assert len(accumulate(item[:0], doc[:0], impact[:0], 11)[0]) == 0


def test_index_finds_its_terms_only():
    index = Index(["Some words, some twice", "", "words ÄÖ 12"])
    assert len(index) == 5 and len(index.items) == 6
    assert set(index.find(index.h1, index.h2)) == set(range(5))
    assert set(index.find(index.h1, index.h2 + np.uint64(1))) == {-1}
    empty = Index([])
    assert len(empty) == 0 and list(empty.find(index.h1, index.h2)) == [-1] * 5


@pytest.mark.parametrize("entries, group", [(2 << 20, 4 << 20), (50, 300)])
def test_against_brute_force(spark, docs_of, prose, monkeypatch, entries, group):
    monkeypatch.setattr(ranked_search, "ENTRIES", entries)
    r = random.Random(3)
    docs = [(i if i % 7 else 7, t.replace("a", "A") if i % 3 else t + ".Über-" + t[:20]) for i, t in enumerate(prose(150, 3, words=80))]
    docs += [(500 + i, docs[0][1]) for i in range(15)]  # ties
    items = [(i % 25, " ".join(r.sample(t.split(), min(6, len(t.split()))))) for i, t in enumerate(prose(30, 3, words=80))]
    got = rank(docs_of(spark, docs).repartition(5), items_of(spark, items), group_bytes=group)
    assert result(got) == brute(docs, items)


def test_odd_rows(spark, docs_of, odd_rows):
    items = [(1, "word1 WORD2 a"), (2, None), (3, ""), (None, "b, c"), (1, "word3"), (4, "nowhere")]
    want = brute(odd_rows, items)
    assert {i for i, *_ in want} == {1, None} and result(rank(docs_of(spark, odd_rows), items_of(spark, items))) == want


def test_empty_tables_and_clashing_columns(spark, docs_of):
    items = items_of(spark, [(1, "a b"), (2, "c")])
    assert rank(docs_of(spark, []), items).count() == 0
    assert rank(docs_of(spark, [(1, "a")]), items_of(spark, [])).count() == 0
    docs = docs_of(spark, [(1, "a x"), (2, "b a"), (3, "y")])
    for c in ("item_id", "rank", "score", "id", "kind", "terms", "tf", "n", "_id", "_body"):
        docs, items = docs.selectExpr("*", f"'{c}' AS {c}"), items if c == "item_id" else items.selectExpr("*", f"'{c}' AS {c}")
    assert result(rank(docs, items)) == brute([(1, "a x"), (2, "b a"), (3, "y")], [(1, "a b"), (2, "c")])
