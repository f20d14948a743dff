import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import exact_dedup as E


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1).map(lambda x: x % 97 * 0x02A3B4C5D6E7F801 % (1 << 64)), max_size=80), st.lists(st.integers(0, 50).map(lambda x: x * 0x0400000000000003 % (1 << 64)), max_size=80))
def test_filters_merge_losslessly(a, b):
    f, g = (E.CountingQuotientFilter.of(np.array(x, np.uint64)) for x in (a, b))
    m = f.merge(g)
    want = Counter(a) + Counter(b)
    assert dict(zip(m.fingerprints().tolist(), m.counts.tolist())) == want and m.fingerprints().tolist() == sorted(want)
    if want:
        back = E.CountingQuotientFilter.from_bytes(m.to_bytes())
        assert back.fingerprints().tolist() == m.fingerprints().tolist() and back.counts.tolist() == m.counts.tolist()
        parts = [E.CountingQuotientFilter.from_bytes(p.to_bytes()) for _, p in m.split(7)]
        assert np.concatenate([p.fingerprints() for p in parts]).tolist() == m.fingerprints().tolist()


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, kept = (max(known) if known else None), False
        for i in ids:
            k = i == keep and not kept
            kept |= k
            out.append((i, keep, len(ids), k, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs_of, odd_rows, prose):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(prose(60) * 2)]
    got = E.mark_copies(docs_of(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_many_repeated_fingerprints_take_the_shuffle(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(E, "fits", lambda *a: False)
    rows = [(k, t) for k, t in enumerate(prose(30) * 3)]
    got = E.mark_copies(docs_of(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_and_clashing_columns(spark, docs_of):
    from pyspark.sql import functions as F

    assert E.mark_copies(docs_of(spark, [])).count() == 0
    df = docs_of(spark, [(1, "x"), (2, "x")]).withColumns({"kept": F.lit("mine"), "fp": F.lit(1), "sha": F.lit(2)})
    out = E.drop_copies(df)
    assert out.columns == df.columns and [tuple(r)[:2] + (r["kept"],) for r in out.collect()] == [(2, "x", "mine")]
