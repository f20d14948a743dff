import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm.byte_words import buffers
from quire.llm.collocations import Lists, Slice, _cut_long, mine

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, best, least, longest=4, covered=80):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    many = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    over = Counter()
    for (lang, p), c in many.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    over[lang, p[i:j]] = max(c, over[lang, p[i:j]])
    out = []
    for (lang, p), a in many.items():
        if 100 * over[lang, p] >= covered * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(own[:best])]
    return ranked


def result(df):
    return sorted(tuple(r) for r in df.collect())


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string")


def some_rows(seed=2):
    r = random.Random(seed)
    vocabulary = [w.title() if i % 5 == 0 else w + "é" if i % 7 == 0 else w for i, w in enumerate("".join(r.choice("abcd") for _ in range(r.randint(1, 4))) for _ in range(40))]
    set_phrases = ["one two", "tic tac toe", "in the long run", "la la la la la la"]
    rows = []
    for _ in range(300):
        w = [r.choice(set_phrases) if r.random() < 0.2 else r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        rows.append(("".join(x + r.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for x in w), r.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("slice_bytes", [8 << 20, 300])
@pytest.mark.parametrize("least, best", [(30, 2000), (4, 25)])
def test_against_brute_force(spark, slice_bytes, least, best):
    rows = some_rows()
    want = brute(rows, best, least)
    assert len(want) > 10 and any(len(x[2].split()) == 4 for x in want)
    assert result(mine(table_of(spark, rows).repartition(4), best=best, least=least, slice_bytes=slice_bytes)) == sorted(want)


def test_all_collocations(spark):
    rows = some_rows(4)
    assert result(mine(table_of(spark, rows), best=None, least=10, longest=3, covered=60)) == sorted(brute(rows, None, 10, 3, 60))


def test_slices_come_back_from_bytes():
    texts = ["A b c. a B", "", "a\tb,c a b c a b"]
    data, offsets = buffers(pa.array(["x", *texts])[1:])
    s = Slice.of(data, offsets, ["de", "en"], np.array([0, 0, 1]))
    t = Slice.from_bytes(s.to_bytes())
    assert sorted(zip(s.words, s.lang.tolist())) == [(b"a", 0), (b"a", 1), (b"b", 0), (b"b", 1), (b"c", 0), (b"c", 1)]
    assert t.words == s.words and np.array_equal(t.postings.positions, s.postings.positions) and np.array_equal(t.lang, s.lang)
    lists, high, low = t.extended()
    got = Counter(dict(zip(t.spelled(lists.positions[lists.at[:-1]], 2), lists.lengths().tolist())))
    assert got == {("de", "a b"): 2, ("de", "b c"): 1, ("en", "a b"): 3, ("en", "b c"): 1, ("en", "c a"): 2}
    kept = t.pruned(2, lists, lists.lengths() > 1)
    u = Slice.from_bytes(kept.to_bytes())
    assert u.size == 2 and len(u.phrases) == 3 and u.words == kept.words and np.array_equal(u.phrases.positions, kept.phrases.positions)
    three, _, _ = u.extended()
    assert Counter(dict(zip(u.spelled(three.positions[three.at[:-1]], 3), three.lengths().tolist()))) == {("en", "c a b"): 2}


def test_lists_come_back_from_arrays():
    lists = Lists(np.array([0, 2, 2, 5]), np.array([3, 9, 0, 1, 70000]))
    back = Lists.from_arrays(*lists.to_arrays())
    assert np.array_equal(back.at, lists.at) and np.array_equal(back.positions, lists.positions)
    few = lists.only(np.array([False, True, True]))
    assert np.array_equal(few.at, [0, 0, 3]) and np.array_equal(few.positions, [0, 1, 70000])


@pytest.mark.parametrize("limit", [1, 5, 30, 10_000])
def test_long_texts_are_cut_at_breaks(limit):
    text = ", ".join(f"w{i} " * (i % 4) for i in range(60)) + "no break until here" * 3
    data, offsets = buffers(pa.array([text]))
    parts = [bytes(d[o[0] : o[-1]]).decode() for d, o in _cut_long(data, offsets, limit)]
    assert "".join(parts) == text and all(p[0] in ".,\n" for p in parts[1:]) and (limit > 1000) == (len(parts) == 1)


def test_odd_rows(spark, odd_rows):
    rows = [(t, None if i is None else "en" if i % 2 else "de") for i, t in odd_rows]
    want = brute(rows, 2000, 2)
    assert len(want) > 100 and result(mine(table_of(spark, rows), least=2)) == sorted(want)
    assert mine(table_of(spark, rows).filter("false")).count() == 0
    assert mine(table_of(spark, [(None, None), ("", "en")])).count() == 0


def test_clashing_columns(spark):
    rows = [("a b", "en")] * 3 + [("a b c", "de")] * 2
    docs = table_of(spark, rows)
    for c in ("slice", "state", "phrase", "size", "f", "n", "rank", "score", "_lang", "_body", "block"):
        docs = docs.withColumn(c, F.lit(c))
    assert result(mine(docs, least=2)) == sorted(brute(rows, 2000, 2))
