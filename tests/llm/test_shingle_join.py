import random
from itertools import combinations

import numpy as np
import pytest

from quire.llm import shingle_join as J
from quire.llm import signature_tree as T


def brute(rows, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(sets[x]), least.get(find(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


def variants(seed, groups=6, each=14):
    """Near copies whose similarity lies on both sides of the threshold, with passages that groups share."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [r.choice(words) for _ in range(25)]
    out = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(40, 90))]
        if r.random() < 0.7:
            at = r.randrange(len(base))
            base[at:at] = passage
        for _ in range(each):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("chunk, rounds", [(1000, 3), (3, 1), (2, 0), (4, 3)])
def test_variants_against_brute_force(spark, docs_of, chunk, rounds):
    rows = variants(chunk)
    got = J.join_shingles(docs_of(spark, rows), chunk=chunk, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_rows(spark, docs_of, odd_rows, prose):
    rows = odd_rows + [(50, "one two"), (51, "ONE\ttwo"), (52, "one two three"), (53, "é one two three four five"), (54, "É one two three four five")] + [(100 + k, t) for k, t in enumerate(prose(20))]
    got = J.join_shingles(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert J.join_shingles(docs_of(spark, [])).count() == 0


def test_one_of_each_group_stays(spark, docs_of):
    from pyspark.sql import functions as F

    rows = variants(7)
    df = docs_of(spark, rows + rows[:3] + [(900, ""), (901, None)]).withColumns({"print": F.lit(1), "component_id": F.lit(2)})
    out = J.first_of_each(df)
    want = {c for _, _, c in brute(rows)} | {900, 901}
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_prefix_lengths_lose_no_link():
    for n in range(1, 60):
        for m in range(n, 60):
            for both in range(1, n + 1):
                if 100 * both >= 80 * (n + m - both):
                    for share in (15, None):
                        (pn, kn), (pm, km) = J.prefix_of(n, share, 80), J.prefix_of(m, share, 80)
                        # the worst place of the common hashes: all others come first
                        assert both - (n - pn) >= min(kn, both) or pn == n
                        assert min(both - max(0, n - pn), both - max(0, m - pm)) >= max(1, min(kn, km)) or share is None


@pytest.mark.parametrize("seed", range(4))
def test_trees_against_all_pairs(seed):
    r = np.random.default_rng(seed)
    pool = r.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = []
    for _ in range(12):
        base = r.choice(pool, r.integers(5, 120), replace=False)
        for _ in range(12):
            s = base.copy()
            k = r.integers(0, 1 + len(s) // 6)
            s[:k] = r.integers(0, 1 << 63, k).astype(np.uint64)
            sets.append(np.unique(s))
    root = np.arange(len(sets))
    for a, b in combinations(range(len(sets)), 2):
        o = len(np.intersect1d(sets[a], sets[b]))
        if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
            root[root == root[b]] = root[a] if root[a] < root[b] else root[b]
            root[root == root[a]] = min(root[a], root[b])
    got = T.link(sets, np.arange(len(sets)), 80)
    assert [(got == got[x]).tolist() for x in range(len(sets))] == [(root == root[x]).tolist() for x in range(len(sets))]
    assert len(T.SignatureTree(sets, 80).levels) == 4
