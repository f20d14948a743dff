import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quire.llm import exact_dedup, shingle_join  # noqa: E402
from quire.llm.common import table, written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_stage_on_its_own_input(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "shingle_join", "mixing", "packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = written(stage(spark, docs, SF))
        after = docs.collect()
        if name == "packing":
            assert sum(r["doc_tokens"] for r in after if r["start"] == 0) == sum(r["length"] for r in after)
            continue
        assert docs.columns == columns and set(map(tuple, after)) <= set(before) and after
        if name == "exact_dedup":
            texts = [r["text"] for r in after]
            assert len(texts) == len(set(texts)) == len({r[1] for r in before})
        if name == "shingle_join":
            from tests.llm.test_shingle_join import brute

            keep = {c for _, n, c in brute([r[:2] for r in before])}
            assert {r["doc_id"] for r in after} == keep


@pytest.fixture(scope="module")
def odd(spark, docs_of, odd_rows):
    """Odd rows among some of the table, with columns named like those of the stages."""
    from pyspark.sql import functions as F

    some = table(spark, SF, "documents").limit(40).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars")
    rows = docs_of(spark, [r for r in odd_rows], lambda i: None if i == 1 else "s").unionByName(some)
    names = ["score", "predicted", "_body", "kept", "keep_id", "sha", "print", "component_id", "_rate", "_copies", "_order", "row", "block", "c0"]
    return written(rows.withColumns({n: F.lit(f"mine {n}") for n in names}))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_rows_and_empty_tables(spark, odd, name, stage):
    none = stage(spark, odd.filter("false"), SF)
    assert none.count() == 0
    before, after = odd.collect(), stage(spark, odd, SF).collect()
    if name == "packing":
        firsts = [r for r in after if r["start"] == 0]
        assert len(firsts) == len(before) and sum(r["doc_tokens"] for r in firsts) == sum(r["length"] for r in after)
        assert sorted(r["doc_id"] or -1 for r in firsts) == sorted(r["doc_id"] or -1 for r in before)
        return
    assert none.columns == odd.columns == list(after[0].asDict()) and set(map(tuple, after)) <= set(map(tuple, before))
    texts = [r["text"] or "" for r in after]
    if name == "toxicity":
        assert [r["text"] for r in after if (r["doc_id"] or 0) < 1000 and (r["text"] or "").strip() == ""].count("") == 1
    if name == "exact_dedup":
        assert sorted(texts) == sorted({r["text"] or "" for r in before})
    if name == "shingle_join":
        assert sum(t == "a b c d e f" for t in texts) == 2 and sum(t.strip() == "" for t in texts) == sum((r["text"] or "").strip() == "" for r in before)
    if name == "mixing":
        seen = {}
        for r in after:
            seen.setdefault((r["doc_id"], r["text"]), []).append(r)
        assert {(r["doc_id"], r["text"]): 0 for r in before}.keys() >= seen.keys()


def test_each_text_once_before_mixing(spark, odd):
    """Plain Python's verdict on what the stages up to mixing leave of the odd rows."""
    from tests.llm.test_shingle_join import brute

    docs = written(corpus_pipeline.STAGES[1][1](spark, odd, SF))
    keep = {c for _, n, c in brute([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]) if n}
    kept = written(corpus_pipeline.STAGES[2][1](spark, docs, SF)).collect()
    assert {r["doc_id"] for r in kept if (r["text"] or "").strip() and r["doc_id"] is not None} == keep


def test_mixing_by_hand(spark, odd):
    """Counts of the mixing stage against a plain inversion of the Poisson distribution."""
    import hashlib
    from collections import Counter

    from quire.llm import mixing
    from tests.llm.test_mixing import inverse

    rows, size = odd.collect(), Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "")
    w = {s: n**mixing.TEMPERATURE for s, n in size.items()}
    want = Counter()
    for r in rows:
        rate = w[r["source"]] / sum(w.values()) * sum(size.values()) / size[r["source"]] if size[r["source"]] else 0
        u = int(hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}|mix".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert rate <= mixing.MAX_RATE
        want[(r["doc_id"], r["text"])] += inverse(u, rate) if rate else 0
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mix(spark, odd, SF).collect())
    assert got == +want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert exact_dedup and shingle_join
