import random

import pytest

from quire.llm import toxicity as X


def table(spark, docs_of, n=700, seed=5):
    r = random.Random(seed)
    syllables = ["ba", "co", "di", "fu", "ge", "ha", "li", "mo", "nu", "pe", "ra", "so"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        t = [word() for _ in range(r.randint(20, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(max(2, len(t) // 15)):
                t[r.randrange(len(t))] = r.choice(["zworgle", "kvexnit", "Zworgles,", "KVEXNIT!"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(spark, docs_of):
    docs, labels, truth = table(spark, docs_of)
    model = X.train(docs, labels)
    got = {r["doc_id"]: r for r in X.score(docs, model).withColumn("held", X.fold_of("doc_id") == 0).collect()}
    held = [i for i, r in got.items() if r["held"]]
    assert len(held) > 80 and sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_held_out_labels_change_nothing(spark, docs_of):
    from pyspark.sql import functions as F

    docs, labels, _ = table(spark, docs_of, 300)
    flipped = labels.withColumn("toxic", F.when(X.fold_of("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.train(docs, labels) == X.train(docs, flipped)


def test_odd_rows_and_no_training(spark, docs_of, odd_rows):
    docs, labels, _ = table(spark, docs_of, 200)
    odd = docs_of(spark, odd_rows)
    got = X.score(odd, X.train(docs.unionByName(odd), labels)).collect()
    assert len(got) == len(odd_rows) and all(r["predicted"] == 0 for r in got)
    assert X.train(docs, labels.filter("toxic = 0")) is None and X.train(docs.filter("false"), labels) is None
    assert {r["predicted"] for r in X.score(odd, None).collect()} == {0}
    assert X.score(docs.filter("false"), None).count() == 0


def test_filter_keeps_columns(spark, docs_of):
    from pyspark.sql import functions as F

    docs, labels, truth = table(spark, docs_of)
    docs = docs.withColumns({"score": F.lit("mine"), "predicted": F.lit(9), "_body": F.lit(None).cast("string")})
    out = X.drop_toxic(docs, labels)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns and out.first()["score"] == "mine"
    assert sum(truth[i] for i in kept) < 0.25 * sum(truth.values()) and sum(not truth[i] for i in kept) > 0.95 * sum(not v for v in truth.values())


def test_word_windows():
    assert X.word_windows(b" ab  cd\n" + b"x" * 100) == [b"ab", b"cd", b"x" * 48, b"x" * 48, b"xxxx"] and X.word_windows(b"") == []


@pytest.mark.parametrize("data", [b"", b"abc", b"a" * 100, b"ab cd " * 30, b" " * 50])
def test_windows_hold_every_byte(data):
    w = X.cut_windows(data)
    assert b"".join(w) == data and all(0 < len(x) <= X.WINDOW for x in w)


def test_both_dictionaries_are_trained(monkeypatch):
    """By zstandard, on windows of ordinary text and on what sets toxic text apart."""
    import zstandard

    r = random.Random(3)
    syllables = ["ba", "co", "di", "fu", "ge", "ha", "li", "mo", "nu", "pe"]
    text = lambda extra: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + extra * (i % 9 == 0) for i in range(200)).encode()
    made = []
    real = zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    plain, marked = X.dictionaries([text(" kvexnit zworgle") for _ in range(60)], [text("") for _ in range(200)])
    trained = [d.as_bytes() for d in made]
    assert marked.removesuffix(X._END) in trained and any(plain.startswith(d) for d in trained)
    assert len(marked) <= X.TOXIC_BYTES[-1] + len(X._END) and b"kvexnit" in marked and b"zworgle" in marked and b"kvexnit" not in plain


def test_no_marks():
    same = [f"the same words {i} all over again".encode() for i in range(40)]
    assert X.dictionaries([], same) is None and X.dictionaries([b""], [b""]) is None


def test_scores_match_one_window_at_a_time(spark, docs_of, odd_rows):
    """Against single compressions and plain sums over every stretch."""
    import math

    import zstandard

    docs, labels, _ = table(spark, docs_of, 300)
    model = X.train(docs, labels)
    rows = [*odd_rows, (20, "Kvexnit ba co " * 200), (21, "x" * 5000)]
    compress = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=X.LEVEL, write_content_size=False, write_dict_id=False) for d in (model.ordinary, model.ordinary + model.toxic)]
    half = len(model.ordinary) // 2
    opening, closing = model.ordinary[half : half + 32] + b" ", b" " + model.ordinary[half // 2 : half // 2 + 16]

    def by_hand(text):
        words = [w[i : i + X.WINDOW] for w in (text or "").encode().lower().split() for i in range(0, len(w), X.WINDOW)]
        gain = [max(0, len(compress[0].compress(opening + w + closing)) - len(compress[1].compress(opening + w + closing)) - X.LEAST_SAVING + 1) for w in words]
        worst = max((sum(gain[i : i + X.STRETCH]) for i in range(max(1, len(gain) - X.STRETCH + 1))), default=0)
        level = max(sum(gain) / (len(gain) + X.DAMPING) / model.threshold, worst / (X.STRETCH + X.DAMPING) / model.stretch)
        return 1 / (1 + math.exp(-4 * (level - 1)))

    rows = [(i, t if t is None else t[:20000]) for i, t in rows]
    got = X.score(docs_of(spark, rows).coalesce(1), model).collect()
    want = [by_hand(t) for _, t in rows]
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    assert all(abs(r["score"] - w) < 1e-9 for r, w in zip(got, want))


def test_training_against_plain_python():
    """Parts are counted and pieces cut as by loops over every text."""
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ba", "co", "di", "é", "fu"]) for _ in range(r.randint(1, 5)))
    toxic = [" ".join(word() + ("kvex" + word() if r.random() < 0.1 else "") for _ in range(60)).encode() for _ in range(40)]
    ordinary = [" ".join(word() for _ in range(60)).encode() for _ in range(90)]

    def times(texts, p):
        return sum(p in {w[i : i + X.PART] for i in range(len(w))} and sum(w[i : i + X.PART] == p for i in range(len(w))) for t in texts for w in {b" " + x + b" " for x in t.split()})

    got = X.unexplained(toxic, ordinary)
    some = sorted({w[i : i + X.PART] for t in toxic for x in t.split() for w in [b" " + x + b" "] for i in range(len(w) - X.PART + 1)})[::7] + sorted(got)
    for p in some:
        n, expected = times(toxic, p), (times(ordinary, p) + 1) * 40 / 90
        assert (p in got) == (n >= X.LEAST_SEEN and n > X.LEAST_RATIO * expected and n - expected > X.LEAST_DEVIATION * expected**0.5)
    assert any(b"kvex" in p for p in got)
    for t in toxic[:10]:
        want = b""
        for x in t.split():
            w = b" " + x + b" "
            held = [any(w[j : j + X.PART] in got for j in range(max(0, i - X.PART + 1), i + 1) if j + X.PART <= len(w)) for i in range(len(w))]
            want += bytes(c for c, h in zip(w, held) if h)
        assert X.left_of(t, got) == want


def test_repeated_ids_count_once(spark, docs_of):
    docs, labels, _ = table(spark, docs_of, 200)
    more = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' zworgle') AS text", "lang", "source", "n_chars"))
    assert X.train(docs, labels) == X.train(more.repartition(5), labels.unionByName(labels))


def test_a_passage_counts_in_a_long_text(spark, docs_of):
    docs, labels, truth = table(spark, docs_of)
    model = X.train(docs, labels)
    plain = [r["text"] for r in docs.orderBy("doc_id").collect() if not truth[r["doc_id"]]]
    long = " ".join(plain[:40])
    bad = " ".join(["zworgle kvexnit", "banana zworgles"] * 12)
    got = X.score(docs_of(spark, [(1, long), (2, f"{long} {bad} {long}"), (3, bad)]), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [0, 1, 1]


def test_worst_stretch_spans_parts():
    ordinary = b"some ordinary words that fill a dictionary of a hundred bytes or more, as any of them would have"
    model = X.Model(ordinary, b" zworgle kvexnit" + X._END, 1.0, 1.0)
    of = model.measure()
    bad = "zworgle kvexnit zworgle " * 100
    at = lambda n: of("x " * n + bad)[1]
    assert at(65536 - 50) == at(10) > 0
