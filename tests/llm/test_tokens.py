import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quire.llm import packing as P  # noqa: E402
from quire.llm import token_files as T  # noqa: E402
from quire.llm.tokens import PieceEncoder, public_path  # noqa: E402

SIGNS = ["a", "B", "word", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "_", ",", ".", "é", "é", "̱", "H", "ß", "İ", "Σ", "»", "\x85", "\x1c", "　", "漢", "가", "ᄀ", "ᅡ", "²", "½", "<|endoftext|>", "😀", "-", "\r", " \n"]


@pytest.mark.parametrize("name, kind", [(T.VOCABULARY, "byte"), (P.VOCABULARY, "word")])
def test_pieces_give_the_ids_of_the_whole_text(name, kind):
    r = random.Random(3)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    encoder, whole = PieceEncoder(public_path(name), kind, 500), Tokenizer.from_file(public_path(name))
    for text, got in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("around", ["a{0}b", "{0}!", "x {0} y", "9{0}'s", "{0}{0}"])
def test_every_code_point(around):
    import unicodedata

    texts = [around.format(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    encoder, whole = PieceEncoder(public_path(P.VOCABULARY), "word"), Tokenizer.from_file(public_path(P.VOCABULARY))
    want = whole.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, got, w in zip(texts, encoder.encode_all(texts), want) if np.frombuffer(got, "<u4").tolist() != w.ids] == []


@pytest.mark.parametrize("name, kind", [(T.VOCABULARY, "byte"), (P.VOCABULARY, "word")])
def test_letters_that_are_taken_apart(name, kind):
    r = random.Random(4)
    signs = [*"\u0958\u095f\u09dc\u0a33\u0b5c\ufb2a\u0344\u2126\u212b\u0301\u0328", "a", "e", " ", "!", "'", "word", "9"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 10))) for _ in range(4000)]
    encoder, whole = PieceEncoder(public_path(name), kind, 500), Tokenizer.from_file(public_path(name))
    for text, got in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def ids_of(name, text):
    return np.array(Tokenizer.from_file(public_path(name)).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_files_give_back_every_document(spark, docs_of, odd_rows, tmp_path):
    rows = odd_rows + [(1000 - k, f"document {k} " * k) for k in range(40)]
    files = T.write_tokens(docs_of(spark, rows), f"file://{tmp_path}", sequence=64)
    got = sorted(map(tuple, T.read_tokens(files).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(T.VOCABULARY, t)
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert T.read_tokens(T.write_tokens(docs_of(spark, []), f"file://{tmp_path}/none")).count() == 0


def test_sequences_are_views_of_equal_length(tmp_path):
    data = np.arange(1000, dtype="<u4")
    assert T.write_file(f"{tmp_path}/x.arrow", [(7, data.tobytes()), (None, data[:3].tobytes())], sequence=128) == (2, 1003, 8)
    f = T.TokenFile(f"{tmp_path}/x.arrow")
    ids, mask = f.sequence(3)
    assert ids.tolist() == list(range(384, 512)) and all(mask.to_pylist()) and not ids.flags.owndata
    ids, mask = f.sequence(7)
    assert sum(mask.to_pylist()) == 1003 - 7 * 128 and ids[103:107].tolist() == [999, 0, 1, 2]
    assert [x[:2] for x in f.documents()] == [(7, 1000), (None, 3)]
    with pytest.raises(IndexError):
        f.sequence(8)


def test_any_sequence_of_many_batches(tmp_path):
    r = np.random.default_rng(1)
    docs = [(i, r.integers(0, 60_000, n).astype("<u4")) for i, n in enumerate([5, 40_000, 3, 9_000, 1, 12_345])]
    T.write_file(f"{tmp_path}/x.arrow", [(i, d.tobytes()) for i, d in docs], sequence=16)
    f, every = T.TokenFile(f"{tmp_path}/x.arrow"), np.concatenate([d for _, d in docs])
    sizes = [len(b) for b in f.batches()]
    assert len(sizes) > 10 and set(sizes[:-1]) == {T._ROWS}
    for i in [0, 1, 255, 256, 257, 2000, -(-len(every) // 16) - 1]:
        ids, mask = f.sequence(i)
        want = every[i * 16 : (i + 1) * 16]
        assert ids[: len(want)].tolist() == want.tolist() and mask.to_pylist() == [k < len(want) for k in range(16)]
    assert [x[:2] for x in f.documents()] == [(i, len(d)) for i, d in docs]


def test_full_files_are_followed_by_others(spark, docs_of, tmp_path, monkeypatch):
    plain = T.write_tokens(docs_of(spark, [(i, f"text {i} " * 5) for i in range(50)]).withColumnRenamed("lang", "slot"), f"file://{tmp_path}/a", sequence=16)
    n = plain.agg({"n_ids": "sum"}).first()[0]
    one = sorted(map(tuple, T.read_tokens(plain).collect()))
    monkeypatch.setattr(T, "FILE_IDS", 40)
    many = T.write_tokens(docs_of(spark, [(i, f"text {i} " * 5) for i in range(50)]), f"file://{tmp_path}/b", sequence=16)
    if many.count() > plain.count():  # workers see the changed limit where they were started anew
        assert many.agg({"n_ids": "sum"}).first()[0] == n
    assert sorted(map(tuple, T.read_tokens(many).collect())) == one


def test_wide_ids(tmp_path):
    data = np.array([70_000, 1], "<u4")
    T.write_file(f"{tmp_path}/x.arrow", [(1, data.tobytes())], wide=True, sequence=8)
    assert list(T.TokenFile(f"{tmp_path}/x.arrow").documents()) == [(1, 2, zlib.crc32(data.tobytes()))]


@pytest.mark.parametrize("seed", range(5))
def test_differencing_balances(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 1025, 600)
    k = -(-int(lengths.sum()) // 4096) + 1
    sums = np.bincount(P.differencing(lengths, k), lengths, minlength=k)
    assert sums.max() - sums.min() <= 64  # near-equal
    w = P.windows(lengths)
    sums = np.bincount(w, lengths)
    assert sums.max() <= 4096 and len(sums) <= -(-int(lengths.sum()) // 4096) + 2


def test_windows_rise_with_excess():
    assert len(set(P.windows([3000, 3000, 2000]).tolist())) == 3
    assert P.windows([]).tolist() == []
    assert P.windows([4096]).tolist() == [0]


def test_many_tiny_pieces(spark, docs_of, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_PIECES", 100)
    got = P.pack(docs_of(spark, [(i, None) for i in range(1000)])).collect()
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sum(fill.values()) == 1000 and len(fill) >= 9 and max(fill.values()) < 200


def test_cut():
    assert P.cut(4096) == [4096] and P.cut(1) == [1] and P.cut(9000) == [4096, 4096, 808] and P.cut(3000) == [1024, 1024, 952] and sum(P.cut(12_345)) == 12_345


def test_packing_keeps_every_id(spark, docs_of, odd_rows):
    rows = odd_rows + [(1000 + k, f"text number {k} " * (k * 3)) for k in range(60)]
    got = P.pack(docs_of(spark, rows), block_windows=3).collect()
    by_window = {}
    for r in got:
        by_window.setdefault(r["sequence_id"], []).append(r)
    for rs in by_window.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0, *[r["length"] for r in rs[:-1]]]).tolist()
        total = sum(r["length"] for r in rs)
        assert total <= 4096 and {r["padded_length"] for r in rs} == {total if total & (total - 1) == 0 else 4096}
    want = []
    for i, t in rows:
        ids, at = ids_of(P.VOCABULARY, t), 0
        for n in P.cut(len(ids)):
            want.append((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert P.pack(docs_of(spark, [])).count() == 0


def test_token_files_of_clashing_columns(spark, docs_of, tmp_path):
    from pyspark.sql import functions as F

    docs = docs_of(spark, [(3, "b c"), (1, "a"), (2, None)])
    want = sorted(map(tuple, T.read_tokens(T.write_tokens(docs, f"file://{tmp_path}/a")).collect()))
    for c in ("path", "ids", "start", "n_ids", "n_tokens", "slot", "id", "body", "_id", "_body", "part"):
        docs = docs.withColumn(c, F.lit("x"))
    assert sorted(map(tuple, T.read_tokens(T.write_tokens(docs, f"file://{tmp_path}/b")).collect())) == want and len(want) == 3
