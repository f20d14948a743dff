"""Substring dedup (11): Rabin-Karp hashes of every window of 50 words, counted over the corpus; repeated windows become removal intervals.

A window goes if its words also start in a document with a smaller id. All windows of all texts take part:

1. *Deal.* A task hashes the windows of its texts (96 bits). Of windows that repeat among them, all but those of the least id are settled
   there; the others go out once for each text, to the block of their hash range, so a passage that everyone copies is one entry a slice of texts.
2. *Count.* A block sorts its entries. Of equal hashes, those above the least id go back to their document.
3. *Merge.* A document's repeated windows become runs.
4. *Cut.* Each document is hashed once more: all windows equal to its repeated ones go, and their words merge into maximal intervals.

Blocks are as many as the text asks for, so that each holds about BLOCK_WINDOWS entries at any size. 96 bits are taken as the words themselves: among
10^13 windows (100 TB) the chance that any two differing ones agree is about 0.001.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.byte_words import Scanner, buffers, from_planes, in_slices, inverse, mixed, planes, powers
from quire.llm.common import fits, guarded, in_parts, partitions, table, text_batches, trim, whole_text, worker_cache, written

WORDS = 50
#: Bytes of text that a task hashes at a time; entries of a block, about; bytes of a word, at least about.
SLICE_BYTES, BLOCK_WINDOWS, WORD_BYTES = 4 << 20, 4 << 20, 5
_ROLL = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_SPACES = b" \t\n\x0b\x0c\r"


def _scanner() -> Scanner:
    return worker_cache("substring words", lambda: Scanner(bytes(set(range(256)) - set(_SPACES))))


def _rolled(h: np.ndarray, words: int, base: int) -> np.ndarray:
    """The hash of each window of so many numbers: sum of h[i] * base^i, less the place of the first."""
    n = len(h) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)), dtype=np.uint64)])
    return mixed((sums[words:] - sums[:-words]) * powers(inverse(base), n))


class Windows:
    """All windows of a slice of texts: the text each lies in, its first word there, and its hash of 64 and 32 bits."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: int):
        found = _scanner().words(data, offsets)
        high = _rolled(found.h1, words, _ROLL[0])
        low = (_rolled(found.h2, words, _ROLL[1]) >> np.uint64(32)).astype(np.uint32)
        whole = np.flatnonzero(found.text[: len(high)] == found.text[words - 1 :]) if len(high) else np.zeros(0, np.int64)
        first_word = np.searchsorted(found.text, np.arange(len(offsets) - 1))
        self.n_words = np.bincount(found.text, minlength=len(offsets) - 1)
        self.text = found.text[whole]
        self.place = (whole - first_word[self.text]).astype(np.uint32)
        self.high, self.low = high[whole], low[whole]


def _sorted(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together and keeps the order among them, and where each hash begins in it."""
    order = np.argsort(high, kind="stable")
    h, w = high[order], low[order]
    same = h[1:] == h[:-1]
    if (same & (w[1:] != w[:-1])).any():
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        same = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
    return order, np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)


def _least(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each entry, the least id of its group."""
    return np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(ids)))) if len(ids) else ids


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((mixed(ids.view(np.uint64)) >> np.uint64(32)).astype(np.int64) * parts) >> 32


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Where the runs of equal numbers begin and end."""
    at = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(x)])) if len(x) else []


def _packed(ids, keys, place) -> tuple[bytes, bytes, bytes, bytes]:
    """Entries in the order of their documents: each document once, with its number of entries."""
    fresh = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))) if len(ids) else np.zeros(0, np.int64)
    steps = np.diff(place, prepend=np.uint32(0))  # small numbers: ids and places as steps from the one before
    steps[fresh] = place[fresh]
    return planes(np.diff(ids[fresh], prepend=0)), keys[fresh].tobytes(), planes(np.diff(np.append(fresh, len(ids))).astype(np.uint32)), planes(steps)


def _unpacked(ids: bytes, keys: bytes, per: bytes, place: bytes):
    n = from_planes(per, np.uint32)
    far = np.cumsum(from_planes(place, np.uint32), dtype=np.int64)
    before = np.append(0, far)[np.append(0, np.cumsum(n, dtype=np.int64)[:-1])]
    return np.repeat(np.cumsum(from_planes(ids, np.int64)), n), np.repeat(np.frombuffer(keys, np.int64), n), (far - np.repeat(before, n)).astype(np.uint32)


_DEALT = "block int, settled boolean, high binary, low binary, ids binary, keys binary, per binary, place binary"
_REPLY = "part int, ids binary, keys binary, per binary, place binary"


def _keyed(rows: DataFrame, spread: DataFrame | None) -> DataFrame:
    """With _key, which tells rows of the same _id apart by their _body: 0 for ids that don't repeat, as which ``spread`` has those that do."""
    null = F.when(F.col("_id").isNull(), F.xxhash64(F.monotonically_increasing_id()))  # spread over all tasks
    if spread is None:
        return rows.withColumn("_key", null.otherwise(F.lit(0)))
    return rows.join(spread, "_id", "left").withColumn("_key", null.when(F.col("_again"), F.xxhash64("_body")).otherwise(F.lit(0))).drop("_again")


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """The ids that several rows have, marked as _again; None if there are none."""
    ids = written(docs.select(F.col(id_col).cast("long").alias("_id")).groupBy("_id").count().filter("count > 1 AND _id IS NOT NULL").select("_id", F.lit(True).alias("_again")))
    n = ids.count()
    return None if not n else F.broadcast(ids) if fits(n, 16) else ids


def repeats(docs: DataFrame, id_col: str, text_col: str, spread: DataFrame | None, words: int = WORDS, slice_bytes: int = SLICE_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Of each document with repeated windows, one row: _id, _key (see ``_keyed``), _runs (first places of one such window of each kind, and lengths of runs of them)."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_body"))
    size = rows.agg(F.sum(F.octet_length("_body"))).first()[0] or 0
    blocks = max(partitions(spark), -(-size // (WORD_BYTES * block_windows)))
    rows = _keyed(rows, spread).select("_id", "_key", "_body")

    def deal(batches):
        import pyarrow as pa

        for b in in_slices(batches, "_body", slice_bytes):
            w = Windows(*buffers(b.column(2)), words)
            ids, keys = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            order, starts = _sorted(w.high, w.low)
            text = w.text[order]
            own = ids[text]
            first = np.ones(len(order), bool)
            first[1:] = text[1:] != text[:-1]  # one entry a text and hash
            first[starts] = True
            settled = own > _least(own, starts)
            out = []
            for done in (False, True):
                at = np.sort(order[first & (settled == done)])  # by text and place again
                block = _part(ids[w.text[at]], blocks) if done else ((w.high[at] >> np.uint64(32)).astype(np.int64) * blocks) >> 32
                by = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
                at, block = at[by], block[by]
                for i, j in _cuts(block):
                    k = at[i:j]
                    hashes = (b"", b"") if done else (w.high[k].tobytes(), w.low[k].tobytes())
                    out.append((int(block[i]), done, *hashes, *_packed(ids[w.text[k]], keys[w.text[k]], w.place[k])))
            if out:
                kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in _DEALT.split(", ")])
            del w, b
        trim()

    def replies(ids, keys, place):
        import pyarrow as pa

        part = _part(ids, blocks)
        by = np.lexsort((place, keys, ids, part))
        ids, keys, place, part = ids[by], keys[by], place[by], part[by]
        out = [(int(part[i]), *_packed(ids[i:j], keys[i:j], place[i:j])) for i, j in _cuts(part)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32(), *[pa.binary()] * 4])], names=[f.split()[0] for f in _REPLY.split(", ")])

    def count(batches):
        held = []
        for b in batches:
            done = []
            for _, settled, high, low, *rest in zip(*(b.column(k).to_pylist() for k in range(8))):
                if settled:
                    done.append(_unpacked(*rest))
                else:
                    held.append((np.frombuffer(high, np.uint64), np.frombuffer(low, np.uint32), *_unpacked(*rest)))
            if done:
                yield replies(*map(np.concatenate, zip(*done)))
        if held:
            high, low, ids, keys, place = map(np.concatenate, zip(*held))
            del held
            order, starts = _sorted(high, low)
            again = np.empty(len(ids), bool)
            again[order] = ids[order] > _least(ids[order], starts)
            if again.any():
                yield replies(ids[again], keys[again], place[again])
        trim()

    def merge(batches):
        import pyarrow as pa

        held = [_unpacked(*r) for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(1, 5)))]
        if held:
            ids, keys, place = map(np.concatenate, zip(*held))
            by = np.lexsort((place, keys, ids))
            ids, keys, place = ids[by], keys[by], place[by]
            doc = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))
            run = np.flatnonzero(np.append(True, np.diff(place.astype(np.int64)) != 1) | doc)
            long = np.diff(np.append(run, len(ids)))
            first = np.flatnonzero(doc[run])
            packed = np.stack([place[run].astype(np.int64), long], axis=1)
            for a in range(0, len(first), 1000):
                which = first[a : a + 1000]
                ends = np.append(first, len(run))[a + 1 : a + 1 + len(which)]
                data = [packed[i:j].tobytes() for i, j in zip(which, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[run[which]]), pa.array(keys[run[which]]), pa.array(data, pa.binary())], names=["_id", "_key", "_runs"])
        trim()

    counted = rows.mapInArrow(deal, _DEALT).repartitionById(blocks, "block").mapInArrow(count, _REPLY)
    return counted.repartitionById(blocks, "part").mapInArrow(merge, "_id long, _key long, _runs binary")


def _spans(data: np.ndarray, runs: bytes, words: int) -> np.ndarray:
    """The maximal intervals [first word, end) that windows equal to those of the runs cover."""
    w = Windows(data, np.array([0, len(data)]), words)
    first, long = np.frombuffer(runs, np.int64).reshape(-1, 2).T
    at = np.repeat(first - np.append(0, np.cumsum(long)[:-1]), long) + np.arange(long.sum())
    gone = np.flatnonzero(np.isin(w.high, w.high[at]))
    if not len(gone):
        return np.zeros((0, 2), np.int64)
    fresh = np.append(True, np.diff(gone) > words)
    return np.stack([gone[fresh], gone[np.append(fresh[1:], True)] + words], axis=1)


def _packed_texts(rows: DataFrame, text: str) -> DataFrame:
    """The texts compressed, so that a shuffle moves less than half of their bytes; null ones stay null."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            k = b.schema.get_field_index(text)
            data = pa.array([None if t is None else pack(t) for t in b.column(k).cast(pa.binary()).to_pylist()], pa.binary())
            yield b.set_column(k, text, data)
        trim()

    kept = [T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in rows.schema.fields]
    return rows.mapInArrow(run, T.StructType(kept))


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, keep: list[str] | None = None, **sizes: int) -> DataFrame:
    """Every row (its columns ``keep``, if given) with n_words, n_removed, removed (array of [first word, end) intervals, maximal ones) and kept_text (the other words, joined by one space).

    A null text has no words, as has an empty one; a text of fewer than ``words`` words loses none. A null id is neither smaller nor larger than
    any other: such rows lose nothing and take nothing away. Rows that repeat an id don't take from each other, whatever their texts. An empty table
    gives an empty one; added columns take the place of ones so named. A text is hashed whole, which takes some 15 times its length in memory.
    """
    added = ["n_words", "n_removed", "removed", "kept_text"]
    base, at = guarded(docs.drop(*added))
    out = [c for c in at if keep is None or c in keep]
    text = at[text_col]
    spread = repeated_ids(base, at[id_col])
    found = repeats(base, at[id_col], text, spread, words, **sizes)
    rows = _keyed(base.withColumns({"_id": F.col(at[id_col]).cast("long"), "_body": whole_text(text)}), spread)
    rows = rows.select(*dict.fromkeys([*(at[c] for c in out if c != text_col), "_id", "_key"]), F.col(text).cast("string").alias(text))
    joined = _packed_texts(rows, text).join(found, ["_id", "_key"], "left").select(*(at[c] for c in out if c != text_col), text, "_runs")
    fields = [joined.schema[at[c]] if c != text_col else T.StructField(text, T.StringType()) for c in out]

    def cut(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for b in in_parts(batches):
            n_words, n_removed, removed, kept, texts = [], [], [], [], []
            for packed, runs in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                data = unpack(packed) if packed is not None else b""
                found = data.split()
                n_words.append(len(found))
                gone = _spans(np.frombuffer(data, np.uint8), runs, words).tolist() if runs else []
                for i, j in reversed(gone):
                    del found[i:j]
                n_removed.append(n_words[-1] - len(found))
                removed.append([{"first": i, "end": j} for i, j in gone])
                kept.append(b" ".join(found))
                texts.append(None if packed is None else data)
            whole = pa.array(texts, pa.binary()).cast(pa.string()) if text_col in out else None
            cols = [whole if f.name == text else b.column(b.schema.get_field_index(f.name)) for f in fields]
            added_cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *added_cols], names=[*(f.name for f in fields), *added])

    extra = T._parse_datatype_string("n_words long, n_removed long, removed array<struct<first: long, end: long>>, kept_text string")
    return joined.mapInArrow(cut, T.StructType([*fields, *extra.fields])).toDF(*out, *added)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows and columns of ``docs``, repeated passages cut out of their texts (whose other words are joined by one space); odd rows as in ``mark_repeats``, a null text stays null."""
    base, at = guarded(docs)
    marked = mark_repeats(base, at[id_col], at[text_col], words)
    text = F.when(F.col(at[text_col]).isNotNull(), F.col("kept_text"))
    return marked.select(*[text.alias(c) if c == at[text_col] else F.col(c) for c in base.columns]).toDF(*docs.columns)


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_repeats(docs, keep=["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS span FROM starts),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY span) < doc_id AS gone FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM judged WHERE gone),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
marked AS (SELECT e.doc_id, e.i, e.word, c.i IS NOT NULL AS gone FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.i = c.i),
counted AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN counted c ON w.doc_id = c.doc_id
"""
