"""Exact dedup (8): counting quotient filters per partition, merged losslessly, then byte verification.

Every partition counts the 64-bit fingerprints of its texts in a quotient filter: a fingerprint's high
bits (the quotient) say where, the low bits (the remainder) what, and remainders stay sorted within their
quotient. Filters of the same quotient range merge by their sorted remainders, so nothing is lost and the
merged counts are those of the whole corpus. Only fingerprints with a count above one go on to byte
verification, which groups the texts themselves; all other rows are unique without any text being moved.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fits, guarded, partitions, table, whole_text, written

QUOTIENT_BITS = 16
_REMAINDER_BYTES = 8 - QUOTIENT_BITS // 8
#: Parts into which the rows of one text are dealt where a shuffle brings them together.
_SALTS = 16


class CountingQuotientFilter:
    """Exact counts of 64-bit fingerprints, as quotients, sorted remainders and counters.

    The slots lie in the order of (quotient, remainder). In bytes it has an occupied bit for each quotient
    of its range, a run-end bit for each slot, the remainders (48 bits each) and a counter for each slot, which stays at
    2^32 - 1 when it gets there: whether it is above one is what counts, groups are counted by their bytes.
    """

    def __init__(self, quotients: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.remainders, self.counts = quotients, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        fingerprints = fingerprints.astype(np.uint64, copy=False)
        slots, inverse = np.unique(fingerprints, return_inverse=True)
        n = np.zeros(len(slots), np.int64)
        np.add.at(n, inverse, 1 if counts is None else counts)
        low = np.uint64(64 - QUOTIENT_BITS)
        return cls((slots >> low).astype(np.uint32), slots & np.uint64((1 << int(low)) - 1), n)

    def fingerprints(self) -> np.ndarray:
        return (self.quotients.astype(np.uint64) << np.uint64(64 - QUOTIENT_BITS)) | self.remainders

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All are sorted by quotient and remainder, so one stable sort merges their runs; equal remainders of a quotient add their counters."""
        slots, counts = np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters])
        order = np.argsort(slots, kind="stable")
        slots, counts = slots[order], counts[order]
        first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.zeros(0, np.int64)
        low = np.uint64(64 - QUOTIENT_BITS)
        slots, counts = slots[first], np.add.reduceat(counts, first) if len(first) else counts
        return cls((slots >> low).astype(np.uint32), slots & np.uint64((1 << int(low)) - 1), counts)

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        return CountingQuotientFilter.merged([self, other])

    def split(self, ranges: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """By equal ranges of quotients; empty ranges are left out."""
        which = (self.quotients.astype(np.int64) * ranges) >> QUOTIENT_BITS
        cuts = np.flatnonzero(np.diff(which)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(which)]):
            if b > a:
                yield int(which[a]), CountingQuotientFilter(self.quotients[a:b], self.remainders[a:b], self.counts[a:b])

    def to_bytes(self) -> bytes:
        first, last = int(self.quotients[0]), int(self.quotients[-1])
        occupied = np.zeros(last - first + 1, bool)
        occupied[self.quotients - first] = True
        ends = np.append(np.diff(self.quotients) != 0, True)
        small = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_REMAINDER_BYTES]
        head = struct.pack("<III", first, len(occupied), len(ends))
        return head + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + small.tobytes() + np.minimum(self.counts, 0xFFFFFFFF).astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        first, span, n = struct.unpack_from("<III", data)
        at = struct.calcsize("<III")
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, (span + 7) // 8, at), count=span)
        at += (span + 7) // 8
        ends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n)
        at += (n + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :_REMAINDER_BYTES] = np.frombuffer(data, np.uint8, n * _REMAINDER_BYTES, at).reshape(n, -1)
        counts = np.frombuffer(data, "<u4", n, at + n * _REMAINDER_BYTES).astype(np.int64)
        run = np.cumsum(ends, dtype=np.int64) - ends
        quotients = (np.flatnonzero(occupied)[run] + first).astype(np.uint32)
        return cls(quotients, wide.reshape(-1).view("<u8").astype(np.uint64), counts)


def repeated_fingerprints(df: DataFrame, column: str) -> DataFrame:
    """The fingerprints (long) with a count above one, and that count: columns fp, n."""
    ranges = max(1, min(1 << QUOTIENT_BITS, partitions(df.sparkSession)))

    def build(batches):
        import pandas as pd

        # a partition's fingerprints are 8 bytes a row
        got = [b[column].to_numpy(np.int64).view(np.uint64) for b in batches]
        if got and sum(map(len, got)):
            parts = list(CountingQuotientFilter.of(np.concatenate(got)).split(ranges))
            yield pd.DataFrame({"range": [r for r, _ in parts], "filter": [f.to_bytes() for _, f in parts]})

    def merge(batches):
        import pandas as pd

        merged: dict[int, CountingQuotientFilter] = {}
        pending: dict[int, list[CountingQuotientFilter]] = {}

        def take(r):
            found = [*([merged[r]] if r in merged else []), *pending.pop(r)]
            merged[r] = CountingQuotientFilter.merged(found)

        for b in batches:
            for r, data in zip(b["range"], b["filter"]):
                pending.setdefault(r, []).append(CountingQuotientFilter.from_bytes(data))
                # Merged anew whenever what waits has grown as large: a few passes over a range, however many filters it comes in.
                if sum(len(f.counts) for f in pending[r]) > max(1 << 20, len(merged[r].counts) if r in merged else 0):
                    take(r)
        for r in list(pending):
            take(r)
        for f in merged.values():
            many = f.counts > 1
            yield pd.DataFrame({"fp": f.fingerprints()[many].view(np.int64), "n": f.counts[many]})

    built = df.select(column).mapInPandas(build, "range int, filter binary")
    return built.repartition(ranges, "range").mapInPandas(merge, "fp long, n long")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text that several rows share: sha (its SHA-256), keep_id, group_size.

    Texts are equal when their bytes are; keep_id is the largest id of the group (null ids are smaller
    than all others). ``docs`` may hold repeated rows, null texts (empty) and any other columns.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))
    keyed = keyed.withColumn("fp", F.xxhash64("body"))
    repeated = written(repeated_fingerprints(keyed, "fp"))
    if fits(repeated.count(), 32):
        suspects = keyed.join(F.broadcast(repeated.select("fp")), "fp", "left_semi")
    else:  # too many for every executor: deal both sides out by fingerprint and salt, so that no copy group is one task's
        spread = repeated.select("fp", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
        suspects = keyed.withColumn("salt", F.pmod(F.hash("id", F.monotonically_increasing_id()), F.lit(_SALTS))).join(spread, ["fp", "salt"], "left_semi")
    # Equal fingerprints meet here by their bytes. Copies are counted before the exchange.
    groups = suspects.groupBy("fp", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.filter("group_size > 1").select(F.sha2("body", 256).alias("sha"), "keep_id", "group_size")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256 added (names taken before are replaced).

    Of equal texts one row stays: that with the largest id. Rows that repeat that id as well are told apart
    arbitrarily: they hold the same id and text, and exactly one of them has kept = true. An empty table gives an empty one.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    base, at = guarded(docs.drop(*added))
    names, id_col, text_col = list(at), at[id_col], at[text_col]
    groups = written(copies(base, id_col, text_col))
    rows = base.withColumn("text_sha256", F.sha2(whole_text(text_col), 256))
    n = groups.count()
    if fits(n, 160):
        joined = rows.join(F.broadcast(groups), rows["text_sha256"] == groups["sha"], "left").drop("sha")
    else:  # dealt by text and salt, so that no text's copies are one task's
        spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(_SALTS)).cast("int"))
        joined = salted.join(spread, (salted["text_sha256"] == spread["sha"]) & (salted["_salt"] == spread["_salt"]), "left").drop("sha", "_salt")
    single = F.col("group_size").isNull()
    joined = joined.withColumn("_best", F.when(single, F.lit(True)).otherwise(F.col(id_col).eqNullSafe(F.col("keep_id"))))
    # The best row of a group may be there more than once: such rows are counted, and one of them stays.
    best = joined.filter(F.col("_best") & ~single).groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    ties = written(best.select("text_sha256"))
    joined = joined.withColumn("keep_id", F.when(single, F.col(id_col)).otherwise(F.col("keep_id")))
    joined = joined.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    kept = joined.withColumn("kept", F.col("_best"))
    if not ties.isEmpty():
        t = F.broadcast(ties) if fits(ties.count(), 96) else ties
        # Written down with numbers, the least of which stays: a minimum for each text instead of a sort of all its rows.
        tied = written(joined.join(t, "text_sha256", "left_semi").filter("_best").withColumn("_row", F.monotonically_increasing_id()))
        first = written(tied.groupBy("text_sha256").agg(F.min("_row").alias("_first")).select("_first"))
        f = F.broadcast(first) if fits(first.count(), 24) else first
        tied = tied.join(f, tied["_row"] == first["_first"], "left").withColumn("kept", F.col("_first").isNotNull()).drop("_row", "_first")
        marked = ties.withColumn("_tie", F.lit(True))
        rest = kept.join(F.broadcast(marked) if fits(ties.count(), 96) else marked, "text_sha256", "left").filter("_tie is null or not _best").drop("_tie")
        kept = rest.unionByName(tied)
    return kept.select(*base.columns, *added).toDF(*names, *added)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    base, at = guarded(docs)
    return mark_copies(base, at[id_col], at[text_col]).filter("kept").select(*base.columns).toDF(*docs.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
