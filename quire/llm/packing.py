"""Packing (6): windows of nearly equal fill by Karmarkar-Karp multiway differencing.

Documents become pieces: whole windows are cut off first, what remains is cut into pieces of at most a
quarter window. Pieces are dealt into blocks by hash. In a block, every piece starts as a partition
of k windows of which one is filled; the two partitions with the largest imbalance merge, the fullest
window of one meeting the emptiest of the other, until one partition is left. k starts at the least
number of windows that could hold the block and rises by one whenever a window exceeds its capacity.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_parts, table, text_batches, whole_text, written
from quire.llm.tokens import encoder, public_path

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Windows and pieces a block holds about; a block is one task's, and takes memory for its pieces times its windows.
BLOCK_WINDOWS, BLOCK_PIECES = 96, 16_384


def differencing(lengths, k: int):
    """The window (0 to k - 1) of each length, by multiway differencing into k windows."""
    import numpy as np

    n = len(lengths)
    if k == 1 or n <= 1:
        return np.zeros(n, np.int64)
    left, right = [-1] * n, [-1] * n  # of merged contents; below n they are pieces
    heap = []
    for i, x in enumerate(lengths):
        sums, what = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], what[0] = x, i
        heap.append((-int(x), i, sums, what))  # sums fall from the first window on
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, wa = heapq.heappop(heap)
        _, _, b, wb = heap[0]
        b, wb = b[::-1], wb[::-1]
        sums = a + b
        what = np.where(wa < 0, wb, wa)
        for j in np.flatnonzero((wa >= 0) & (wb >= 0)):
            what[j] = len(left)
            left.append(int(wa[j]))
            right.append(int(wb[j]))
        order = np.argsort(-sums, kind="stable")
        sums, what = sums[order], what[order]
        low = sums[-1]
        heapq.heapreplace(heap, (-int(sums[0] - low), turn, sums, what))
        turn += 1
    window = np.zeros(n, np.int64)
    for w, root in enumerate(heap[0][3].tolist()):
        stack = [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack += (left[x], right[x])
    return window


def windows(lengths, capacity: int = CAPACITY):
    """The window of each length such that none holds more than ``capacity``; every length is at most that."""
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window = differencing(lengths, k)
        if len(lengths) == 0 or np.bincount(window, lengths).max() <= capacity:
            return window
        k += 1


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids: whole windows, then parts of a quarter, then the rest."""
    whole, rest = divmod(n, capacity)
    part = max(1, capacity // 4)
    return [capacity] * whole + [part] * (rest // part) + [rest % part] * (rest % part > 0)


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row: row (which row of ``docs``), doc_id, start, length, ids_crc32, doc_tokens."""
    text_batches(docs.sparkSession)
    vocabulary = vocabulary or public_path(VOCABULARY)

    def tokenise(batches):
        import struct
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = encoder(vocabulary, "word"), struct.pack("<I", end_id)
        row = TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in in_parts(batches):
            out = []
            for i, found in zip(b.column("id").to_pylist(), enc.encode_all(b.column("body").to_pylist())):
                ids = memoryview(found + end)
                n, start = len(ids) // 4, 0
                for length in cut(n, capacity):
                    out.append((row, i, start, length, zlib.crc32(ids[start * 4 : (start + length) * 4]), n))
                    start += length
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 6)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body"))
    return rows.mapInArrow(tokenise, "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    Every row of ``docs`` is packed, also one that repeats another; a null or empty text is its end id alone. ``padded_length`` is the
    capacity, or the sequence's own length where that is a power of two.
    """
    found = written(pieces(docs, vocabulary, end_id, capacity, id_col, text_col))
    small = found.filter(F.col("length") < capacity)
    total, n = small.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, round(total / (capacity * block_windows)), -(-n // BLOCK_PIECES))

    columns = [*found.columns, "sequence_id", "offset", "padded_length"]

    def fill(pdf):
        import numpy as np

        pdf = pdf.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable")
        length = pdf["length"].to_numpy()
        window = windows(length, capacity)
        pdf = pdf.iloc[np.argsort(window, kind="stable")]
        window, length = np.sort(window), pdf["length"].to_numpy()
        before = np.cumsum(length) - length
        first = np.append(True, window[1:] != window[:-1])
        filled = np.bincount(window, length).astype(np.int64)[window]
        return pdf.assign(
            sequence_id=(pdf["block"].to_numpy().astype(np.int64) * (1 << 24) + window) * 2,
            offset=before - np.maximum.accumulate(np.where(first, before, 0)),
            padded_length=np.where(filled & (filled - 1) == 0, filled, capacity),
        )[columns]

    block = F.pmod(F.xxhash64("row", "start"), F.lit(blocks)).cast("int")
    schema = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
    packed = small.withColumn("block", block).groupBy("block").applyInPandas(fill, schema)
    whole = found.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
    whole = whole.withColumns({"offset": F.lit(0).cast("long"), "padded_length": F.lit(capacity).cast("long")})
    return packed.unionByName(whole).drop("row")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
