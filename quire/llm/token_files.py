"""Token-ID output (5): Arrow files of equal-length sequences.

A file's record batches hold fixed-size lists: ``input_ids`` (unsigned 16-bit ids where the vocabulary fits,
else 32-bit), ``attention_mask`` (false where the last sequence is padded), ``starts`` (true at a document's
first id) and, for each sequence, the ids of the documents that start in it. Values of a fixed-size list lie
side by side, so sequence i of a batch is a slice of the mapped file, without any copy, and so is its mask (bits).
All batches but a file's last hold the same number of sequences, so the batch of a sequence is known without a look at others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_parts, partitions, shared_dir, table, text_batches, whole_text, written
from quire.llm.tokens import encoder, public_path

SEQUENCE = 2048
_ROWS = 256
#: Ids after which a task starts another file, and rows in a batch of read documents.
FILE_IDS, _READ_ROWS = 1 << 28, 8192
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2


def _open(path: str):
    """File system and path of a URI or local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_file(path: str, documents: Iterable[tuple[int | None, bytes]], wide: bool = False, sequence: int = SEQUENCE) -> tuple[int, int, int]:
    """Writes (doc_id, little-endian 32-bit ids) to an Arrow file; returns documents, ids and sequences.

    At most a few batches are held. The file gets its name once it is whole, so a retried task replaces it.
    """
    import uuid

    import numpy as np
    import pyarrow as pa

    kind = np.uint32 if wide else np.uint16
    schema = pa.schema([
        ("input_ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("attention_mask", pa.list_(pa.bool_(), sequence)),
        ("starts", pa.list_(pa.bool_(), sequence)), ("doc_ids", pa.list_(pa.int64())),
    ])
    store, place = _open(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}.part"
    held, firsts, names = [], [], []  # arrays of ids, positions of first ids in them, their documents
    size = n_docs = n_ids = n_sequences = 0

    def batches(last: bool):
        nonlocal held, firsts, names, size, n_sequences
        ids = np.concatenate(held) if held else np.zeros(0, kind)
        rows = -(-len(ids) // sequence) if last else len(ids) // sequence // _ROWS * _ROWS
        whole = min(rows * sequence, len(ids))
        used = np.zeros(rows * sequence, kind)
        used[:whole] = ids[:whole]
        at = np.asarray(firsts, np.int64)
        k = int(np.searchsorted(at, whole))
        starts, mask = np.zeros(len(used), bool), np.arange(len(used)) < whole
        starts[at[:k]] = True
        offsets = np.searchsorted(at[:k], np.arange(rows + 1) * sequence).astype(np.int32)
        for a in range(0, rows, _ROWS):
            b = min(a + _ROWS, rows)
            part = slice(a * sequence, b * sequence)
            yield pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(used[part]), sequence),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[part]), sequence),
                pa.FixedSizeListArray.from_arrays(pa.array(starts[part]), sequence),
                pa.ListArray.from_arrays(pa.array(offsets[a : b + 1] - offsets[a]), pa.array(names[offsets[a] : offsets[b]], pa.int64())),
            ], schema=schema)
        n_sequences += rows
        held, firsts, names = [ids[whole:]], [int(x) - whole for x in at[k:]], names[k:]
        size = len(ids) - whole

    with store.open_output_stream(draft) as out, pa.ipc.new_file(out, schema) as sink:
        for name, data in documents:
            ids = np.frombuffer(data, "<u4").astype(kind)
            firsts.append(size)
            names.append(name)
            held.append(ids)
            size += len(ids)
            n_docs, n_ids = n_docs + 1, n_ids + len(ids)
            if size >= _ROWS * sequence:
                for batch in batches(False):
                    sink.write_batch(batch)
        for batch in batches(True):
            sink.write_batch(batch)
    store.move(draft, place)
    return n_docs, n_ids, n_sequences


class TokenFile:
    """Random access to a file's sequences; a local file is mapped, and ids are views into it."""

    def __init__(self, path: str):
        import pyarrow as pa
        from pyarrow import fs

        store, place = _open(path)
        self._source = pa.memory_map(place) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(place)
        self.reader = pa.ipc.open_file(self._source)

    def batches(self) -> Iterator:
        for i in range(self.reader.num_record_batches):
            yield self.reader.get_batch(i)

    def sequence(self, i: int):
        """(ids, mask) of sequence i: a numpy view and an Arrow view of bits, both into the file."""
        at, row = divmod(i, _ROWS)
        batch = self.reader.get_batch(at) if 0 <= at < self.reader.num_record_batches else None
        if batch is None or row >= len(batch):
            raise IndexError(i)
        n = batch.schema.field("input_ids").type.list_size
        ids = batch.column("input_ids").flatten().to_numpy(zero_copy_only=True)[row * n : (row + 1) * n]
        return ids, batch.column("attention_mask").flatten().slice(row * n, n)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id, ids, crc32 of the ids as little-endian unsigned 32-bit integers), in the file's order."""
        import numpy as np

        name = count = crc = None
        for batch in self.batches():
            mask = batch.column("attention_mask").flatten().to_numpy(zero_copy_only=False)
            n = int(mask.sum())
            ids = batch.column("input_ids").flatten().to_numpy(zero_copy_only=True)[:n].astype("<u4")
            cuts = np.flatnonzero(batch.column("starts").flatten().to_numpy(zero_copy_only=False))
            names = batch.column("doc_ids").flatten().to_pylist()
            bounds = [0, *cuts.tolist(), n]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if k:  # a document starts at a
                    if count is not None:
                        yield name, count, crc
                    name, count, crc = names[k - 1], 0, 0
                if b > a:
                    count, crc = count + b - a, zlib.crc32(ids[a:b], crc)
        if count is not None:
            yield name, count, crc

    def close(self) -> None:
        self._source.close()


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents, ascending by id over the files, and returns a row for each file that holds any:
    file (its place in the order), path, start (ids in the files before), n_docs, n_ids, n_sequences.

    Every document, an empty or null text too, ends in ``end_id``. Rows that repeat an id follow each other by their text; null ids come first.
    Long texts are encoded whole, a part at a time; an empty table gives no file; other columns take no part, whatever their names.
    """
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    vocabulary = vocabulary or public_path(VOCABULARY)

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        import struct

        enc, end = encoder(vocabulary, "byte"), struct.pack("<I", end_id)
        part, k = TaskContext.get().partitionId(), 0
        rows = ((i, ids + end) for b in in_parts(batches) for i, ids in zip(b.column("id").to_pylist(), enc.encode_all(b.column("body").to_pylist())))
        import pyarrow as pa

        def some(row):
            """The next rows, this one first, until a file is full."""
            n = 0
            while row is not None:
                yield row
                n += len(row[1]) // 4
                row = next(rows, None) if n < FILE_IDS else None

        first = next(rows, None)
        while first is not None:
            path = f"{folder}/part-{part:06d}-{k:06d}.arrow"
            got = write_file(path, some(first), max(enc.vocab_size - 1, end_id) > 0xFFFF, sequence)
            yield pa.RecordBatch.from_pandas(pd.DataFrame([[part << 20 | k, path, *got]], columns=["file", "path", "n_docs", "n_ids", "n_sequences"]).astype({"file": "int64"}), preserve_index=False)
            first, k = next(rows, None), k + 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body"))
    n = partitions(spark)
    # Bounds from the ids alone: range partitioning itself would sample by reading all texts once more.
    places = [k / n for k in range(1, n)]
    bounds = rows.select("id").approxQuantile("id", places, 0.1 / n) if n > 1 else []
    above = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]).cast("array<bigint>")
    slot = F.coalesce(F.size(F.filter(above, lambda b: b <= F.col("id"))), F.lit(0))
    dealt = rows.withColumn("slot", F.when(F.col("id").isNull(), 0).otherwise(slot)).repartitionById(n, "slot").drop("slot").sortWithinPartitions("id", "body")
    files = written(dealt.mapInArrow(write, "file long, path string, n_docs long, n_ids long, n_sequences long"))
    start, found = 0, []
    for r in sorted(files.collect(), key=lambda r: r["file"]):  # a row for each file
        found.append((r["file"], r["path"], start, r["n_docs"], r["n_ids"], r["n_sequences"]))
        start += r["n_ids"]
    return spark.createDataFrame(found, "file long, path string, start long, n_docs long, n_ids long, n_sequences long")


def read_tokens(files: DataFrame) -> DataFrame:
    """A row for each document in the files of write_tokens: doc_id, start, n_tokens, ids_crc32."""

    def read(batches):
        from itertools import islice

        import pandas as pd

        def rows(source, start):
            for name, n, crc in source.documents():
                yield name, start, n, crc
                start += n

        for b in batches:
            for path, start in zip(b["path"], b["start"]):
                source = TokenFile(path)
                found = rows(source, start)
                while out := list(islice(found, _READ_ROWS)):
                    yield pd.DataFrame({"doc_id": pd.array([x[0] for x in out], "Int64"), "start": [x[1] for x in out], "n_tokens": [x[2] for x in out], "ids_crc32": [x[3] for x in out]})
                source.close()

    return files.repartition(partitions(files.sparkSession)).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_tokens(write_tokens(docs, shared_dir(spark)))
