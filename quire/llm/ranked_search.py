"""Ranked lexical search (12): sort-based accumulation of item-document impacts.

All documents are ranked for each item by the sum of the impacts of the terms that both hold. Items are taken in groups of bounded text, and each
group goes over all documents:

1. *Postings.* One pass finds the group's terms in every text: of each document its number of terms, those terms and how often each occurs. Their document frequencies are counted along the way.
2. *Accumulation.* A task concatenates, for its documents, an (item, document, impact) entry for each item of each posting, sorts the packed item-document
   keys by radix (16 bits at a time) and sums the impacts of equal keys. Of each item it keeps its best in a heap.
3. *Selection.* What tasks kept is dealt out by ranges of item, score and id; each range selects by heap again, and ranks are numbers among what is left.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.byte_words import Scanner, buffers, in_slices
from quire.llm.common import partitions, table, text_batches, trim, whole_text, worker_cache, written

BEST = 10
#: Bytes of text of a group's items together (a longer item is a group of its own), of a slice of documents, and entries sorted at a time.
GROUP_BYTES, SLICE_BYTES, ENTRIES = 4 << 20, 4 << 20, 2 << 20
_TERM_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def _scanner() -> Scanner:
    return Scanner(_TERM_BYTES, _LOWER)


class Index:
    """The terms of a group of items, by hashes of 128 bits in order, and the items of each: those of term t are ``items[at[t] : at[t + 1]]``."""

    def __init__(self, texts: list[str]):
        import pyarrow as pa

        w = _scanner().words(*buffers(pa.array(texts, pa.large_string())))
        both = np.stack([w.h1, w.h2], axis=1)
        terms, which = np.unique(both, axis=0, return_inverse=True) if len(w) else (both, np.zeros(0, np.int64))
        self.h1, self.h2 = terms[:, 0].copy(), terms[:, 1].copy()
        pairs = np.unique(which.reshape(-1).astype(np.int64) * max(1, len(texts)) + w.text)
        self.items = (pairs % max(1, len(texts))).astype(np.int32)
        self.at = np.searchsorted(pairs // max(1, len(texts)), np.arange(len(terms) + 1))

    def __len__(self) -> int:
        return len(self.h1)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The term of each pair of hashes, or -1."""
        if not len(self):
            return np.full(len(h1), -1)
        # terms with equal first hashes, should there be any, lie next to each other
        a = np.searchsorted(self.h1, h1)
        b = np.minimum(a, len(self) - 1)
        found = np.where((self.h1[b] == h1) & (self.h2[b] == h2), b, -1)
        for i in np.flatnonzero(self.h1[1:] == self.h1[:-1]) + 1:
            found[(h1 == self.h1[i]) & (h2 == self.h2[i])] = i
        return found


def radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of non-negative numbers, by 16 bits at a time from the lowest."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(keys.max()) if len(keys) else 0, 16
    while top >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


_POSTINGS = "kind int, id long, n long, terms array<int>, tf array<long>"


def postings(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    """kind 0: of each document with a term, its id, number of terms, the index's terms in it and how often each; kind 1: of a slice, its terms and in how many documents each occurs."""

    def run(batches):
        import pyarrow as pa

        scan, known = worker_cache("search terms", _scanner), index.value

        def out(kind, ids, n, terms, tf, at):
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (terms.astype(np.int32), tf.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n, pa.int64()), *lists], names=[f.split()[0] for f in _POSTINGS.split(", ")])

        for b in in_slices(batches, "_body", SLICE_BYTES):
            w = scan.words(*buffers(b.column(1)))
            n = np.bincount(w.text, minlength=len(b))
            term = known.find(w.h1, w.h2)
            hit = term >= 0
            keys, tf = np.unique(w.text[hit] * max(1, len(known)) + term[hit], return_counts=True)
            text, term = keys // max(1, len(known)), keys % max(1, len(known))
            some = np.flatnonzero(n)
            at = np.searchsorted(text, np.append(some, len(b)))
            yield out(0, b.column(0).take(pa.array(some)), n[some], term, tf, at)
            seen, df = np.unique(term, return_counts=True)
            yield out(1, pa.nulls(1, pa.int64()), np.zeros(1, np.int64), seen, df, [0, len(seen)])
            del w, b
        trim()

    return docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_body")).mapInArrow(run, _POSTINGS)


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of impacts of each item and document, by item, then document."""
    keys = item.astype(np.int64) * n_docs + doc
    order = radix_order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(impact[order], first) if len(first) else np.zeros(0, np.int64)
    return keys[first] // n_docs, keys[first] % n_docs, sums


class Best:
    """The best documents of each item so far: largest score, then least id; null ids after all others."""

    def __init__(self, most: int):
        self.most, self.heaps = most, {}

    def add(self, item: int, score: int, doc) -> None:
        heap = self.heaps.setdefault(item, [])
        entry = (score, -doc if doc is not None else -(1 << 63))
        if len(heap) < self.most:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def least(self, items: int) -> np.ndarray:
        """The score that a document needs to be among the best of each of so many items."""
        out = np.ones(items, np.int64)
        for i, heap in self.heaps.items():
            if len(heap) == self.most:
                out[i] = heap[0][0]
        return out

    def rows(self) -> list[tuple]:
        return [(i, None if d == -(1 << 63) else -d, s) for i, heap in self.heaps.items() for s, d in heap]


def _best_batch(rows: list[tuple]):
    import pyarrow as pa

    items, docs, scores = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (items, docs, scores)], names=["item", "doc", "score"])


def score_group(found: DataFrame, index, weights, n_docs: int, n_terms: int, items: int, best: int) -> DataFrame:
    """item (its place in the group), doc, score: of each item, each task's best documents."""

    def run(batches):
        known, weight = index.value, weights.value
        degree = np.diff(known.at)
        kept = Best(best)
        for b in batches:
            ids = b.column(0).to_pylist()
            n = b.column(1).to_numpy(zero_copy_only=False)
            at = b.column(2).offsets.to_numpy()
            terms, tf = (b.column(k).values.to_numpy(zero_copy_only=False) for k in (2, 3))
            per = np.append(0, np.cumsum(degree[terms[at[0] : at[-1]]]))[at - at[0]]  # entries up to each document
            a = 0
            while a < len(ids):
                z = max(a + 1, int(np.searchsorted(per, per[a] + ENTRIES, side="right")) - 1)
                t, k = terms[at[a] : at[z]], tf[at[a] : at[z]]
                m = 10 + 90 * n[a:z] * n_docs // n_terms
                doc = np.repeat(np.arange(z - a), np.diff(at[a : z + 1]))
                impact = weight[t] * (1_000_000_000 * k // (1000 * k + 8 * m[doc]))
                d = degree[t]
                entry = np.arange(int(d.sum())) + np.repeat(known.at[t] - np.append(0, np.cumsum(d)[:-1]), d) if len(t) else np.zeros(0, np.int64)
                item, doc, score = accumulate(known.items[entry], np.repeat(doc, d), np.repeat(impact, d), z - a)
                for i in np.flatnonzero(score >= kept.least(items)[item]):
                    kept.add(int(item[i]), int(score[i]), ids[a + int(doc[i])])
                a = z
        yield _best_batch(kept.rows())
        trim()

    return found.filter("kind = 0 AND size(terms) > 0").select("id", "n", "terms", "tf").mapInArrow(run, "item long, doc long, score long")


def _selected(rows: DataFrame, best: int) -> DataFrame:
    """Of each item the best rows: by heaps over ranges of (item, score, id), then by number."""

    def run(batches):
        kept = Best(best)
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in (0, 2, 1))):
                kept.add(*r)
        yield _best_batch(kept.rows())

    by = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), F.col("item"), *by).mapInArrow(run, rows.schema)
    return ranged.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= best)


def _groups(items: DataFrame, group_bytes: int) -> list[list]:
    """The numbers of hash groups of (id, body) rows, as few as keep each at the limit or at one item."""
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = max(1, -(-total // group_bytes))
    while True:
        group = F.pmod(F.xxhash64("id"), F.lit(n))
        most = items.groupBy(group.alias("g")).agg(F.sum(F.octet_length("body")).alias("size"), F.count(F.lit(1)).alias("n")).filter(f"size > {2 * group_bytes} AND n > 1")
        if n > 1 << 20 or most.isEmpty():
            return [items.filter(group == g) for g in range(n)]
        n *= 2


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item its best documents with a score above 0, equal scores by ascending id.

    Rows that repeat an item's id are one item with the terms of all. A null or empty text has no terms, and an item without any has no rows; a null item id is an item too, a
    null document id comes after all others of its score; rows that repeat a document's id are ranked each by itself. Texts are read whole. Without
    documents or items the result is empty. Other columns take no part, whatever their names.
    """
    spark = docs.sparkSession
    text_batches(spark)
    grouped = written(items.select(F.col(item_col).cast("long").alias("id"), whole_text(item_text).alias("body")).groupBy("id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("body"))).alias("body")))
    out = []
    for group in _groups(grouped, group_bytes):
        rows = group.orderBy("id").collect()  # bounded by _groups
        made = Index([r.body for r in rows])
        index = spark.sparkContext.broadcast(made)
        found = written(postings(docs, index, id_col, text_col))
        n_docs, n_terms = found.filter("kind = 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequent = found.filter("kind = 1").select(F.explode(F.arrays_zip("terms", "tf")).alias("t")).groupBy("t.terms").agg(F.sum("t.tf").alias("df")).collect()  # a number for each term of the index
        weight = np.zeros(len(made), np.int64)
        for r in frequent:
            weight[r.terms] = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * r.df + 1)))
        scored = score_group(found, index, spark.sparkContext.broadcast(weight), n_docs, max(1, n_terms), len(rows), best)
        chosen = _selected(written(scored), best)
        ids = spark.createDataFrame([(i, r.id) for i, r in enumerate(rows)], "item long, item_id long")
        out.append(chosen.join(F.broadcast(ids), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
terms AS (SELECT doc_id, unnest(regexp_extract_all(body, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS occurrences FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // occurrences))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
