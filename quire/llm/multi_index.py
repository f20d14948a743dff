"""Approximate nearest neighbours (3): an inverted multi-index.

Unit vectors are cut in halves, each half has centroids of its own, and a vector's cell is its pair of nearest
centroids. A query goes through the cells by the sum of its two squared distances, with a heap, until they hold enough rows; the rows of
these cells are ranked by their exact cosines. How many rows are enough is measured: sampled queries are compared with
all rows, and the share is taken within which nearly all of their true neighbours lie.

Cells are dealt to blocks of bounded size, a large cell to several, so that no task holds a hot cell; queries from neighbouring cells make up parts of
bounded size, and a block's rows go to the parts that walk one of its cells. A query's product is taken with the rows of its walked cells alone.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import partitions, table, written

#: Rows the centroids are fitted on (and their bytes), and queries the share is measured with, at most.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES = 20_000, 64 << 20, 64
#: Of the sampled queries' true neighbours so many must be found.
WANTED_RECALL = 0.96
#: Rows of a block and queries of a part, at most.
BLOCK_ROWS, PART_QUERIES = 4096, 4096
#: Centroids of a half, at most: their number grows with the fourth root of the rows, and reaches this at four billion.
MAX_CENTROIDS = 1024
_ROUNDS = 12


def _squared(points, centroids):
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)[None]


def centroids_of(points, k: int, seed: int = 0):
    """Lloyd's rounds from k of the points; an empty centroid stays where it was."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(_ROUNDS):
        near = _squared(points, c).argmin(1)
        for d in range(c.shape[1]):
            total = np.bincount(near, points[:, d], minlength=len(c))
            n = np.bincount(near, minlength=len(c))
            c[:, d] = np.where(n > 0, total / np.maximum(n, 1), c[:, d])
    return c


def walk(first, second, counts, wanted: float):
    """Cells (first * k2 + second) by rising sum of their distances, with a heap, until they hold the wanted number of rows."""
    import numpy as np

    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, have = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if counts[cell]:
            out.append(cell)
            have += int(counts[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def best(queries, query_ids, rows, row_ids, k: int, cells=None, walked=None):
    """(query, row, cosine) of each query's k nearest rows but itself: the largest cosine, then the least id.

    With ``cells`` (of the rows) and ``walked`` (an array of cells for each query) only rows of the walked cells are looked at.
    A matrix product finds those near the k-th; their cosines are computed anew, each by itself, so that equal
    vectors have equal cosines wherever they lie.
    """
    import numpy as np

    out = []
    if cells is not None:
        order = np.argsort(cells, kind="stable")
        rows, row_ids, cells = rows[order], row_ids[order], cells[order]
        names, first = np.unique(cells, return_index=True)
        ends = np.append(first[1:], len(cells))
    q_norm, r_norm = np.sqrt((queries**2).sum(1)), np.sqrt((rows**2).sum(1))
    unit = rows / r_norm[:, None]
    for a in range(0, len(queries), 256):
        asked = queries[a : a + 256] / q_norm[a : a + 256, None]
        if cells is None:
            s = asked @ unit.T
        else:
            s = np.full((len(asked), len(rows)), -np.inf)
            lists = walked[a : a + 256]
            who, cell = np.repeat(np.arange(len(asked)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int32)])
            turn = np.argsort(cell, kind="stable")
            who, cell = who[turn], cell[turn]
            at = np.searchsorted(cell, np.stack([names, names + 1]))
            for lo, hi, x, y in zip(*at, first, ends):
                if hi > lo:
                    s[who[lo:hi], x:y] = asked[who[lo:hi]] @ unit[x:y].T
        s[query_ids[a : a + 256, None] == row_ids[None]] = -np.inf
        for x in range(len(s)):
            line, m = s[x], min(k, s.shape[1])
            kth = np.partition(line, len(line) - m)[len(line) - m]
            near = np.flatnonzero((line >= kth - 1e-9) & (line > -np.inf))
            exact = (rows[near] * queries[a + x]).sum(1) / (r_norm[near] * q_norm[a + x])
            for y in np.lexsort((row_ids[near], -exact))[:k]:
                out.append((int(query_ids[a + x]), int(row_ids[near[y]]), float(exact[y])))
    return out


@dataclass
class MultiIndex:
    """rows: vec_id, cell, block, vec (doubles as bytes); the rest is bounded by the number of cells."""

    rows: DataFrame
    first: object
    second: object
    counts: object
    starts: object
    parts: object
    share: float

    @property
    def total(self) -> int:
        return int(self.counts.sum())


def _vectors(df: DataFrame, id_col: str, vector_col: str, dims: int | None) -> DataFrame:
    """vec_id, vec of the vectors that take part: not null, of ``dims`` finite components (if not given, of the most common length), not zero."""
    v = F.col(vector_col).cast("array<double>")
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = kept.filter((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    if dims is None:
        common = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dims = common["d"] if common else 1
    kept = kept.filter(F.size("v") == dims)

    def packed(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in np.ascontiguousarray(flat)], pa.binary())], names=["vec_id", "vec"])

    # rows that repeat an id are one: that with the least vector
    return kept.mapInArrow(packed, "vec_id long, vec binary").groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _matrix(column):
    import numpy as np

    data = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1) if data else np.zeros((0, 1))


def build(df: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None, share: float | None = None) -> MultiIndex:
    """Indexes every vector that takes part. ``share`` of the rows that a query looks at; if None, it is measured for ``k`` neighbours."""
    import numpy as np

    base = written(_vectors(df, id_col, vector_col, dims))
    n = base.count()
    by_hash = F.xxhash64(F.col("vec_id"))
    width = base.select(F.max(F.octet_length("vec"))).first()[0] or 1
    sample = _matrix([bytes(r["vec"]) for r in base.orderBy(by_hash).limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // width))).select("vec").collect()])
    unit = sample / np.sqrt((sample**2).sum(1))[:, None] if len(sample) else sample
    half = max(1, unit.shape[1] // 2)
    size = int(min(MAX_CENTROIDS, max(1, len(unit) // 4), max(4, round(4 * max(n, 1) ** 0.25))))
    first = centroids_of(unit[:, :half], size) if n else np.zeros((1, half))
    second = centroids_of(unit[:, half:], size) if n and unit.shape[1] > half else np.zeros((1, max(0, unit.shape[1] - half)))

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column("vec"))
            cells = np.zeros(0, np.int32)
            if len(x):
                x = x / np.sqrt((x**2).sum(1))[:, None]
                cells = _squared(x[:, :half], first).argmin(1) * len(second) + _squared(x[:, half:], second).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(cells, pa.int32())], names=["vec_id", "vec", "cell"])

    indexed = written(base.mapInArrow(assign, "vec_id long, vec binary, cell int"))
    counts = np.zeros(len(first) * len(second), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # a row for each cell
        counts[r["cell"]] = r["count"]
    parts = np.maximum(1, -(-counts // BLOCK_ROWS))
    starts, block, filled = np.zeros(len(counts), np.int64), 0, 0
    for c, m in enumerate(counts.tolist()):
        if filled and (filled + m > BLOCK_ROWS or parts[c] > 1):
            block, filled = block + 1, 0
        starts[c] = block
        if parts[c] > 1:
            block += int(parts[c])
        else:
            filled += m
    schema = "cell int, start long, parts int"
    places = indexed.sparkSession.createDataFrame([(c, int(starts[c]), int(parts[c])) for c in np.flatnonzero(counts).tolist()], schema)
    rows = indexed.join(F.broadcast(places), "cell")  # a row for each cell, MAX_CENTROIDS squared at most
    rows = rows.withColumn("block", F.col("start") + F.pmod(by_hash, F.col("parts"))).select("vec_id", "vec", "cell", "block")
    index = MultiIndex(rows, first, second, counts, starts, parts, 1.0)
    index.share = share if share is not None else _measured(index, indexed, k)
    return index


def _distances(x, index: MultiIndex):
    import numpy as np

    half = index.first.shape[1]
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    return _squared(unit[:, :half], index.first), _squared(unit[:, half:], index.second)


def _measured(index: MultiIndex, indexed: DataFrame, k: int) -> float:
    """The share of rows, nearest cells first, within which WANTED_RECALL of the sampled queries' true neighbours lie."""
    import numpy as np

    chosen = indexed.orderBy(F.xxhash64(F.col("vec_id"), F.lit("query"))).limit(SAMPLE_QUERIES).collect()
    if not chosen:
        return 1.0
    queries, ids = _matrix([bytes(r["vec"]) for r in chosen]), np.array([r["vec_id"] for r in chosen])

    def scan(batches):
        import pyarrow as pa

        for b in batches:
            if len(b):
                cell = dict(zip(b.column("vec_id").to_pylist(), b.column("cell").to_pylist()))
                got = best(queries, ids, _matrix(b.column("vec")), b.column("vec_id").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(q, r, s, cell[r]) for q, r, s in got]) if got else [[]] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["q", "r", "s", "cell"])

    from pyspark.sql import Window

    w = Window.partitionBy("q").orderBy(F.desc("s"), "r")
    found = indexed.mapInArrow(scan, "q long, r long, s double, cell int").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    cells = found.select("q", "cell").collect()  # k rows for each of SAMPLE_QUERIES
    d1, d2 = _distances(queries, index)
    needed = []
    for i, q in enumerate(ids.tolist()):
        total = (d1[i][:, None] + d2[i][None]).ravel()
        order = np.argsort(total, kind="stable")
        reach = np.empty(len(order), np.int64)
        reach[order] = np.cumsum(index.counts[order])
        needed += [reach[c["cell"]] / index.total for c in cells if c["q"] == q]
    return float(np.quantile(needed, WANTED_RECALL)) if needed else 1.0


def _parts(index: MultiIndex, queries: DataFrame):
    """The part of a query by the block of its own cell: neighbouring blocks with PART_QUERIES queries or so; and how many parts a crowded block has."""
    import numpy as np

    light = MultiIndex(None, index.first, index.second, None, None, None, 0.0)

    def homes(batches):
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column("vec"))
            if len(x):
                d1, d2 = _distances(x, light)
                yield pa.RecordBatch.from_arrays([pa.array(d1.argmin(1) * d2.shape[1] + d2.argmin(1), pa.int64())], names=["cell"])

    asked = np.zeros(len(index.starts), np.int64)
    for r in queries.select("vec").mapInArrow(homes, "cell long").groupBy("cell").count().collect():  # a row for each cell
        asked[r["cell"]] = r["count"]
    split = np.maximum(1, -(-asked // PART_QUERIES))
    order = np.argsort(index.starts, kind="stable")
    part, now, have = np.zeros(len(asked), np.int64), 0, 0
    for c in order.tolist():
        n = int(asked[c])
        if n and have and (have + n > PART_QUERIES or split[c] > 1):
            now, have = now + 1, 0
        part[c] = now
        have += n
        if split[c] > 1:
            now, have = now + int(split[c]), 0
    return part, split


def search(index: MultiIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, n_scored of the k nearest rows found for each query (vec_id, vec): fewer if there are fewer. n_scored: rows of the cells it walked."""
    wanted = max(k + 1, index.share * index.total)
    light = MultiIndex(None, index.first, index.second, index.counts, index.starts, index.parts, index.share)
    part, split = _parts(index, queries)

    def plan(batches):
        """A row for each block that a query goes to, with its cells there."""
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column("vec"))
            if not len(x):
                continue
            d1, d2 = _distances(x, light)
            home = d1.argmin(1) * d2.shape[1] + d2.argmin(1)
            out = []
            for i, (q, vec) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("vec").to_pylist())):
                cells = np.array(sorted(walk(d1[i], d2[i], light.counts, wanted)), np.int32)
                by: dict[int, list[int]] = {}
                for c in cells.tolist():
                    for p in range(int(light.parts[c])):
                        by.setdefault(int(light.starts[c]) + p, []).append(c)
                own = int(part[home[i]]) + q % int(split[home[i]])
                n = int(light.counts[cells].sum())
                out += [(block, own, q, vec, np.array(c, np.int32).tobytes(), n) for block, c in by.items()]
                if len(out) > 2000:
                    yield table_of(out)
                    out = []
            if out:
                yield table_of(out)

    def table_of(out):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["block", "part", "vec_id", "vec", "cells", "n_scored"])

    def rank(rows, asked):
        import numpy as np
        import pandas as pd

        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "n_scored": []}).astype({"query_id": "int64", "vec_id": "int64", "n_scored": "int64"})
        walked = [np.frombuffer(c, np.int32) for c in asked["cells"]]
        out = best(_matrix(asked["vec"].tolist()), asked["vec_id"].to_numpy(), _matrix(rows["vec"].tolist()), rows["vec_id"].to_numpy(), k, rows["cell"].to_numpy(), walked)
        found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return found.assign(n_scored=found["query_id"].map(dict(zip(asked["vec_id"], asked["n_scored"]))).astype("int64"))

    from pyspark.sql import Window

    n = partitions(queries.sparkSession)
    asked = written(queries.repartition(n).mapInArrow(plan, "block long, part long, vec_id long, vec binary, cells binary, n_scored long"))
    pairs = written(asked.select("block", "part").distinct())
    rows = index.rows.join(pairs, "block").select("block", "part", "vec_id", "vec", "cell")
    near = rows.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(rank, "query_id long, vec_id long, score double, n_scored long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score", "n_scored")


def op3_multi_index(spark, sf_dir: str) -> DataFrame:
    """The rows whose vec_id is divisible by 50, against all rows: 5 nearest each, with the number of rows that each was scored against.

    Null, zero and non-finite vectors take no part, nor do those of another length than the commonest (of equally common ones the shorter): no cosine is defined between lengths.
    Rows that repeat an id are one, with the least vector; ties go to the smaller id; an empty table gives an empty one; other columns are not read.
    """
    index = build(table(spark, sf_dir, "embeddings"), 5)
    return search(index, index.rows.filter(F.pmod("vec_id", F.lit(50)) == 0).select("vec_id", "vec"))
