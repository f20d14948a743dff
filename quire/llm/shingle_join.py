"""N-gram Jaccard join (7): signature trees over the documents that can have a partner at all.

Exact, without a cap. A document's set are its distinct word shingles, as 64-bit hashes. Two sets are linked when
100 * intersection >= 80 * union. All documents go through these steps:

1. *Sharing.* Of each set the least 35 % or so of the hashes are dealt out in blocks by hash range; a block says which of them
   occur in another document too. Linked sets share so many of these that a document with fewer has no partner and is done.
2. Documents with equal sets (by fingerprints of 128 bits) become one. The rest are held against each other again, by their whole sets.
3. *Trees.* Sets that agree in their least hash (then the second, the third) meet in a signature tree; a bucket that is
   too large for one task is split into chunks, whose classes meet again by representatives.
4. *The rest.* Only a set most of whose hashes occur in several classes may still have a link to another class. Classes of
   such sets that share one of the hashes that a link must share (the prefix filter, rarest hashes first) meet in one more tree; of a
   cluster too large for one task all pairs of chunks meet that share such a hash.

So hot passages don't gather documents (few documents consist of them), copies are one row, and near copies are one class after step 3.
Blocks are fixed parts of the hash range, every one with as many hashes as any other; a hash goes there once a batch.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fits, guarded, in_parts, partitions, table, text_batches, whole_text, worker_cache, written

WORDS, PERCENT = 5, 80
#: Share of a set's hashes that linked sets must share in step 1.
SHARE = 15
#: Sets that one tree holds; in step 4 more, up to the second number, where a cluster would have more chunks than the third.
CHUNK, LARGEST_CHUNK, CHUNKS = 128, 1000, 32
#: Rounds of step 3.
ROUNDS = 3
_MAX_WORDS = 300_000
_FLUSH_DOCS, _FLUSH_HASHES = 60_000, 1_000_000
_NOBODY = 0xFFFF
#: Hashes that a block holds, and characters of text for one of them, about.
_BLOCK_HASHES, _CHARS_A_HASH = 8_000_000, 16


class _WordHashes(dict):
    """64-bit hashes of words; the first so many words are kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) < _MAX_WORDS:
            self[word] = value
        return value


def shingles(text: str, words: int = WORDS):
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z become small letters, words are runs without white space (space and the characters 9 to 13), just as bytes.split and
    bytes.lower have it. A text with fewer words than a shingle has the one of all its words; one without words none.
    """
    import numpy as np
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    hashes = worker_cache("words", _WordHashes)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9) ^ (mixed >> np.uint64(32)))


def _up(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def prefix_of(n: int, share: int | None, percent: int) -> tuple[int, int]:
    """How many of its n least hashes a set deals out, and how many of them a partner's must hold.

    Linked sets have at least percent of the larger in common. So the first l common hashes lie among the first n - that + l of
    either set; with l as ``share`` of the smaller set's size, which is at least percent of the larger's.
    """
    overlap = _up(n, percent)
    if share is None:
        return n, overlap
    return min(n, n - overlap + max(1, _up(n, share))), max(1, _up(overlap, share))


class _Batch:
    """Hashes of many sets, by owner; what goes to the blocks, and what the sets have in common already."""

    def __init__(self, number: int):
        self.number, self.hashes, self.owners, self.classes, self.rows, self.size = number, [], [], [], [], 0

    def add(self, row: tuple, dealt, need: int, cls: int | None) -> None:
        import numpy as np

        self.hashes.append(dealt)
        self.owners.append(np.full(len(dealt), len(self.rows), np.uint16))
        if cls is not None:
            self.classes.append(np.full(len(dealt), cls, np.int64))
        self.rows.append((*row, need))
        self.size += len(dealt)

    def full(self) -> bool:
        return len(self.rows) >= _FLUSH_DOCS or self.size >= _FLUSH_HASHES

    def emit(self, blocks: int, labelled: bool):
        """(block, batch, kind, a, b, c): kind 0 are hashes (32 bits of each), owners and classes, kind 1 the sets themselves."""
        import numpy as np

        h = np.concatenate(self.hashes)
        owner = np.concatenate(self.owners)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        cls = np.concatenate(self.classes)[order] if labelled else None
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        run = np.diff(np.append(first, len(h)))
        if labelled:  # in common if the run has two classes
            several = np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first) if len(h) else np.zeros(0, bool)
        else:
            several = run > 1
        credit = np.bincount(owner[np.repeat(several, run)], minlength=len(self.rows))
        # A hash in common already goes out once, for the others; one of a single class once for each owner.
        out = np.repeat(~several, run)
        out[first] = True
        known = np.repeat(several, run)[out]
        h, owner = h[out], np.where(known, np.uint16(_NOBODY), owner[out])
        cls = cls[out] if labelled else None
        block = ((h >> np.uint64(32)).astype(np.int64) * blocks) >> 32
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(h)]):
            if b > a:
                yield int(block[a]), self.number, 0, h[a:b].astype(np.uint32).tobytes(), owner[a:b].tobytes(), cls[a:b].tobytes() if labelled else b""
        ids, sizes, prints, need = zip(*self.rows)
        known = np.array([i is not None for i in ids], np.int64)
        ids = np.array([i or 0 for i in ids], np.int64)
        high, low = np.array(prints, np.int64).reshape(-1, 2).T
        yield self.number % blocks, self.number, 1, np.stack([ids, known, np.array(sizes, np.int64), high, low]).tobytes(), (np.array(need, np.int64) - credit).tobytes(), b""


def _shared(dealt: DataFrame, batches_of, share: int | None, percent: int, labelled: bool = False, least_blocks: int = 1) -> DataFrame:
    """id, n, print, check (halves of the fingerprint), open of each set: whether enough of its hashes occur in another set (if labelled: class).

    ``batches_of`` makes (id, (print, check), hashes, class) of the Arrow batches of ``dealt``.
    """
    blocks = max(partitions(dealt.sparkSession), least_blocks)

    def deal(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        batch = _Batch(number)

        def table_of(b):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*b.emit(blocks, labelled)), kinds)], names=["block", "batch", "kind", "a", "b", "c"])

        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for i, p, h, c in batches_of(batches):
            k, need = prefix_of(len(h), share, percent)
            batch.add((i, len(h), p), h[:k], need if len(h) else 1, c)
            if batch.full():
                yield table_of(batch)
                number += 1
                batch = _Batch(number)
        if batch.rows:
            yield table_of(batch)

    def compare(batches):
        """In each block: the owners of hashes that others have too."""
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        for b in batches:
            passed = [[], [], [], []]
            for block, number, kind, x, y, z in zip(*(b.column(k).to_pylist() for k in range(6))):
                if kind:
                    for to, v in zip(passed, (number, 1, x, y)):
                        to.append(v)
                else:
                    held.setdefault(block, []).append((number, x, y, z))
            if passed[0]:
                yield pa.RecordBatch.from_arrays([pa.array(passed[0], pa.int64()), pa.array(passed[1], pa.int32()), pa.array(passed[2], pa.binary()), pa.array(passed[3], pa.binary())], names=["batch", "kind", "a", "b"])
        for block in list(held):
            rows = held.pop(block)
            h = np.concatenate([np.frombuffer(x, np.uint32) for _, x, _, _ in rows])
            owner = np.concatenate([np.frombuffer(y, np.uint16) for _, _, y, _ in rows])
            which = np.repeat(np.arange(len(rows)), [len(x) // 4 for _, x, _, _ in rows])
            order = np.argsort(h, kind="stable")
            s = h[order]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            run = np.diff(np.append(first, len(s)))
            # Within a batch the 32 bits may be alike by chance; that only keeps a set longer.
            if labelled:
                c = np.concatenate([np.frombuffer(z, np.int64) for _, _, _, z in rows])[order]
                nobody = np.logical_or.reduceat(owner[order] == _NOBODY, first)
                several = nobody | (np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first))
            else:
                several = run > 1
            hit = order[np.repeat(several, run)]
            hit = hit[owner[hit] != _NOBODY]
            hit = hit[np.argsort(which[hit], kind="stable")]
            ends = np.searchsorted(which[hit], np.arange(len(rows) + 1))
            out = [(rows[k][0], 0, owner[hit[a:b]].tobytes(), b"") for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["batch", "kind", "a", "b"])

    def gather(batches):
        import numpy as np
        import pyarrow as pa

        counts, sets = {}, {}
        for b in batches:
            for number, kind, x, y in zip(*(b.column(k).to_pylist() for k in range(4))):
                if kind:
                    sets[number] = np.frombuffer(x, np.int64).reshape(5, -1), np.frombuffer(y, np.int64)
                else:
                    got = np.bincount(np.frombuffer(x, np.uint16))
                    have = counts.get(number)
                    if have is None or len(have) < len(got):
                        got, have = (got, have) if have is not None else (got, got[:0])
                        got[: len(have)] += have
                        counts[number] = got
                    else:
                        have[: len(got)] += got
        for number, ((ids, known, sizes, high, low), need) in sets.items():
            count = np.zeros(len(ids), np.int64)
            got = counts.get(number, count[:0])
            count[: len(got)] = got
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(sizes), pa.array(high), pa.array(low), pa.array((count >= need) & (sizes > 0))], names=["id", "n", "print", "check", "open"])

    sent = dealt.mapInArrow(deal, "block int, batch long, kind int, a binary, b binary, c binary").repartitionById(blocks, "block")
    back = sent.mapInArrow(compare, "batch long, kind int, a binary, b binary").repartition(blocks, "batch")
    return back.mapInArrow(gather, "id long, n long, print long, check long, open boolean")


def _print(h) -> tuple[int, int]:
    """A set's 128-bit fingerprint, as two signed numbers."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(h.tobytes(), seed=len(h)))


def _from_texts(words: int):
    def of(batches):
        for b in in_parts(batches):
            for i, text in zip(b.column("id").to_pylist(), b.column("body").to_pylist()):
                h = shingles(text, words)
                yield i, _print(h), h, None

    return of


def _from_sets(batches):
    import numpy as np

    for b in batches:
        for p, data, c in zip(b.column("print").to_pylist(), b.column("hashes").to_pylist(), b.column("class").to_pylist()):
            yield p, (p, 0), np.frombuffer(data, np.uint64), c


def components(edges: DataFrame) -> DataFrame:
    """id, root (the least id that is reachable) of every id in ``edges`` (a, b): least labels, with pointer jumping."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    state = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).select("id", F.least("id", "root").alias("root")))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = state.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        up = state.select(F.col("id").alias("next"), F.col("root").alias("up"))
        now = written(step.join(up, "next", "left").select("id", F.least("next", F.coalesce("up", "next")).alias("root"), (F.least("next", F.coalesce("up", "next")) != F.col("root")).alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("id", "root")
        state = now.select("id", "root")


def _trees(buckets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes whose sets are alike, found in each bucket: columns bucket, class, hashes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from quire.llm.signature_tree import link

        def solve(classes, data):
            before = np.array(classes, np.int64)
            after = link([np.frombuffer(x, np.uint64) for x in data], before, percent)
            return np.unique(np.stack([before, after], 1)[before != after], axis=0)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

        now, classes, data = None, [], []
        for b in batches:
            for k, c, h in zip(b.column("bucket").to_pylist(), b.column("class").to_pylist(), b.column("hashes").to_pylist()):
                if k != now:
                    if len(data) > 1:
                        yield out(solve(classes, data))
                    now, classes, data = k, [], []
                classes.append(c)
                data.append(h)
        if len(data) > 1:
            yield out(solve(classes, data))

    n = partitions(buckets.sparkSession)
    dealt = buckets.select("bucket", "class", "hashes").repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long")


def _named(df: DataFrame, ids: DataFrame, n: int, bytes_per_row: int, how: str = "inner") -> DataFrame:
    """``df`` joined with ``ids`` on print; the ids go to all executors while they are few."""
    return df.join(F.broadcast(ids) if fits(n, bytes_per_row) else ids, "print", how)


def _classes(names: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges).withColumnRenamed("id", "class")
    return names.join(roots, "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root").select(*names.columns)


def _round(sets: DataFrame, names: DataFrame, key: str, chunk: int, percent: int) -> DataFrame:
    """``names`` with the classes joined whose sets meet in the buckets of a hash (column ``key``) and are alike."""
    while True:
        # One set stands for its class in a bucket. At first every set is a class of its own.
        heads = names.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), "class").agg(F.min("print").alias("print"))
        sizes = heads.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        heads = written(heads.join(sizes, "key"))
        rows, most = heads.agg(F.count(F.lit(1)), F.max("size")).first()
        if not rows:
            return names
        parts = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
        bucket = F.xxhash64("key", F.pmod(F.xxhash64("print"), parts))
        edges = written(_trees(_named(sets, heads.select("print", "class", bucket.alias("bucket")), rows, 48), percent))
        if edges.isEmpty():
            return names
        names = written(_classes(names, edges))
        if most <= chunk:
            return names
        left = names.select(key, "class").distinct().groupBy(key).count().agg(F.max("count")).first()[0]
        if left * 2 > most:  # the chunks' classes don't come together: step 4 has them
            return names


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """print, class, token of the hashes that linked sets must share one of: a set's rarest hashes, as many as it may miss and one more; of these those that several classes have.

    The order (documents that hold a hash, then the hash) is the same for all sets, which is all that the prefix filter asks for.
    """
    places = F.posexplode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("_", "at")
    tokens = sets.select("print", "class", "prefix", places, "hashes").select("print", "class", "prefix", F.substring(F.col("hashes"), F.col("at") * 8 + 1, F.lit(8)).alias("token"))
    # Written down, so that the join has an exchange of its own on either side, whose large parts can be split: near copies share their hashes.
    held = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("class").alias("lo"), F.max("class").alias("hi")).filter("df > 1"))
    # What one set alone holds comes first in its order and meets nobody: only its number counts.
    known = tokens.join(held, "token").groupBy("print", "class", "prefix").agg(F.array_sort(F.collect_list(F.struct("df", "token", (F.col("lo") < F.col("hi")).alias("mixed")))).alias("t"))
    known = known.join(sets.select("print", "n"), "print")
    shared = F.slice("t", F.lit(1), F.greatest(F.lit(0), F.col("prefix") - (F.col("n") - F.size("t"))).cast("int"))
    return known.select("print", "class", F.explode(shared).alias("x")).filter("x.mixed").select("print", "class", "x.token")


def _rest(sets: DataFrame, names: DataFrame, chunk: int, percent: int) -> DataFrame:
    """``names`` with the classes joined that still have alike members: exact.

    Classes that share a rare hash make up a cluster, and every set of a cluster meets the others in one place; a cluster of
    several chunks is met by those pairs of chunks that share such a hash. Chunks of one large class needn't meet.
    """
    n = names.count()
    classed = _named(sets, names.select("print", "class"), n, 40)
    open_ = written(_shared(classed.select("print", "hashes", "class"), _from_sets, None, percent, labelled=True).filter("open").select("print"))
    n = open_.count()
    if not n:
        return names
    some = written(_named(classed, open_, n, 24, "left_semi"))
    keys = written(_rare_first(some, percent))
    low = written(keys.groupBy("token").agg(F.min("class").alias("a")))  # as above: for a join whose parts can be split
    links = written(keys.join(low, "token").select("a", F.col("class").alias("b")).filter("a <> b").distinct())
    if links.isEmpty():
        return names
    cluster = written(components(links).select(F.col("id").alias("class"), F.col("root").alias("cluster")))
    member = some.select("print", "class").join(cluster, "class")
    size = member.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("k"))
    # The larger a cluster, the larger its chunks: every pair of them may have to meet.
    width = size.groupBy("cluster").agg(F.least(F.lit(max(chunk, LARGEST_CHUNK)), F.greatest(F.lit(chunk), F.ceil(F.sum("k") / CHUNKS))).alias("width"))
    size = size.join(width, "cluster")
    small = size.groupBy("cluster").agg(F.sum(F.when(F.col("k") <= F.col("width"), F.col("k")).otherwise(0)).alias("small"))
    large = F.col("k") > F.col("width")
    part = F.when(large, F.pmod(F.xxhash64("print"), F.ceil(F.col("k") / F.col("width")))).otherwise(F.pmod(F.xxhash64("class"), F.greatest(F.lit(1), F.ceil(F.col("small") / F.col("width")))))
    owner = F.when(large, F.col("class"))  # only chunks of large classes have one
    placed = member.join(size, ["cluster", "class"]).join(small, "cluster").select("print", "class", "cluster", F.xxhash64("cluster", owner, part).alias("chunk"), owner.alias("owner"))
    placed = written(placed)
    at = keys.select("print", "token").join(placed, "print").select("cluster", "token", "chunk", "owner").distinct()
    pairs = at.join(at.select("cluster", "token", F.col("chunk").alias("other"), F.col("owner").alias("_o")), ["cluster", "token"]).filter("chunk <= other")
    pairs = pairs.filter("owner is null or _o is null or owner <> _o").select("chunk", "other").distinct()
    pairs = written(pairs.withColumn("bucket", F.xxhash64("chunk", "other")))
    ends = pairs.select("bucket", F.explode(F.array_distinct(F.array("chunk", "other"))).alias("chunk"))
    met = written(placed.select("print", "class", "chunk").join(ends, "chunk").select("print", "class", "bucket"))
    edges = written(_trees(_named(some.drop("class"), met, met.count(), 48), percent))
    return names if edges.isEmpty() else written(_classes(names, edges))


def join_shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
                  share: int = SHARE, chunk: int = CHUNK, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id.

    A null or empty text has no shingles and no links; its component is its own id. Texts of any length are read whole. Rows that repeat each other are linked
    (to themselves). A row with a null id belongs to the component of a row with an equal set; it links no others.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("body"))
    size = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    every = written(_shared(rows, _from_texts(words), share, percent, least_blocks=-(-size // (_CHARS_A_HASH * _BLOCK_HASHES))))
    # Documents with equal sets are one from here on, known by a number (again called print); the first holds its text.
    heads = every.filter("open").groupBy("print", "check").agg(F.min("id").alias("id")).filter("id is not null")
    heads = written(heads.withColumn("number", F.monotonically_increasing_id()))
    n = heads.count()
    linked = None
    if n:
        once = every.groupBy("id").count().filter("count > 1").isEmpty()
        sets = written(_sets_of(rows, heads, n, words, percent, once))
        left = written(_shared(sets.select("print", "hashes", F.lit(None).cast("long").alias("class")), _from_sets, None, percent).filter("open").select("print"))
        m = left.count()
        if m:
            sets = _named(sets, left, m, 24, "left_semi")
            at = lambda k: F.when(F.col("prefix") > k, F.substring("hashes", 8 * k + 1, 8)).alias(f"key{k}")
            names = written(sets.select("print", F.col("print").alias("class"), *[at(k) for k in range(rounds)]))
            for k in range(rounds):
                names = _round(sets, names, f"key{k}", chunk, percent)
            names = _rest(sets, names, chunk, percent)
            of = lambda a, b, c: heads.select(F.col("print").alias(a), F.col("check").alias(b), F.col("number").alias(c))
            linked = names.filter(F.col("print") != F.col("class")).select(F.col("print").alias("_own"), F.col("class").alias("_first"))
            linked = written(linked.join(of("print", "check", "_own"), "_own").join(of("_print", "_check", "_first"), "_first").select("print", "check", "_print", "_check"))
    known = F.col("n") > 0
    out = every.select("id", "n", F.when(known, F.col("print")).alias("print"), F.when(known, F.col("check")).alias("check"))
    if linked is not None:
        k = linked.count()
        out = out.join(F.broadcast(linked) if fits(k, 64) else linked, ["print", "check"], "left")
        out = out.select("id", "n", F.coalesce("_print", "print").alias("print"), F.coalesce("_check", "check").alias("check"))
    # The least id of every class that has several rows; all other rows are their own component.
    groups = out.filter("print is not null").groupBy("print", "check").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("print", "check", "least")
    groups = written(groups)
    g = groups.count()
    out = out.join(F.broadcast(groups) if fits(g, 64) else groups, ["print", "check"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _sets_of(rows: DataFrame, heads: DataFrame, n: int, words: int, percent: int, once: bool) -> DataFrame:
    """print, n, prefix, hashes of the sets that ``heads`` names. ``once``: no id is repeated."""

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for b in in_parts(batches):
            out = []
            for number, *wanted, text in zip(*(b.column(c).to_pylist() for c in ("number", "print", "check", "body"))):
                h = shingles(text, words)
                if _print(h) == tuple(wanted):  # rows that repeat an id may hold another text
                    out.append((number, len(h), len(h) - _up(len(h), percent) + 1, h.astype(np.uint64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["print", "n", "prefix", "hashes"])

    texts = rows.join(F.broadcast(heads) if fits(n, 48) else heads, "id")
    found = texts.select("number", "print", "check", "body").mapInArrow(read, "print long, n long, prefix int, hashes binary")
    return found if once else found.dropDuplicates(["print"])


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one, that with its least id, with all their columns.

    Of rows that repeat that id and share its component one stays; rows without shingles and rows with a null id all stay.
    """
    base, at = guarded(docs)
    own = at[id_col]
    found = written(join_shingles(base, own, at[text_col], **options))
    other = written(found.filter("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct())
    k = other.count()
    kept = base.join(F.broadcast(other) if fits(k, 24) else other, base[own] == other["_other"], "left_anti")
    repeated = written(found.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    k = repeated.count()
    if k:
        side = F.broadcast(repeated) if fits(k, 24) else repeated
        tied = kept.join(side, kept[own] == repeated["doc_id"], "left_semi").dropDuplicates([own])
        kept = kept.join(side, kept[own] == repeated["doc_id"], "left_anti").unionByName(tied)
    return kept.toDF(*docs.columns)


def op7_shingle_join(spark, sf_dir: str) -> DataFrame:
    return join_shingles(table(spark, sf_dir, "documents").select("doc_id", "text"))
