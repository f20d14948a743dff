"""Phrase collocations (13): vertical positional inverted lists, extended word by word.

Texts are indexed in slices. A slice holds, for each word of each language, the ascending list of its positions; a gap in the numbering parts
pieces and texts. Level by level, frequent phrases grow by a word:

1. *Extend.* The positions of each frequent phrase of k words are merge-joined with the postings of adjacent words: a phrase at p with the word
   at p + k, where the phrase that starts at p + 1 is frequent too. The new lists' lengths are exact counts within the slice.
2. *Count.* Each phrase's length goes, once a slice, to the block of its hash range (96 bits of hash), where they add up to its frequency.
3. *Prune.* The block answers with a bit for each phrase, and with the frequency to one slice that spells it out; slices drop all other lists.

No level sends positions or texts about, so a word that is everywhere is one count a slice. Frequent phrases form a table, and
cuts, scores, covering phrases and ranks are joins and groups over it.
"""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.byte_words import Scanner, buffers, from_planes, in_slices, mixed, planes
from quire.llm.common import partitions, table, text_batches, trim, whole_text, worker_cache, written

LONGEST, LEAST, COVERED, BEST = 4, 30, 80, 2000
#: Bytes of text of a slice; counts in a block, about.
SLICE_BYTES, BLOCK_COUNTS = 8 << 20, 4 << 20
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_SALTS = 64


def _scanner() -> Scanner:
    return Scanner(bytes(set(range(256)) - set(_BREAKS + _SPACES)), _LOWER)


class Lists:
    """Inverted lists: ``positions[at[i] : at[i + 1]]``, ascending, are those of the i-th word or phrase."""

    def __init__(self, at: np.ndarray, positions: np.ndarray):
        self.at, self.positions = at, positions

    def __len__(self) -> int:
        return len(self.at) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.at)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.lengths())

    def only(self, kept: np.ndarray) -> Lists:
        """The lists for which ``kept`` is true."""
        return Lists(np.append(0, np.cumsum(self.lengths()[kept])), self.positions[np.repeat(kept, self.lengths())])

    def to_arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and steps from position to position."""
        steps = np.diff(self.positions, prepend=0)
        first = self.at[:-1][self.lengths() > 0]
        steps[first] = self.positions[first]
        return self.lengths().astype(np.uint32), steps.astype(np.uint32)

    @classmethod
    def from_arrays(cls, lengths: np.ndarray, steps: np.ndarray) -> Lists:
        at = np.append(0, np.cumsum(lengths, dtype=np.int64))
        far = np.cumsum(steps, dtype=np.int64)
        return cls(at, far - np.repeat(np.append(0, far)[at[:-1]], lengths))


def grouped(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by (high, low), and where each pair begins in it."""
    order = np.argsort(high, kind="stable")
    h, w = high[order], low[order]
    same = h[1:] == h[:-1]
    if (same & (w[1:] != w[:-1])).any():
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        same = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
    return order, np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)


def _keys_of_words(words: list[bytes], lang: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 and 32 bits of each word with its language."""
    import pyarrow as pa

    scan = worker_cache("phrase words", _scanner)
    w = scan.words(*buffers(pa.array(words, pa.large_binary())))
    return _in_language(w.h1, w.h2, lang, langs)


def _in_language(h1, h2, lang, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64)
    seed = seeds[lang] if len(langs) else np.zeros(0, np.uint64)
    return mixed(h1 + seed), (mixed(h2 ^ seed) >> np.uint64(32)).astype(np.uint32)


class Slice:
    """The index of some texts: words (lower case) with languages, their lists, and those of frequent phrases of ``size`` words (at 1, the words' own)."""

    def __init__(self, langs: list[str], words: list[bytes], lang: np.ndarray, postings: Lists, size: int = 1, phrases: Lists | None = None):
        self.langs, self.words, self.lang, self.postings, self.size = langs, words, lang, postings, size
        self.phrases = postings if phrases is None else phrases

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, langs: list[str], lang_of: np.ndarray) -> Slice:
        """Of texts and the languages (numbers in ``langs``) of them."""
        found = worker_cache("phrase words", _scanner).words(data, offsets)
        position = np.zeros(len(found), np.int64)
        if len(found):
            marks = np.zeros(256, bool)
            marks[np.frombuffer(_BREAKS, np.uint8)] = True
            breaks = np.flatnonzero(marks[data[offsets[0] : offsets[-1]]]) + offsets[0]
            apart = np.append(False, (found.text[1:] != found.text[:-1]) | (np.searchsorted(breaks, found.end[:-1]) != np.searchsorted(breaks, found.first[1:])))
            position = np.arange(len(found)) + np.cumsum(apart)
        lang = lang_of[found.text]
        high, low = _in_language(found.h1, found.h2, lang, langs)
        order, starts = grouped(high, low)
        first = order[starts]
        raw = data[offsets[0] : offsets[-1]].tobytes().translate(_LOWER)
        words = [raw[a:b] for a, b in zip((found.first[first] - offsets[0]).tolist(), (found.end[first] - offsets[0]).tolist())]
        return cls(langs, words, lang[first].astype(np.int32), Lists(np.append(starts, len(order)), position[order]))

    def to_bytes(self) -> bytes:
        import zstandard

        lengths, steps = self.postings.to_arrays()
        n, s = self.phrases.to_arrays() if self.size > 1 else (lengths[:0], steps[:0])
        head = json.dumps([self.langs, self.size]).encode()
        parts = [head, b"\n".join(self.words), planes(self.lang), planes(lengths), planes(steps), planes(n), planes(s)]
        out = io.BytesIO()
        out.write(np.array([len(p) for p in parts], np.int64).tobytes())
        out.writelines(parts)
        return zstandard.ZstdCompressor(level=1).compress(out.getvalue())

    @classmethod
    def from_bytes(cls, data: bytes) -> Slice:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(data)
        ends = np.cumsum(np.append(56, np.frombuffer(raw, np.int64, 7)))
        head, words, lang, lengths, steps, n, s = (raw[a:b] for a, b in zip(ends, ends[1:]))
        langs, size = json.loads(head)
        postings = Lists.from_arrays(from_planes(lengths, np.uint32), from_planes(steps, np.uint32))
        phrases = Lists.from_arrays(from_planes(n, np.uint32), from_planes(s, np.uint32)) if size > 1 else None
        return cls(langs, words.split(b"\n") if words else [], from_planes(lang, np.int32), postings, size, phrases)

    def by_position(self) -> tuple[np.ndarray, np.ndarray]:
        """All positions of words, ascending, and the word of each."""
        order = np.argsort(self.postings.positions, kind="stable")
        return self.postings.positions[order], self.postings.owners()[order]

    def keys(self, positions: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the phrases of ``size`` words at the positions."""
        high, low = _keys_of_words(self.words, self.lang, self.langs)
        at, word = self.by_position()
        h, w = np.zeros(len(positions), np.uint64), np.zeros(len(positions), np.uint32)
        for k in range(size):
            x = word[np.searchsorted(at, positions + k)]
            h, w = mixed(h * np.uint64(0x9FB21C651E98DF25) + high[x]), (w ^ low[x]) * np.uint32(0x9E3779B1) + (w >> np.uint32(15))
        return h, w

    def extended(self) -> tuple[Lists, np.ndarray, np.ndarray]:
        """The lists of phrases one word longer that may be frequent, and the hashes of the phrases, ascending."""
        size = self.size + 1
        start = np.sort(self.phrases.positions)
        at = np.sort(self.postings.positions)

        def among(x, y):  # a merge join of ascending positions
            i = np.searchsorted(y, x)
            return y[np.minimum(i, len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)

        start = start[among(start + 1, start)]
        start = start[among(start + self.size, at)]
        high, low = self.keys(start, size)
        order, first = grouped(high, low)
        return Lists(np.append(first, len(order)), start[order]), high[order[first]], low[order[first]]

    def grown(self, size: int) -> tuple[Lists, np.ndarray, np.ndarray]:
        """The lists of the level ``size``: at 1 the words' own."""
        return (self.phrases, *_keys_of_words(self.words, self.lang, self.langs)) if size == 1 else self.extended()

    def pruned(self, size: int, lists: Lists, kept: np.ndarray) -> Slice:
        """With those of the lists for which ``kept`` is true, as the frequent phrases of ``size`` words, and the postings that still matter."""
        phrases = lists.only(kept)
        if size == 1:
            need = kept
            postings = phrases
        else:
            p = np.sort(phrases.positions)
            around = np.unique(np.concatenate([p + k for k in range(size)])) if len(p) else p
            here = np.isin(self.postings.positions, around, kind="table") if len(p) else np.zeros(len(self.postings.positions), bool)
            lengths = np.bincount(self.postings.owners()[here], minlength=len(self.postings))
            need = lengths > 0
            postings = Lists(np.append(0, np.cumsum(lengths[need])), self.postings.positions[here])
        return Slice(self.langs, [w for w, k in zip(self.words, need.tolist()) if k], self.lang[need], postings, size, phrases if size > 1 else None)

    def spelled(self, positions: np.ndarray, size: int) -> list[tuple[str, str]]:
        """Language and words of the phrases at the positions."""
        at, word = self.by_position()
        which = np.stack([word[np.searchsorted(at, positions + k)] for k in range(size)], axis=1) if len(positions) else np.zeros((0, size), np.int64)
        return [(self.langs[self.lang[r[0]]], b" ".join([self.words[i] for i in r]).decode("utf-8")) for r in which.tolist()]


def _cut_long(data: np.ndarray, offsets: np.ndarray, limit: int):
    """The texts, or the parts of a single longer one: cut at breaks, which no phrase goes over."""
    while offsets[-1] - offsets[0] > limit and len(offsets) == 2:
        marks = np.zeros(256, bool)
        marks[np.frombuffer(_BREAKS, np.uint8)] = True
        a = int(offsets[0]) + limit
        step = 1 << 16
        while a < offsets[-1] and not marks[data[a : min(a + step, int(offsets[-1]))]].any():
            a += step
        if a >= offsets[-1]:
            break
        a += int(np.argmax(marks[data[a : min(a + step, int(offsets[-1]))]]))
        yield data, np.array([offsets[0], a])
        offsets = np.array([a, offsets[1]])
    yield data, offsets


_STATE = "slice long, state binary, langs array<string>, counts array<long>, lang string, phrase string, size int, f long"
_COUNTS = "block int, slice long, first int, high binary, low binary, counts binary"
_ANSWER = "slice long, first int, kept binary, n int, told binary, f binary"


def index(docs: DataFrame, text_col: str, lang_col: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row a slice: its number, its index, and the word occurrences of each language in it."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for b in in_slices(batches, "_body", slice_bytes):
            langs, lang_of = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            for data, offsets in _cut_long(*buffers(b.column(1)), slice_bytes):
                s = Slice.of(data, offsets, langs.tolist(), lang_of)
                counts = np.bincount(s.lang[s.postings.owners()], minlength=len(langs)).tolist()
                yield _rows(_STATE, [(number, s.to_bytes(), s.langs, counts, None, None, None, None)])
                number += 1 << 32
        trim()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), whole_text(text_col).alias("_body"))
    return rows.mapInArrow(run, _STATE)


_ARROW = {"long": "int64", "int": "int32", "binary": "binary", "string": "string", "array<string>": "list<string>", "array<long>": "list<int64>"}


def _rows(schema: str, rows: list[tuple]):
    """An Arrow batch of the rows, by a Spark schema."""
    import pyarrow as pa

    kinds = {"list<string>": pa.list_(pa.string()), "list<int64>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    types = [kinds.get(_ARROW[t]) or getattr(pa, _ARROW[t])() for _, t in fields]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=[n for n, _ in fields])


def _level(states: DataFrame, size: int, least: int, blocks: int) -> DataFrame:
    """From slices with the frequent phrases one word shorter (at 1, with all words): the slices with the frequent ones of ``size`` words, and a row for each of these phrases."""

    def deal(batches):
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lists, high, low = Slice.from_bytes(data).grown(size)
                block = ((high >> np.uint64(32)).astype(np.int64) * blocks) >> 32
                cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist() if len(block) else []
                n = lists.lengths().astype(np.uint32)
                yield _rows(_COUNTS, [(int(block[i]), number, i, high[i:j].tobytes(), low[i:j].tobytes(), planes(n[i:j])) for i, j in zip(cuts, cuts[1:])])
        trim()

    def count(batches):
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(1, 6)))]
        if rows:
            rows.sort(key=lambda r: r[0])
            high = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            low = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
            n = np.concatenate([from_planes(r[4], np.uint32) for r in rows]).astype(np.int64)
            rows = [r[:2] + (len(r[3]) // 4,) for r in rows]
            order, first = grouped(high, low)
            total = np.add.reduceat(n[order], first)
            kept = np.zeros(len(n), bool)
            kept[order] = np.repeat(total >= least, np.diff(np.append(first, len(n))))
            tells = np.zeros(len(n), np.int64)
            tells[order[first]] = np.where(total >= least, total, 0)
            a = 0
            for number, begin, k in rows:
                told = np.flatnonzero(tells[a : a + k])
                if kept[a : a + k].any():
                    yield _rows(_ANSWER, [(number, begin, np.packbits(kept[a : a + k]).tobytes(), k, told.astype(np.uint32).tobytes(), tells[a : a + k][told].tobytes())])
                a += k
        trim()

    def prune(batches):
        """Rows by slice, its own row last."""
        answers = []
        for b in batches:
            for number, data, *answer in zip(*(b.column(k).to_pylist() for k in range(7))):
                if data is None:
                    answers.append(answer)
                    continue
                s = Slice.from_bytes(data)
                lists, _, _ = s.grown(size)
                kept, told, f = np.zeros(len(lists), bool), [], []
                for begin, bits, n, which, total in answers:
                    kept[begin : begin + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                    told.append(np.frombuffer(which, np.uint32).astype(np.int64) + begin)
                    f.append(np.frombuffer(total, np.int64))
                answers = []
                if not kept.any():
                    continue
                told, f = np.concatenate(told), np.concatenate(f)
                out = s.pruned(size, lists, kept)
                yield _rows(_STATE, [(number, out.to_bytes(), None, None, None, None, None, None)])
                spelled = s.spelled(lists.positions[lists.at[told]], size)
                for a in range(0, len(spelled), 10_000):
                    yield _rows(_STATE, [(number, None, None, None, lang, phrase, size, n) for (lang, phrase), n in zip(spelled[a : a + 10_000], f[a : a + 10_000].tolist())])
        trim()

    own = states.filter("state IS NOT NULL").select("slice", "state")
    answers = own.mapInArrow(deal, _COUNTS).repartitionById(blocks, "block").mapInArrow(count, _ANSWER)
    both = own.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _ANSWER.split(", ")[1:]}).unionByName(answers.withColumn("state", F.lit(None).cast("binary")))
    n = partitions(states.sparkSession)
    dealt = both.repartitionById(n, F.pmod("slice", F.lit(n)).cast("int")).sortWithinPartitions("slice", F.col("state").isNotNull())
    return dealt.select("slice", "state", "first", "kept", "n", "told", "f").mapInArrow(prune, _STATE)


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, f of all phrases of 1 to ``longest`` words that occur ``least`` times or more in their language, and lang, n: all word occurrences."""
    spark = docs.sparkSession
    text_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))  # rows are whole slices
    states = written(index(docs, text_col, lang_col, slice_bytes))
    totals = written(states.select(F.explode(F.arrays_zip("langs", "counts")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.counts").alias("n")))
    words = totals.agg(F.sum("n")).first()[0] or 0
    blocks = max(partitions(spark), -(-words // BLOCK_COUNTS))
    levels = []
    for size in range(1, longest + 1):
        states = written(_level(states, size, least, blocks))
        levels.append(states.filter("phrase IS NOT NULL").select("lang", "phrase", "size", "f"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", best: int | None = BEST, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``best`` collocations of each language (all, if None), by score, frequency and phrase.

    A phrase of 2 to ``longest`` words within a piece counts if it occurs ``least`` times or more and no longer such phrase that holds it has at least ``covered`` percent of its occurrences.
    Its score is the lowest of its cuts' floor(2000000 * a / (l + r)). A null text is empty, a null language ``und``; an empty text counts nothing; texts are read
    whole, long ones in parts that end with a piece; equal rows count each. An empty table gives an empty one. Other columns take no part, whatever their names.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, longest, least, slice_bytes)
    found = written(found)
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    candidates = found.filter("size > 1")
    cuts = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    one = lambda as_, n: found.select("lang", F.col("phrase").alias(as_), F.col("f").alias(n))
    cuts = cuts.join(one("left", "l"), ["lang", "left"]).join(one("right", "r"), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(20, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = found.filter("size > 2").select("lang", "f", words.alias("w"), "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    inner = inner.select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("start"))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("start"), F.col("n")), " ").alias("phrase")).agg(F.max("f").alias("over"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(f"over IS NULL OR CAST(over AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {covered}")
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if best is not None:  # first among parts of a language, so that no task has all of its phrases
        salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
        kept = salted.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*by))).filter(F.col("_n") <= best).drop("_n", "_salt")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long"))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
pieces AS (SELECT d, lang, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT d, lang, regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]') AS p FROM lowered)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + k - 1] AS p, k FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
found AS (SELECT lang, array_to_string(p, ' ') AS phrase, any_value(p) AS p, k, count(*) AS f FROM grams GROUP BY lang, array_to_string(p, ' '), k HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, f AS a, k, p, unnest(range(1, k)) AS cut FROM found WHERE k >= 2),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:c.cut], ' ') JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[c.cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT lang, f, p, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM found WHERE k > 2)),
over AS (SELECT lang, array_to_string(p[i:i + n - 1], ' ') AS phrase, max(f) AS f FROM parts GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN over o ON s.lang = o.lang AND s.phrase = o.phrase WHERE o.f IS NULL OR 100 * o.f < 80 * s.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
