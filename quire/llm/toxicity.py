"""Toxicity (9): compression distance between a toxic and an ordinary zstandard dictionary.

Both dictionaries are trained by zstandard on labelled rows. The ordinary one learns windows of ordinary text. Toxic text consists for the most part of
ordinary words, which would crowd a dictionary of it; so what ordinary text explains is left out of its samples before: pieces of words stay whose bytes occur clearly more often
in toxic than in ordinary text (README has figures of plain training).

To score, a text is cut into windows of a word, and each is compressed with the ordinary dictionary and with the toxic one behind it; the bytes that the latter saves, beyond
one, are added up: over the whole text, divided by its windows, and over its worst stretch of windows, so that a passage counts however long the text around it is. A window
is compressed between an opening and a closing that both dictionaries hold: without them zstandard stores short windows as they are, and finds no match in their last eight bytes.
Both sums have a threshold, calibrated on all training rows: each fold is measured by dictionaries of the other folds.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import guarded, in_parts, table, text_batches, whole_text, worker_cache

#: Bytes of a window at most (longer words are cut), and of one that the ordinary dictionary learns.
WINDOW, TRAINING_WINDOW = 48, 32
#: Bytes that a window has to save to count; windows by which short texts are damped.
LEAST_SAVING, DAMPING = 2, 30
#: Windows of a stretch, and ordinary texts around a row for its calibration.
STRETCH, AROUND = 100, 10
#: Bytes of the dictionaries: small ones, as a far match costs more bits; of several sizes of the toxic one the best is taken, by so many toxic texts at most.
ORDINARY_BYTES, CHANCE_BYTES, TOXIC_BYTES, MAX_TRIED = 4096, 1024, (768, 1024, 1536), 400
#: Segments and matches of the toxic one's training.
SEGMENT, SHARED = 16, 8
LEVEL = 6
#: Bytes of a piece's parts that are counted; occurrences, deviations from what ordinary text lets expect, and times that, from which on a part stays.
PART, LEAST_SEEN, LEAST_DEVIATION, LEAST_RATIO = 6, 5, 5.0, 2.5
#: Behind the toxic dictionary: the last bytes of a dictionary are never matched.
_END = b" \x00\x01\x02\x03\x04\x05\x06\x07"
#: Labelled rows used at most, by class: the least by a hash of the id.
MAX_TOXIC, MAX_ORDINARY = 1000, 2000
FOLDS = 4
#: What an ordinary text flagged costs, as missed toxic ones (both as shares of their class).
FALSE_ALARM = 2.0
#: Distinct words whose savings a worker remembers.
_MOST_KNOWN = 400_000


def cut_windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """The bytes in windows of at most ``size``, each ending before a space where there is one."""
    out, i, n = [], 0, len(data)
    while i < n:
        j = data.rfind(b" ", i + 1, i + size) if n - i > size else n
        if j < 0:
            j = i + size
        out.append(data[i:j])
        i = j
    return out


def word_windows(data: bytes) -> list[bytes]:
    """The words of the text, longer ones in windows of WINDOW bytes."""
    words = data.split()
    if any(len(w) > WINDOW for w in words):
        return [w[i : i + WINDOW] for w in words for i in range(0, len(w), WINDOW)]
    return words


def _prepared(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # A-Z only


def _distinct(texts: list[bytes]) -> list[bytes]:
    """Without those that repeat, in good part, earlier ones: copies must not count as evidence."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.split()
        own = {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))}
        if len(own & seen) <= 0.3 * len(own):
            seen |= own
            out.append(t)
    return out


def _compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)


def trained(size: int, samples: list[bytes], segment: int = 16, shared: int = 8) -> bytes:
    """A dictionary trained by zstandard; of too few samples, which it refuses, their distinct ones as they are."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=shared).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _seen(texts: list[bytes]) -> Counter:
    """In how many texts each word occurs, a space before and behind it."""
    out: Counter = Counter()
    for t in texts:
        out.update(set(t.split()))
    return Counter({b" " + w[:WINDOW] + b" ": n for w, n in out.items()})


def _parts(word: bytes):
    return (word[i : i + PART] for i in range(len(word) - PART + 1))


def unexplained(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Parts of words that toxic texts hold clearly more often than ordinary ones let expect."""
    found: Counter = Counter()
    for w, n in _seen(toxic).items():
        for p in _parts(w):
            found[p] += n
    usual = dict.fromkeys(found, 0)
    for w, n in _seen(ordinary).items():
        for p in _parts(w):
            if p in usual:
                usual[p] += n
    share = len(toxic) / max(len(ordinary), 1)
    expected = {p: (n + 1) * share for p, n in usual.items()}
    return {p for p, n in found.items() if n >= LEAST_SEEN and n > LEAST_RATIO * expected[p] and n - expected[p] > LEAST_DEVIATION * expected[p] ** 0.5}


def left_of(text: bytes, parts: set[bytes]) -> bytes:
    """The pieces of a text's words that these parts cover, one after the other."""
    out = []
    for word in text.split():
        w = b" " + word[:WINDOW] + b" "
        begun, end = -1, 0
        for i, p in enumerate(_parts(w)):
            if p in parts:
                if begun < 0 or i > end:
                    if begun >= 0:
                        out.append(w[begun:end])
                    begun = i
                end = i + PART
        if begun >= 0:
            out.append(w[begun:end])
    return b"".join(out)


def mistaken(ordinary: bytes, toxic: bytes, texts: list[bytes], parts: set[bytes]) -> bytes:
    """A dictionary of ordinary words that the toxic one compresses better by chance: words with nothing that sets toxic text apart."""
    gains, out = _Gains(ordinary, toxic), []
    for t in texts:
        words = word_windows(t)
        some = [w for w, n in zip(words, gains.of(words).tolist()) if n and not any(p in parts for p in _parts(b" " + w + b" "))]
        if some:
            out.append(b" " + b" ".join(some) + b" ")
    return trained(CHANCE_BYTES, out, SEGMENT, SHARED) if out else b""


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes] | None:
    """The ordinary and the toxic dictionary, or None if nothing marks toxic text.

    Of several sizes of the toxic one, with and without a second part of the ordinary one that learns words mistaken for toxic ones, that pair which tells these texts apart best.
    """
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    general = trained(ORDINARY_BYTES, [w for t in ordinary for w in cut_windows(t, TRAINING_WINDOW)], shared=6)
    parts = unexplained(toxic, ordinary)
    left = [s for s in (left_of(t, parts) for t in toxic) if s]
    if not left or not general:
        return None
    best = None
    for size in TOXIC_BYTES:
        marked = trained(size, left, SEGMENT, SHARED) + _END
        for plain in dict.fromkeys([general, general + mistaken(general, marked, ordinary, parts)]):
            told = _told_apart(plain, marked, toxic[:MAX_TRIED], ordinary[: 2 * MAX_TRIED])
            if best is None or told > best[0]:
                best = told, plain, marked
    return best[1:]


def _told_apart(ordinary: bytes, toxic: bytes, bad: list[bytes], good: list[bytes]) -> float:
    """The largest share of bad texts found, less what good ones flagged cost, by the mean saving."""
    import numpy as np

    of = Model(ordinary, toxic).measure()
    x, y = np.array([of(t)[0] for t in bad + good]), np.arange(len(bad) + len(good)) < len(bad)
    cut = _cut(x, y)
    return float((x[y] > cut).mean() - FALSE_ALARM * (x[~y] > cut).mean()) if len(good) else 1.0


class _Gains:
    """By how many bytes, beyond LEAST_SAVING - 1, the toxic dictionary compresses words shorter; what has been compressed is remembered for a while."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.marked = _compressor(ordinary), _compressor(ordinary + toxic)
        half = len(ordinary) // 2
        self.opening, self.closing = ordinary[half : half + 32] + b" ", b" " + ordinary[half // 2 : half // 2 + 16]
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]):
        import numpy as np

        if len(self.known) > _MOST_KNOWN:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            framed = [self.opening + w + self.closing for w in new]
            sizes = [np.fromiter(map(len, c.multi_compress_to_buffer(framed)), np.int64, len(new)) for c in (self.plain, self.marked)]
            self.known.update(zip(new, np.maximum(sizes[0] - sizes[1] - LEAST_SAVING + 1, 0).tolist()))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


@dataclass(frozen=True)
class Model:
    """The dictionaries and the calibration; without both classes among the training rows nothing is toxic."""

    ordinary: bytes
    toxic: bytes
    threshold: float = 1.0
    stretch: float = 1.0

    def measure(self):
        """A function from a text to its saving per window, of the whole and of the worst stretch."""
        import numpy as np

        gains = _Gains(self.ordinary, self.toxic)

        def of(text: str | bytes) -> tuple[float, float]:
            windows = word_windows(text if isinstance(text, bytes) else _prepared(text))
            saved, worst, before = 0, 0, np.zeros(0, np.int64)
            for a in range(0, len(windows), 65536):
                gain = gains.of(windows[a : a + 65536])
                saved += int(gain.sum())
                sums = np.concatenate([[0], np.cumsum(np.concatenate([before, gain]))])  # with the end of the part before
                worst = max(worst, int((sums[STRETCH:] - sums[:-STRETCH]).max() if len(sums) > STRETCH else sums[-1]))
                before = np.concatenate([before, gain])[1 - STRETCH :]
            return saved / (len(windows) + DAMPING), worst / (STRETCH + DAMPING)

        return of

    def level(self, measured: tuple[float, float]) -> float:
        """The larger of the two savings, as a multiple of its threshold."""
        return max(measured[0] / max(self.threshold, 1e-6), measured[1] / max(self.stretch, 1e-6))


def _cut(x, y) -> float:
    """The threshold of ``x`` at which the share of ``y`` found less FALSE_ALARM times that of false alarms is largest; of equally good ones the middle one."""
    import numpy as np

    levels = np.unique(x)
    cuts = (levels[1:] + levels[:-1]) / 2 if len(levels) > 1 else levels + 1e-9
    found, false = (len(v) - np.searchsorted(np.sort(v), cuts) for v in (x[y], x[~y]))
    gain = found / len(x[y]) - FALSE_ALARM * false / len(x[~y])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def calibrated(ordinary: bytes, toxic: bytes, measured: list[tuple[float, float, int]]) -> Model | None:
    """The model with thresholds from (mean, stretch, toxic) of rows that its dictionaries, or others like them, weren't trained on."""
    import numpy as np

    y = np.array([v for _, _, v in measured], bool)
    if not y.any() or y.all():
        return None
    plain = [worst for _, worst, v in measured if not v]
    amid = [max([worst, *(plain[(i * 7 + k) % len(plain)] for k in range(AROUND))]) for i, (_, worst, _) in enumerate(measured)]
    model = Model(ordinary, toxic, _cut(np.array([mean for mean, _, _ in measured]), y), _cut(np.array(amid), y))
    both = _cut(np.array([model.level((mean, worst)) for mean, worst, _ in measured]), y)  # the two thresholds together find, and err, more often
    return Model(ordinary, toxic, model.threshold * both, model.stretch * both)


def learn(rows: list[tuple[str, int, int]], fold: int) -> tuple[bytes, bytes, list[tuple[float, float, int]]] | None:
    """From (text, toxic, fold of 1 to FOLDS): the dictionaries of all rows but ``fold``'s, and what they measure of ``fold``'s."""
    texts = [(_prepared(t), y) for t, y, f in rows if f != fold]
    toxic, ordinary = [t for t, y in texts if y], [t for t, y in texts if not y]
    made = dictionaries(toxic, ordinary) if toxic and ordinary else None
    if made is None:
        return None
    of = Model(*made).measure()
    return *made, [(*of(t), y) for t, y, f in rows if f == fold]


def fold_of(id_col: str) -> Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5).cast("int")


_LEARNT = "fold int, ordinary binary, toxic binary, mean array<double>, stretch array<double>, label array<int>"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Learns from labelled rows whose crc32(id as text) mod 5 isn't 0, at most MAX_TOXIC and MAX_ORDINARY of them.

    An id that repeats counts once, with its least text (a null one counts as empty) and as toxic if any of its labels is. Null ids and labels other than 0 and 1 take no part.
    One task trains the dictionaries of all rows and FOLDS tasks those without one fold, whose rows they measure.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(id_col) != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("_label"))
    by_hash = F.xxhash64("_id")
    chosen = known.filter("_label = 1").orderBy(by_hash, "_id").limit(MAX_TOXIC).unionByName(known.filter("_label = 0").orderBy(by_hash, "_id").limit(MAX_ORDINARY))
    # at most MAX_TOXIC + MAX_ORDINARY ids
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_body")).join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_body").alias("_body"))
    rows = rows.withColumn("_fold", fold_of("_id")).withColumn("_model", F.explode(F.array(*[F.lit(i) for i in range(FOLDS + 1)])))

    def one(key, part):
        import pandas as pd

        part = part.sort_values("_id")
        made = learn(list(zip(part["_body"], part["_label"].astype(int), part["_fold"].astype(int))), int(key[0]))
        if made is None:
            return pd.DataFrame(columns=["fold", "ordinary", "toxic", "mean", "stretch", "label"])
        ordinary, toxic, measured = made
        mean, stretch, label = ([m[i] for m in measured] for i in range(3))
        return pd.DataFrame([{"fold": int(key[0]), "ordinary": ordinary, "toxic": toxic, "mean": mean, "stretch": stretch, "label": label}])

    made = sorted(rows.groupBy("_model").applyInPandas(one, _LEARNT).collect(), key=lambda r: r.fold)  # FOLDS + 1 rows, with three numbers for each training row
    if not made or made[0].fold != 0:
        return None
    return calibrated(bytes(made[0].ordinary), bytes(made[0].toxic), [m for r in made[1:] for m in zip(r.mean, r.stretch, r.label)])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (only the id, if not given), score (0 to 1, 0.5 at the threshold) and predicted of each row.

    A null text is empty, an empty one scores like one without savings; a long text is measured whole; rows with equal ids or texts are scored each by itself, equal
    texts alike. An empty table gives an empty one. ``keep`` mustn't name ``score`` or ``predicted``; ``drop_toxic`` takes tables with such columns.
    """

    def run(batches):
        import math

        import pyarrow as pa

        worker_cache("toxicity", dict)  # in place of what earlier operators kept
        of = model.measure() if model else None
        for b in in_parts(batches):
            texts = b.column("_body").to_pylist()
            x = [1 / (1 + math.exp(-min(700.0, 4.0 * (model.level(of(t)) - 1)))) for t in texts] if of else [0.0] * len(texts)
            cols = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(x, pa.float64()), pa.array([int(v >= 0.5) for v in x], pa.int32())], schema=None, names=[*b.schema.names[:-1], "score", "predicted"])

    text_batches(docs.sparkSession)
    kept = docs.select(*(keep or [id_col]), whole_text(text_col).alias("_body"))
    fields = [f for f in kept.schema.fields if f.name != "_body"]
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that aren't predicted toxic, with the columns of ``docs``, whatever their names; nulls, repeats and empty tables as in ``score``."""
    renamed, at = guarded(docs)
    model = train(docs.select(id_col, text_col), labels, id_col, text_col)
    scored = score(renamed, model, at[id_col], at[text_col], renamed.columns)
    return scored.filter("predicted = 0").drop("score", "predicted").toDF(*docs.columns)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (F.coalesce(fold_of("doc_id"), F.lit(1)) == 0).alias("held_out"), "score", "predicted")
