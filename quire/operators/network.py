"""A fused network on two feature vectors, trained data-parallel, that keeps the epoch with the best validation score.

Rows are dealt into shards by a hash of their key, in a hashed order, whatever partitions they came in. An epoch starts every shard from the same weights; each takes Adam
steps over its own minibatches, and the weights (and moments) are averaged by rows. So an epoch is one pass, what travels is the weights, and the same seed
gives the same network on any cluster. The driver holds weights alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import metrics
from quire.operators.graph import saved


@dataclass(frozen=True)
class Settings:
    """``hidden`` units; epochs, Adam's rate and decay of weights, halved (``factor``) every ``step`` epochs; rows of a minibatch; shards at least, and rows of a shard at most or so (more rows make more shards)."""

    hidden: int = 64
    epochs: int = 20
    rate: float = 1e-3
    decay: float = 1e-5
    step: int = 5
    factor: float = 0.5
    batch: int = 32
    shards: int = 8
    shard_rows: int = 50_000
    clip: float = 1.0
    seed: int = 42


@dataclass
class Network:
    """Two layers: ReLU, then softmax over ``classes``. ``history``: epoch, loss, score of each epoch; ``epoch`` is the one kept."""

    weights: list[np.ndarray]
    classes: int
    epoch: int = 0
    history: list[tuple[int, float, float]] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(x @ self.weights[0] + self.weights[1], 0) @ self.weights[2] + self.weights[3])

    def scored(self, df: DataFrame, vectors: list[str]) -> DataFrame:
        """``df`` with probs, predicted (the first of the likeliest) and probability; null where a vector is."""
        from quire.functions.scalars import argmax

        weights, classes = self.weights, self.classes

        def run(batches):
            import pandas as pd

            net = Network(weights, classes)
            for b in batches:
                yield pd.DataFrame({"_probs": [p.tolist() for p in net.probabilities(_fused(b, vectors))] if len(b) else []} | {c: b[c] for c in b.columns if c not in vectors})[[*[c for c in b.columns if c not in vectors], "_probs"]]

        kept = [c for c in df.columns if c not in vectors]
        kinds = dict(df.dtypes)
        some = df.dropna(subset=vectors).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "_probs array<double>"]))
        out = some.withColumnRenamed("_probs", "probs")
        return out.withColumns({"predicted": argmax(F.col("probs")), "probability": F.array_max("probs")})

    def epochs(self, spark) -> DataFrame:
        """epoch, loss, score: a row for each epoch."""
        return spark.createDataFrame(self.history, "epoch int, loss double, score double")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fused(rows, vectors: list[str]) -> np.ndarray:
    """The vectors side by side, each of length 1."""
    parts = []
    for v in vectors:
        x = np.stack(rows[v].to_numpy()).astype(float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        parts.append(x / np.where(norm > 0, norm, 1.0))
    return np.hstack(parts)


def _gradient(w: list[np.ndarray], x: np.ndarray, y: np.ndarray, class_weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted cross entropy, averaged by weight, and its derivatives."""
    hidden = np.maximum(x @ w[0] + w[1], 0)
    p = _softmax(hidden @ w[2] + w[3])
    own = class_weight[y]
    total = own.sum()
    loss = float(-(own * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum() / total)
    d = p
    d[np.arange(len(y)), y] -= 1
    d *= (own / total)[:, None]
    back = (d @ w[2].T) * (hidden > 0)
    return loss, [x.T @ back, back.sum(0), hidden.T @ d, d.sum(0)]


def _trained(w, m, v, steps: int, x, y, class_weight, s: Settings, rate: float):
    """Adam over the rows in minibatches, in their order."""
    w, m, v = ([a.copy() for a in z] for z in (w, m, v))
    losses = []
    for a in range(0, len(y), s.batch):
        loss, grad = _gradient(w, x[a : a + s.batch], y[a : a + s.batch], class_weight)
        losses.append(loss * len(y[a : a + s.batch]))
        grad = [g + s.decay * b for g, b in zip(grad, w)]
        norm = float(np.sqrt(sum((g * g).sum() for g in grad)))
        if norm > s.clip:
            grad = [g * (s.clip / norm) for g in grad]
        steps += 1
        for i, g in enumerate(grad):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] -= rate * (m[i] / (1 - 0.9**steps)) / (np.sqrt(v[i] / (1 - 0.999**steps)) + 1e-8)
    return w, m, v, sum(losses)


def _packed(arrays: list[np.ndarray]) -> bytes:
    return np.concatenate([a.ravel() for a in arrays]).tobytes()


def _unpacked(data: bytes, like: list[np.ndarray]) -> list[np.ndarray]:
    x, out, at = np.frombuffer(data, float), [], 0
    for a in like:
        out.append(x[at : at + a.size].reshape(a.shape).copy())
        at += a.size
    return out


def _shard_epoch(state, done: int, rate: float, class_weight, s: Settings, vectors: list[str], keys: int):
    """An epoch over a shard's rows, for a pandas group."""

    def run(part):
        import pandas as pd

        part = part.sort_values(["_order", *[f"_k{i}" for i in range(keys)]], kind="stable")
        w, m, v, loss = _trained(*state.value, done, _fused(part, vectors), part["_y"].to_numpy(), class_weight, s, rate)
        return pd.DataFrame([{"shard": int(part["_shard"].iloc[0]), "n": len(part), "most": len(part), "w": _packed(w), "m": _packed(m), "v": _packed(v), "loss": loss}])

    return run


def _averaged(like: list[np.ndarray]):
    """Some shards' weights as one, by their rows, for a pandas group."""
    like = [np.zeros_like(a) for a in like]

    def run(part):
        import pandas as pd

        part = part.sort_values("shard")
        n = part["n"].sum()
        mean = {k: _packed([sum(c / n * a for c, a in zip(part["n"], arrays)) for arrays in zip(*[_unpacked(x, like) for x in part[k]])]) for k in "wmv"}
        return pd.DataFrame([{"shard": int(part["shard"].iloc[0]), "n": int(n), "most": int(part["most"].max()), **mean, "loss": part["loss"].sum()}])

    return run


def fit(train: DataFrame, valid: DataFrame, vectors: list[str], label: str, classes: int, key: list[str], settings: Settings = Settings(), start: Network | None = None) -> Network:
    """The network of the epoch with the best score on ``valid``, the last of equal ones: macro F1, or for two classes the positive class's.

    Class weights are the inverse of frequencies in ``train`` (a sum of ``classes``; a class without rows weighs as if it had one). ``start`` is a network to go on from. Rows with a null vector
    or label take no part; without rows to learn from it is an error. Dimensions come from the first row.
    """
    s = settings
    shards = max(s.shards, -(-train.count() // s.shard_rows))
    shard = F.pmod(F.xxhash64(F.lit(s.seed), *key), F.lit(shards)).cast("int")
    rows = saved(train.dropna(subset=[*vectors, label]).select(*vectors, F.col(label).cast("int").alias("_y"), shard.alias("_shard"), F.xxhash64(F.lit(s.seed + 1), *key).alias("_order"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]))
    first = rows.first()
    if first is None:
        raise ValueError("no rows to learn from")
    sizes = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
    inverse = np.array([1.0 / max(sizes.get(k, 0), 1) for k in range(classes)])
    class_weight = inverse * classes / inverse.sum()
    dims = sum(len(first[v]) for v in vectors)
    rng = np.random.default_rng(s.seed)
    w = [a.copy() for a in start.weights] if start else [rng.standard_normal((dims, s.hidden)) * np.sqrt(2 / dims), np.zeros(s.hidden), rng.standard_normal((s.hidden, classes)) * np.sqrt(1 / s.hidden), np.zeros(classes)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    steps, best, history = 0, None, []
    checked = saved(valid.dropna(subset=[*vectors, label]).select(*vectors, F.col(label).cast("int").alias("_y")))
    for epoch in range(1, s.epochs + 1):
        rate = s.rate * s.factor ** ((epoch - 1) // s.step)
        state = rows.sparkSession.sparkContext.broadcast((w, m, v))  # weights, however many rows
        shard_epoch, averaged = _shard_epoch(state, steps, rate, class_weight, s, vectors, len(key)), _averaged(w)
        schema = "shard int, n long, most long, w binary, m binary, v binary, loss double"
        each = rows.groupBy("_shard").applyInPandas(shard_epoch, schema)
        got = sorted(each.groupBy(F.col("shard") % 16).applyInPandas(averaged, schema).collect(), key=lambda r: r["shard"])  # 16 rows at most
        n = sum(r["n"] for r in got)
        w, m, v = ([sum(r["n"] / n * a for r, a in zip(got, arrays)) for arrays in zip(*[_unpacked(r[name], w) for r in got])] for name in "wmv")
        steps += -(-max(r["most"] for r in got) // s.batch)
        state.unpersist()
        net = Network(w, classes, epoch)
        score = validation_score(net.scored(checked, vectors), "_y", classes)
        history.append((epoch, sum(r["loss"] for r in got) / n, score))
        if best is None or score >= best[0]:
            best = (score, net)
    best[1].history = history
    return best[1]


def validation_score(scored: DataFrame, label: str, classes: int) -> float:
    """F1 of class 1 of two, else macro F1 over the classes that occur; 0 without rows."""
    if classes == 2:
        r = metrics.binary(scored, F.col(label) == 1, F.col("predicted") == 1).first()
        return float(r["f1"] or 0.0)
    r = metrics.summary(metrics.per_class(metrics.confusion(scored, label, "predicted"))).first()
    return float(r["macro_f1"] or 0.0) if r is not None else 0.0
