"""Vector operations: nearest neighbours, votes of neighbours, fusion of probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import argmax, unit


def concatenated(df: DataFrame, vectors: list[str], out: str = "features") -> DataFrame:
    """Each vector at unit length, one after the other."""
    return df.withColumn(out, F.concat(*[unit(F.col(v)) for v in vectors]))


def nearest(queries: DataFrame, train: DataFrame, k: int, id_col: str = "id", vector: str = "v", carry: tuple[str, ...] = (), skip_self: bool = True,
            blocks: int | None = None) -> DataFrame:
    """query, neighbour, similarity, rank: the k rows of ``train`` with the largest cosine, ties to the least id. A zero vector is similar to nothing (0).

    Every query meets every row, in blocks of rows by hash: a matrix product of a block with the queries keeps k of each, so only k rows a query and block are shuffled.
    Queries go to all blocks; they are a stated set, smaller than the rows they are held against. A product finds what is near the k-th, whose cosines are then computed one by
    one, so that equal vectors are equally similar wherever they lie.
    """
    from pyspark.sql import types as T

    n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or max(n, -(-train.count() // 16_384))
    double = F.transform(vector, lambda x: x.cast("double"))
    t = train.select(F.col(id_col).alias("neighbour"), double.alias("_t"), *carry, F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("_block"))
    parts = -(-queries.count() // 16_384)
    q = queries.select(F.col(id_col).alias("query"), double.alias("_q"), F.pmod(F.xxhash64(id_col, F.lit("q")), F.lit(max(1, parts))).alias("_part"))
    q = q.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    t = t.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, parts) - 1).cast("long"))))
    names = ["query", "neighbour", "similarity", *carry]

    def rank(rows, asked):
        import numpy as np
        import pandas as pd

        if not len(rows) or not len(asked):
            return pd.DataFrame(columns=names)
        rows = rows.sort_values("neighbour", kind="stable").reset_index(drop=True)
        unit = lambda vs: (m := np.stack([np.asarray(v, float) for v in vs])) / np.where((z := np.sqrt((m**2).sum(1))) > 0, z, 1.0)[:, None]
        x, y, ids = unit(rows["_t"]), unit(asked["_q"]), rows["neighbour"].to_numpy()
        out = []
        for a in range(0, len(y), 256):
            s = y[a : a + 256] @ x.T
            for j, line in enumerate(s):
                name = asked["query"].iloc[a + j]
                if skip_self:
                    line[ids == name] = -np.inf
                m = min(k, len(line))
                near = np.flatnonzero((line >= np.partition(line, len(line) - m)[len(line) - m] - 1e-9) & (line > -np.inf))
                exact = (x[near] * y[a + j]).sum(1)
                out += [(name, near[i], exact[i]) for i in np.argsort(-exact, kind="stable")[:k]]
        found = pd.DataFrame(out, columns=["query", "_at", "similarity"])
        picked = rows.iloc[found["_at"].to_numpy(int)].reset_index(drop=True)
        return pd.concat([found[["query"]], picked[["neighbour"]], found[["similarity"]], picked[list(carry)]], axis=1)

    field = {f.name: f.dataType for f in t.schema.fields}
    schema = T.StructType([T.StructField("query", q.schema["query"].dataType), T.StructField("neighbour", field["neighbour"]), T.StructField("similarity", T.DoubleType()), *[T.StructField(c, field[c]) for c in carry]])
    some = t.groupBy("_block", "_part").cogroup(q.groupBy("_block", "_part")).applyInPandas(rank, schema)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "neighbour", "similarity", "rank", *carry)


def neighbour_votes(neighbours: DataFrame, label: str, k: int) -> DataFrame:
    """query, predicted, share: the commonest label of the k nearest, the least of several; share is its probability."""
    per = neighbours.filter(F.col("rank") <= k).groupBy("query", label).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("query").agg(F.max_by(label, F.struct("n", -F.col(label))).alias("predicted"), F.max("n").alias("n"), F.sum("n").alias("k"))
    return out.select("query", "predicted", (F.col("n") / F.col("k")).alias("share"))


def best_k(neighbours: DataFrame, truth: DataFrame, label: str, grid: list[int]) -> DataFrame:
    """k, macro_f1, best: each k of the grid scored on ``truth`` (query, true); best is the first with the largest macro F1."""
    from quire.operators import metrics

    g = neighbours.sparkSession.createDataFrame([(k,) for k in grid], "k int")
    per = neighbours.join(F.broadcast(g), F.col("rank") <= F.col("k")).groupBy("k", "query", label).agg(F.count(F.lit(1)).alias("n"))  # the grid is a few values
    voted = per.groupBy("k", "query").agg(F.max_by(label, F.struct("n", -F.col(label))).alias("predicted"))
    scored = metrics.summary(metrics.per_class(metrics.confusion(voted.join(truth, "query"), "true", "predicted", ("k",)), ("k",)), ("k",)).select("k", "macro_f1")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("macro_f1", 12)), "k")  # a row for each k
    return scored.withColumn("best", F.row_number().over(w) == 1)


def late_fusion(left: DataFrame, right: DataFrame, keys: list[str], probs: str = "probs") -> DataFrame:
    """keys, probs, predicted, probability: the mean of two models' probabilities of the same keys. Keys that one side lacks are an error, raised as they are met."""
    a, b = left.select(*keys, F.col(probs).alias("_a")), right.select(*keys, F.col(probs).alias("_b"))
    met = a.join(b, keys, "full_outer")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.size("_a") == F.size("_b"))
    mean = F.when(F.assert_true(ok, F.lit("the models don't have the same keys and classes")).isNull(), F.zip_with("_a", "_b", lambda x, y: (x + y) / 2))
    out = met.select(*keys, mean.alias("probs"))
    return out.withColumns({"predicted": argmax(F.col("probs")), "probability": F.array_max("probs")})


def strict_join(rows: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the features of their keys; a key without features is an error, raised as it is met."""
    f = features.withColumn("_has", F.lit(True))
    out = rows.join(f, keys, "left")
    checked = F.assert_true(F.col("_has").isNotNull(), F.concat(F.lit("no features for "), F.concat_ws("/", *keys)))
    return out.withColumn("_has", F.coalesce(checked.cast("boolean"), F.lit(True))).filter("_has").drop("_has")


def linear_probe(train: DataFrame, test: DataFrame, vector: str, label: str, weight: str | None = None, iterations: int = 50) -> DataFrame:
    """``test`` with predicted and probs, by a logistic regression on ``train`` (label: 0, 1, ...)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    to = lambda df: df.withColumn("_x", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    lr = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=iterations, regParam=1e-3, **({"weightCol": weight} if weight else {}))
    out = lr.fit(to(train)).transform(to(test))
    return out.withColumns({"predicted": F.col("prediction").cast("int"), "probs": vector_to_array("probability")}).drop("_x", "rawPrediction", "probability", "prediction")


def pooled_scores(probabilities: DataFrame, by: list[str], probs: str = "probs") -> DataFrame:
    """The mean probability vector of each group: several passes over one page count as one."""
    per = probabilities.select(*by, F.posexplode(probs).alias("i", "p")).groupBy(*by, "i").agg(F.avg("p").alias("p"))
    return per.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias(probs))
