"""A cache of embeddings by content: what has been embedded once, in each pass, isn't again, whichever row or corpus it comes from.

The key is a hash of the model's name, the pass and the content. The cache is a folder of parquet in buckets of keys; each build adds a generation with what was missing, as one atomic write.
"""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.operators.graph import saved
from quire.sources.tables import embed

BUCKETS = 64
#: From this share of empty contents on a build warns: the paths or the extractor are likely wrong.
EMPTY_SHARE = 0.5

_SCHEMA = "key string, pass int, v array<double>, bucket int, generation string"


def content_key(model: str, passes: Column, columns: list[str]) -> Column:
    """A hash of model, pass and contents; a null content is an empty one."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", F.lit(model), passes.cast("string"), *parts), 256)


def _held(spark: SparkSession, folder: str) -> DataFrame:
    """key, pass, v, the last generation's; empty where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(folder).groupBy("key", "pass").agg(F.max_by("v", "generation").alias("v"))  # the last of those embedded again


def build(pages: DataFrame, folder: str, model: str, make_embedder: Callable, columns: list[str], dims: int, keys: list[str], passes: int = 1, force: bool = False) -> tuple[DataFrame, dict]:
    """(keys, pass, v of every row and pass; figures of the build: rows, empty, distinct contents, embedded).

    ``make_embedder()`` is made once a task and embeds a pandas frame with ``columns`` and pass, in which an augmentation sees which pass it is. Each distinct content is embedded once a pass; with
    ``force`` what the cache holds is embedded again and replaced. ``pages`` is read twice, so it has to give the same rows; its contents are shuffled once, whatever the number of passes, and aren't written: rows go by keys alone. Contents that are blank are counted, and a warning says when half or more of them are: their vectors would all be alike.
    """
    spark = pages.sparkSession
    seen = Observation()
    blank = F.trim(F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])) == ""
    own = F.array(*[content_key(model, F.lit(k), columns) for k in range(passes)])
    keyed = pages.select(*keys, *[c for c in columns if c not in keys], own.alias("_keys"))
    rows = saved(keyed.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("empty")).select(*keys, "_keys"))
    known = _held(spark, folder)
    distinct = rows.select("_keys").distinct().select(F.col("_keys")[0].alias("_content"), F.posexplode("_keys").alias("pass", "key"))
    lacking = distinct if force else distinct.join(known.select("key"), "key", "left_anti")
    lacking = lacking.groupBy("_content").agg(F.collect_list(F.struct("key", "pass")).alias("_lacking"))  # a content's passes
    contents = keyed.groupBy(F.col("_keys")[0].alias("_content")).agg(*[F.first(c).alias(c) for c in columns])
    wanted = contents.join(lacking, "_content").select(*columns, F.explode("_lacking").alias("_l")).select(*columns, "_l.*")
    new = embed(wanted, make_embedder, [*columns, "pass"], dims, ["key", "pass"])
    generation = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    placed = saved(new.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")))
    embedded = placed.count()
    if embedded:
        placed.withColumn("generation", F.lit(generation)).repartition("bucket").write.mode("append").partitionBy("bucket", "generation").parquet(folder)
    figures = {k: n * passes for k, n in seen.get.items()} | {"distinct": distinct.count(), "embedded": embedded}
    if figures["rows"] and figures["empty"] / figures["rows"] >= EMPTY_SHARE:
        warnings.warn(f"{figures['empty']} of {figures['rows']} contents are empty: check the columns {columns}", stacklevel=2)
    held = placed.select("key", "v") if force else known.select("key", "v").unionByName(placed.select("key", "v"))
    return rows.select(*keys, F.posexplode("_keys").alias("pass", "key")).join(held, "key").select(*keys, "pass", "v"), figures


def mean_over_passes(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v: the mean of the passes' vectors, component by component."""
    per = vectors.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))  # a vector's components
