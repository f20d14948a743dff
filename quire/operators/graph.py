"""Connected components by contraction: least neighbours, with pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared checkpoint folder, so that lineage doesn't grow with the rounds and lost executors cost nothing."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints"
    path = f"{root.rstrip('/')}/quire-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id in ``edges`` (src, dst). An edge with a null end only names its other one.

    A round joins every id with its least neighbour; trees of these become one id, their least, and edges between trees the next round's. Each tree has two ids or more, so the ids that still have edges
    are at most half as many after a round: rounds grow with the logarithm of the ids, and what all of them read with the ids themselves.
    """
    both = saved(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src is not null").distinct())
    ids = both.select(F.col("src").alias("id")).distinct()
    links, levels = saved(both.filter("src <> dst")), []
    while not links.isEmpty():
        up = links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("up"))
        # Only two ids can be each other's least neighbour, no more go round in a circle: the lesser is the root.
        back = up.select(F.col("id").alias("up"), F.col("up").alias("_back"))
        up = saved(up.join(back, "up").select("id", F.when((F.col("_back") == F.col("id")) & (F.col("id") < F.col("up")), F.col("id")).otherwise(F.col("up")).alias("up")))
        while True:
            further = saved(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up"), (F.col("_up") != F.col("up")).alias("moved")))
            up = further.select("id", "up")
            if further.filter("moved").isEmpty():
                break
        levels.append(up)
        ends = links.join(up.select(F.col("id").alias("src"), F.col("up").alias("_src")), "src").join(up.select(F.col("id").alias("dst"), F.col("up").alias("_dst")), "dst")
        links = saved(ends.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).filter("src <> dst").distinct())
    found = None  # of the ids of the rounds after, back to the first
    for up in reversed(levels):
        if found is not None:
            up = up.join(found.select(F.col("id").alias("up"), "component"), "up", "left").select("id", F.coalesce("component", "up").alias("up"))
        found = saved(up.withColumnRenamed("up", "component"))
    if found is None:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
