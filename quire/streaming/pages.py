"""Segmentation of page streams.

Pages of a dossier come in order of their numbers. State for a dossier is its last page, segment and head, so it is small however long the dossier gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "dossier string, page_num int, seg int, head int"
STATE = "page int, seg int, head int"


def streaming_segments(pages: DataFrame, idle: str | None = None) -> DataFrame:
    """dossier, page_num, seg, head of each page (dossier, page_num, start_page), as batch segmentation has them. Pages that don't follow their dossier's last one are dropped: they are repeats.

    ``idle``: after so much processing time without a page a dossier's state is let go.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, seg, head = state.get if state.exists else (None, -1, 0)
        rows = pd.concat(list(batches)).sort_values("page_num")
        out = []
        for page, flag in zip(rows["page_num"], rows["start_page"]):
            if last is not None and page <= last:
                continue
            if last is None or (isinstance(flag, str) and flag.strip().lower() == "yes"):
                seg, head = seg + 1, int(page)
            last = int(page)
            out.append((key[0], last, seg, head))
        if last is not None:
            state.update((last, seg, head))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["dossier", "page_num", "seg", "head"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    rows = pages.select("dossier", F.col("page_num").cast("int").alias("page_num"), "start_page")
    return rows.groupBy("dossier").applyInPandasWithState(step, OUT, STATE, "append", timeout)


def windowed_counts(pages: DataFrame, time: str, label: str, size: str, late: str) -> DataFrame:
    """Pages of each label in tumbling windows of event time; pages later than ``late`` don't count."""
    return pages.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), label, "n")


def rewrite_dossiers(path: str, segment, buckets: int = 64):
    """A foreachBatch function: pages of each batch are written by dossier bucket, and the touched dossiers are segmented anew from all their pages.

    Only the touched buckets of earlier batches are read. A batch that is tried again replaces what it wrote: its pages lie in a folder of its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("_bucket", F.pmod(F.xxhash64("dossier"), F.lit(buckets)).cast("int"))
        own.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/pages/batch={number}")
        touched = batch.select("dossier").distinct()
        wanted = [r[0] for r in own.select("_bucket").distinct().collect()]  # as many as there are buckets
        every = spark.read.schema(own.schema.add("batch", "long")).option("basePath", f"{path}/pages").parquet(f"{path}/pages").filter(F.col("_bucket").isin(wanted))
        pages = every.select(*batch.columns).join(touched, "dossier", "left_semi").dropDuplicates(["dossier", "page_num"])
        segment(pages).withColumn("as_of", F.lit(number)).write.mode("overwrite").parquet(f"{path}/segments/as_of_batch={number}")

    return write
