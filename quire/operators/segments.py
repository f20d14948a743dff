"""Segmentation algebra: start flags to segments, heads, carried labels.

``by`` are the columns that name an ordered sequence of pages (a dossier, or a dossier within a draw or a model pair). All windows
share one partitioning and order, so a chain of these functions shuffles the pages once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import is_start

DOSSIER = ("dossier",)


def starts(flag: Column | str, by=DOSSIER, page: str = "page_num", rule: str = "trim") -> Column:
    """Whether a page starts a segment: its flag says so or it is the first of its sequence."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    flag = flag if rule == "bool" else is_start(flag, rule)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(page)) == 1
    return F.coalesce(flag, F.lit(False)) | first


def running(by=DOSSIER, page: str = "page_num"):
    return Window.partitionBy(*by).orderBy(page).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def segmented(pages: DataFrame, flag: Column | str = "start_page", by=DOSSIER, page: str = "page_num", rule: str = "trim", prefix: str = "") -> DataFrame:
    """``pages`` with <prefix>seg (from 0 in each sequence) and <prefix>head (its first page) added."""
    mark = f"_{prefix}start"
    out = pages.withColumn(mark, starts(flag, by, page, rule))
    w = running(by, page)
    return out.withColumns({
        f"{prefix}seg": F.sum(F.col(mark).cast("int")).over(w).cast("int") - 1,
        f"{prefix}head": F.last(F.when(F.col(mark), F.col(page)), ignorenulls=True).over(w),
    }).drop(mark)


def heads_from_ids(pages: DataFrame, segment_id: str, by=DOSSIER, page: str = "page_num", out: str = "head") -> DataFrame:
    """The first page of each page's segment, where segments have an id of their own."""
    return pages.withColumn(out, F.min(page).over(Window.partitionBy(*by, segment_id)))


def segments(pages: DataFrame, by=DOSSIER, seg: str = "seg", page: str = "page_num") -> DataFrame:
    """A row for each segment: head and n_pages."""
    return pages.groupBy(*by, seg).agg(F.min(page).alias("head"), F.count(F.lit(1)).alias("n_pages"))


def carried(column: str, head: str = "head", by=DOSSIER, page: str = "page_num") -> Column:
    """The column's value on the segment's head page, on all its pages (null where the head's is)."""
    w = running(by, page)
    return F.last(F.when(F.col(head) == F.col(page), F.struct(F.col(column).alias("v"))), ignorenulls=True).over(w)["v"]


def labelled(pages: DataFrame, label: str, by=DOSSIER, seg: str = "seg", page: str = "page_num") -> DataFrame:
    """head and label of each segment: its commonest label, the least of several; null if it has none."""
    return pages.groupBy(*by, seg).agg(F.min(page).alias("head"), F.mode(label, True).alias("label"))


def documents(pages: DataFrame, label: str, confidence: str, by=DOSSIER, seg: str = "seg", page: str = "page_num") -> DataFrame:
    """A row for each segment: n_pages, first_page, type (largest summed confidence, then first seen), mean_confidence of its pages, and order_in_dossier, n_segments, norm_position."""
    per = pages.groupBy(*by, seg, label).agg(
        F.sum(confidence).alias("_sum"), F.min(page).alias("_first"), F.count(F.lit(1)).alias("_n"), F.avg(confidence).alias("_mean"))
    best = F.struct(F.coalesce(F.col("_sum"), F.lit(float("-inf"))), -F.col("_first"))
    out = per.groupBy(*by, seg).agg(
        F.sum("_n").alias("n_pages"), F.min("_first").alias("first_page"),
        F.max_by(F.struct(F.col(label).alias("t"), F.col("_mean").alias("m")), best).alias("_best"))
    out = out.select(*by, seg, "n_pages", "first_page", F.col("_best.t").alias("type"), F.col("_best.m").alias("mean_confidence"))
    return positioned(out, by)


def positioned(segs: DataFrame, by=DOSSIER, order: str = "first_page") -> DataFrame:
    """order_in_dossier (from 0), n_segments and norm_position (0 to 1) of each segment."""
    w = Window.partitionBy(*by)
    out = segs.withColumns({"order_in_dossier": (F.row_number().over(w.orderBy(order)) - 1).cast("int"), "n_segments": F.count(F.lit(1)).over(w)})
    return out.withColumn("norm_position", F.col("order_in_dossier") / F.greatest(F.col("n_segments") - 1, F.lit(1)))


def predicted_documents(pages: DataFrame, start_probability: str, type_of_heads, by=DOSSIER, page: str = "page_num", threshold: float = 0.5) -> DataFrame:
    """Two stages: starts by their probability, then types of the predicted starts alone, carried to all pages of the segment.

    ``type_of_heads`` takes the head pages and returns them with predicted_document_type and document_type_confidence. Pages before a
    dossier's first predicted start belong to its first page's segment, which has no type.
    """
    p = F.col(start_probability)
    out = pages.withColumn("predicted_start_page", F.when(p >= threshold, "yes").otherwise("no"))
    out = out.withColumn("start_page_confidence", F.when(p.isNotNull(), F.greatest(p, 1 - p)))
    out = segmented(out, "predicted_start_page", by, page).withColumnRenamed("head", "predicted_segment_id").drop("seg")
    typed = type_of_heads(out.filter("predicted_start_page = 'yes'"))
    typed = typed.select(*by, F.col(page).alias("predicted_segment_id"), "predicted_document_type", "document_type_confidence")
    return out.join(typed, [*by, "predicted_segment_id"], "left").select(*out.columns, "predicted_document_type", "document_type_confidence")


def mean_pooled(pages: DataFrame, vector: str, by=DOSSIER, seg: str = "seg") -> DataFrame:
    """dossier, seg, dim (from 0), mean: the mean vector of each segment, in double precision."""
    return pages.select(*by, seg, F.posexplode(vector).alias("dim", "x")).groupBy(*by, seg, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def boundary_features(pages: DataFrame, vector: str, by=DOSSIER, page: str = "page_num", out: str = "boundary") -> DataFrame:
    """The vector minus the one of the page before; zeros on the first page."""
    before = F.lag(vector).over(Window.partitionBy(*by).orderBy(page))
    diff = F.zip_with(vector, before, lambda x, y: x.cast("double") - y.cast("double"))
    return pages.withColumn(out, F.when(before.isNull(), F.transform(vector, lambda x: F.lit(0.0))).otherwise(diff))


def sequences(pages: DataFrame, columns: list[str], by=DOSSIER, page: str = "page_num") -> DataFrame:
    """A row for each sequence: pages, an array of structs in page order. For sequences that fit a row (a dossier does)."""
    return pages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(page, *columns))).alias("pages"))


def padded(values: Column, length: Column | int, filler) -> Column:
    """The array filled up to this length."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(length - F.size(values), F.lit(0))))


def recomposed(pages: DataFrame, passes: int, seed: str, by: str = "dossier", page: str = "page_num", label: str = "document_type", start: str = "start_page",
               cover: str | None = None) -> DataFrame:
    """The documents of each dossier in another order, ``passes`` times: by a hash of seed, pass and head, covers first. Pages are numbered anew from 1 and every document's first page starts it."""
    from quire.functions.hashing import uniform

    seg = segmented(pages, start, (by,), page)
    docs = labelled(seg, label, (by,), "seg", page)
    docs = docs.crossJoin(pages.sparkSession.range(1, passes + 1).select(F.col("id").alias("pass")))  # passes: a few
    is_cover = F.coalesce(F.col("label") == F.lit(cover), F.lit(False)) if cover is not None else F.lit(False)
    rank = F.struct((~is_cover).cast("int").alias("rest"), F.when(is_cover, F.col("head").cast("double")).otherwise(uniform(F.lit(seed), "pass", by, "head")).alias("u"))
    docs = docs.select(by, "seg", "pass", rank.alias("_rank"))
    joined = seg.join(docs, [by, "seg"])
    w = Window.partitionBy(by, "pass").orderBy("_rank", page)
    first = F.col(page) == F.col("head")
    return joined.select(
        F.concat(F.col(by).cast("string"), F.lit("_shuffle"), F.col("pass").cast("string")).alias(by), F.row_number().over(w).alias(page),
        F.when(first, "yes").otherwise("no").alias(start), F.col(by).alias("source_dossier"), F.col(page).alias("source_page"), F.col(label))


def page_budget_batches(dossiers: DataFrame, budget: int, order: str = "u", size: str = "n_pages") -> DataFrame:
    """Consecutive dossiers, in this order (ties by name), in batches of at most ``budget`` pages: batch (from 0) added. A dossier above the budget is an error.

    Every batch takes as many as it can. Were a batch to start at a dossier, the next would start at the first that doesn't fit any more: how many dossiers end within
    the budget from there. Which of them really start one follows by pointer doubling from the first; no step orders everything in one task.
    """
    from quire.operators.graph import saved
    from quire.operators.ranking import numbered, running_total

    if not dossiers.filter(F.col(size) > budget).isEmpty():
        raise ValueError(f"dossiers of more than {budget} pages")
    rows = dossiers.select("dossier", F.col(order).alias("_o"), F.col(size).cast("long").alias("_n"))
    rows = saved(running_total(numbered(rows, ["_o", "dossier"], "_i"), ["_i"], F.col("_n"), "_before"))
    ends = rows.select((F.col("_before") + F.col("_n")).alias("at"), F.lit(0).alias("kind"), "_i")
    limits = rows.select((F.col("_before") + budget).alias("at"), F.lit(1).alias("kind"), "_i")
    counted = running_total(ends.unionByName(limits), ["at", "kind", "_i"], (F.col("kind") == 0).cast("long"), "next")
    jump = saved(counted.filter("kind = 1").select("_i", "next"))
    starts = saved(rows.filter("_i = 0").select("_i"))
    n = 0
    while (m := starts.count()) > n:
        n = m
        starts = saved(starts.unionByName(starts.join(jump, "_i").select(F.col("next").alias("_i"))).join(rows.select("_i"), "_i", "left_semi").distinct())
        jump = saved(jump.join(jump.select(F.col("_i").alias("next"), F.col("next").alias("_next")), "next").select("_i", F.col("_next").alias("next")))
    marked = rows.join(starts.withColumn("_s", F.lit(1).cast("long")), "_i", "left").withColumn("_s", F.coalesce("_s", F.lit(0).cast("long")))
    out = running_total(marked, ["_i"], F.col("_s"), "_earlier")
    return out.select("dossier", F.col("_n").alias(size), (F.col("_earlier") + F.col("_s") - 1).cast("int").alias("batch"))
