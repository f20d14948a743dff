"""Forms: detected words matched to a template's anchors, and its fields placed on the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confident(detections: DataFrame, least: float = 40) -> DataFrame:
    """Detected words (page, text, x, y, confidence) that are sure enough and not blank."""
    return detections.filter((F.col("confidence") >= least) & (F.trim("text") != ""))


def matched_anchors(detections: DataFrame, anchors: DataFrame, most_edits: float = 0.2) -> DataFrame:
    """page, anchor, x, y, ax, ay: of each anchor (anchor, ax, ay: a template's few) the detection nearest in spelling, within this share of its length; then the surest, then the first in reading order."""
    a, t = F.lower("anchor"), F.lower("text")
    met = detections.join(F.broadcast(anchors), F.abs(F.length("anchor") - F.length("text")) <= F.ceil(F.length("anchor") * most_edits))
    met = met.withColumn("edits", F.levenshtein(a, t)).filter(F.col("edits") <= F.length("anchor") * most_edits)
    w = Window.partitionBy("page", "anchor").orderBy("edits", F.desc("confidence"), "y", "x")
    return met.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("page", "anchor", "x", "y", "ax", "ay", "edits")


def found_anchors(detections: DataFrame, anchors: DataFrame, most_edits: float = 0.2) -> DataFrame:
    """As matched_anchors, but an anchor may be any part of a longer detection: the window of the anchor's length with the least edits counts."""
    a, t = F.lower("anchor"), F.lower("text")
    last = F.greatest(F.lit(1), F.length("text") - F.length("anchor") + 1)
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.levenshtein(F.substring(t, i, F.length("anchor")), a))
    met = detections.join(F.broadcast(anchors), F.length("text") >= F.length("anchor") * (1 - most_edits))  # a template's few
    met = met.withColumn("edits", F.array_min(windows)).filter(F.col("edits") <= F.length("anchor") * most_edits)
    w = Window.partitionBy("page", "anchor").orderBy("edits", F.desc("confidence"), "y", "x")
    return met.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("page", "anchor", "x", "y", "ax", "ay", "edits")


def located_fields(matches: DataFrame, fields: list[tuple[str, float, float, float, float]], within: float = 3.0) -> DataFrame:
    """page, field, x1, y1, x2, y2: where two opposite corners of a template's fields (name, x1, y1, x2, y2) lie on each page, by the turn, scale and shift that most of its anchors agree on.

    Pages with fewer than three anchors, or with all on one point, have none.
    """

    def place(pdf):
        import numpy as np
        import pandas as pd

        from quire.operators.posterior import consensus

        columns = ["page", "field", "x1", "y1", "x2", "y2"]
        pdf = pdf.sort_values("anchor")
        try:
            m = consensus(pdf[["ax", "ay"]].to_numpy(), pdf[["x", "y"]].to_numpy(), within)
        except ValueError:
            return pd.DataFrame([], columns=columns).astype({"page": "int64"})
        page = pdf["page"].iat[0]
        at = lambda x, y: (m @ np.array([x, y, 1.0])).tolist()
        return pd.DataFrame([(page, name, *at(x1, y1), *at(x2, y2)) for name, x1, y1, x2, y2 in fields], columns=columns)

    return matches.groupBy("page").applyInPandas(place, "page long, field string, x1 double, y1 double, x2 double, y2 double")
