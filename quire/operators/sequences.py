"""Ordered sequences of a dossier's page vectors, padded in chunks of so many steps.

A dossier is never one row: its pages are numbered in order (by ranges, so a dossier may have any number of them) and each chunk of ``steps`` pages is a row of fixed size, with zeros and
a mask where the dossier ends. Chunks of one place in their dossiers make a batch of equal shape.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.ranking import numbered


def chunks(pages: DataFrame, vector: str, label: str | None, steps: int, dims: int, dossier: str = "dossier", page: str = "page_num", ignore: int = -1) -> DataFrame:
    """dossier, chunk (from 0), length (pages of the dossier), n (pages of the chunk), features (steps * dims values, page by page), mask (steps), labels (steps; ``ignore`` where there is no page or no label).

    Pages are in the order of ``page``, which has to be unique within a dossier. A null vector counts as zeros but stays unmasked; a vector of another length is an error, raised as it is met. Pages without a dossier go.
    """
    label_of = F.col(label).cast("int") if label else F.lit(None).cast("int")
    zeros = F.array_repeat(F.lit(0.0), dims)
    v = F.when(F.col(vector).isNull(), zeros).otherwise(F.col(vector).cast("array<double>"))
    rows = pages.filter(F.col(dossier).isNotNull()).select(F.col(dossier).alias("dossier"), F.col(page).alias("_page"), v.alias("_vector"), label_of.alias("_y"))
    fits = F.assert_true(F.size("_vector") == dims, F.concat(F.lit("a vector of another length in "), F.col("dossier").cast("string")))
    place = numbered(rows, ["_page"], "_i", ("dossier",))
    length = rows.groupBy("dossier").agg(F.count(F.lit(1)).alias("length"))
    in_chunk = F.struct((F.col("_i") % steps).alias("at"), F.when(fits.isNull(), F.col("_vector")).alias("v"), F.col("_y").alias("y"))
    grouped = place.groupBy("dossier", F.floor(F.col("_i") / steps).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(in_chunk)).alias("_p"))  # ``steps`` pages at most
    n = F.size("_p")
    missing = F.lit(steps) - n
    padded = grouped.join(length, "dossier").select(
        "dossier", "chunk", "length", n.alias("n"), F.concat(F.flatten(F.transform("_p", lambda p: p["v"])), F.array_repeat(F.lit(0.0), missing * dims)).alias("features"),
        F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), missing)).alias("mask"),
        F.concat(F.transform("_p", lambda p: F.coalesce(p["y"], F.lit(ignore))), F.array_repeat(F.lit(ignore), missing)).alias("labels"))
    return padded


def tensors(batch, steps: int, dims: int) -> tuple:
    """(features: chunks x steps x dims, mask, labels) of an Arrow batch of ``chunks``, without a Python object for each value."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("features", "mask", "labels")]
    f, m, y = (c.flatten().to_numpy(zero_copy_only=False) for c in columns)
    return f.reshape(-1, steps, dims), m.reshape(-1, steps), y.reshape(-1, steps)


def predicted(padded: DataFrame, make_model, steps: int, dims: int, classes: int) -> DataFrame:
    """dossier, page (place in the dossier, from 0), probs of each page: ``make_model()``, made once a task, takes (features, mask) of a batch and gives chunks x steps x classes probabilities."""
    kind = dict(padded.dtypes)["dossier"]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = make_model()
        for b in batches:
            x, mask, _ = tensors(b, steps, dims)
            p = np.asarray(model(x, mask), float)
            if p.shape != (*mask.shape, classes):
                raise ValueError("the model's probabilities don't fit")
            row, step = np.nonzero(mask)
            first = b.column(b.schema.get_field_index("chunk")).to_numpy() * steps
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * classes, pa.int32()), pa.array(p[row, step].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("dossier")).take(pa.array(row)), pa.array((first[row] + step).astype(np.int64)), flat], names=["dossier", "page", "probs"])

    return padded.mapInArrow(run, f"dossier {kind}, page long, probs array<double>")
