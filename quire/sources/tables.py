"""TSV, CSV, gzip, JSON, parquet, embedding caches, model registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def separator(path: str) -> str:
    """Tab for .tsv (also .tsv.gz), else a comma."""
    return "\t" if path.removesuffix(".gz").endswith(".tsv") else ","


def read_table(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """A delimited file with a header; without a schema all columns are strings. Parquet by its suffix. ``multi_line``: fields may hold line breaks, at the price of one task a file."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", "true").option("sep", separator(path)).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_annotations(spark: SparkSession, path: str, pdf: str, page: str) -> DataFrame:
    """All columns as strings, without rows of a blank pdf, one row (the first) for each pdf and page."""
    from quire.operators.labels import first_rows

    df = read_table(spark, path).withColumn("_row", F.monotonically_increasing_id())
    df = df.filter(F.col(f"`{pdf}`").isNotNull() & (F.trim(F.col(f"`{pdf}`")) != ""))
    return first_rows(df, [f"`{pdf}`", f"`{page}`"], "_row").drop("_row")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """By the suffix: .tsv, .csv, .json or parquet (also a folder); many files, with a header each."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path.endswith((".tsv", ".csv")):
        w.option("header", "true").option("sep", separator(path)).option("escape", '"').csv(path)
    elif path.endswith(".json"):
        w.json(path)
    else:
        w.parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Page predictions with the columns dossier and page_num, whichever of the usual names the file has."""
    df = read_table(spark, path)
    for old, new in (("pdf_name", "dossier"), ("page", "page_num")):
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumn("page_num", F.col("page_num").cast("double").cast("int"))


def import_embeddings(spark: SparkSession, array_path: str, manifest_path: str, rows_per_task: int = 4096) -> DataFrame:
    """The manifest's rows with v, the row of a numpy array file at row_id. The file is mapped by each task, in a folder that all of them see."""
    import numpy as np

    manifest = read_table(spark, manifest_path).withColumn("row_id", F.col("row_id").cast("long"))

    def look_up(batches):
        import pandas as pd

        held = np.load(array_path, mmap_mode="r")
        for b in batches:
            yield pd.DataFrame({"row_id": b["row_id"], "v": [held[i].astype(float) for i in b["row_id"]]})

    found = manifest.select("row_id").mapInPandas(look_up, "row_id long, v array<double>")
    return manifest.join(found, "row_id")


def read_registry(spark: SparkSession, run_dir: str, task: str) -> DataFrame:
    """A row for each model of a task: model (its folder's name) and what its model_config.json has."""
    df = spark.read.option("multiLine", "true").json(f"{run_dir.rstrip('/')}/{task}/*/model_config.json")
    return df.withColumn("model", F.element_at(F.split(F.input_file_name(), "/"), -2))


def save_result(metrics: DataFrame, folder: str) -> None:
    """Metrics (task, model, metric, value), a partition for each task and model; a repeated run replaces its own."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task", "model").parquet(folder)


def load_results(spark: SparkSession, folder: str, task: str) -> DataFrame:
    """A row for each model, a column for each metric, best macro_f1 first."""
    rows = spark.read.parquet(folder).filter(F.col("task") == task)
    names = [r[0] for r in rows.select("metric").distinct().orderBy("metric").collect()]  # a handful of metrics
    wide = rows.groupBy("model").pivot("metric", names).agg(F.bround(F.first("value"), 4))
    return wide.orderBy(F.desc_nulls_last("macro_f1" if "macro_f1" in names else names[0]), "model")


def embed(pages: DataFrame, make_embedder, columns: list[str], dims: int, keys: list[str]) -> DataFrame:
    """keys, v of each page by a plug-in: ``make_embedder()`` is called once a task and gives a function from a pandas frame to an array of rows."""

    def run(batches):
        import pandas as pd

        embedder = make_embedder()
        for b in batches:
            v = embedder(b)
            if len(v) != len(b) or (len(v) and len(v[0]) != dims):
                raise ValueError("the embedder's rows don't fit")
            yield pd.DataFrame({**{k: b[k] for k in keys}, "v": [list(map(float, x)) for x in v]})

    types = dict(pages.dtypes)
    return pages.select(*keys, *[c for c in columns if c not in keys]).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", v array<double>")


def predict(pages: DataFrame, make_model, columns: list[str], keys: list[str]) -> DataFrame:
    """keys, probs of each page by a plug-in model, made once a task: a function from a pandas frame to rows of probabilities."""

    def run(batches):
        import pandas as pd

        model = make_model()
        for b in batches:
            yield pd.DataFrame({**{k: b[k] for k in keys}, "probs": [list(map(float, x)) for x in model(b)]})

    types = dict(pages.dtypes)
    return pages.select(*keys, *[c for c in columns if c not in keys]).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", probs array<double>")
