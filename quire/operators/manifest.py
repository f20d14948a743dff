"""Page manifests and label sets: normalisation, limits, validation, vocabularies, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ranking import numbered


def normalised(df: DataFrame, dossier: str, page: str, image: str | None = None, text: str | None = None, image_root: str | None = None) -> DataFrame:
    """``df`` with its columns named dossier, page_num (a number, null if it isn't one), image_path (under the root), text_path."""
    names = {dossier: "dossier", page: "page_num", **({image: "image_path"} if image else {}), **({text: "text_path"} if text else {})}
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"the manifest has no {missing}; it has {df.columns}")
    out = df.withColumnsRenamed(names).withColumn("page_num", F.col("page_num").try_cast("int"))
    if image and image_root:
        out = out.withColumn("image_path", F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(F.concat_ws("/", F.lit(image_root.rstrip("/")), "image_path")))
    return out


def in_page_order(df: DataFrame, dossier: str = "dossier", page: str = "page_num") -> DataFrame:
    """Sorted by dossier and page as a number; pages that aren't numbers last."""
    return df.orderBy(dossier, F.asc_nulls_last(F.col(page).try_cast("int")))


def first_dossiers(df: DataFrame, n: int, order: str, dossier: str = "dossier") -> DataFrame:
    """Rows of the n dossiers that come first in the order of ``order``."""
    seen = df.groupBy(dossier).agg(F.min(order).alias("_o")).orderBy("_o", dossier).limit(n)
    return df.join(seen.select(dossier), dossier, "left_semi")


def existing_files(spark, root: str, pattern: str = "*") -> DataFrame:
    """path, modified, length of all files below a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def existing_tables(spark, root: str, suffix: str = ".parquet") -> DataFrame:
    """name, length of all tables below a folder: files with this suffix, and folders with it by the total of such files in them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    below = F.substring("path", len(whole.rstrip("/")) + 2, 1 << 30)
    table = F.filter(F.split(below, "/"), lambda x: x.endswith(suffix))[0]  # the outermost
    return existing_files(spark, root, "*" + suffix).groupBy(table.alias("name")).agg(F.sum("length").alias("length"))


def missing_files(df: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows whose path isn't among ``files`` (path); a null path is missing."""
    return df.join(files.select(F.col("path").alias(column)), column, "left_anti")


def checked_files(df: DataFrame, files: DataFrame, column: str, allow_missing: bool = False, examples: int = 10) -> DataFrame:
    """Rows whose file is there. Others are an error that names some, unless they may be missing."""
    if not allow_missing:
        lacking = missing_files(df, files, column).select(column).limit(examples).collect()  # a few, for the message
        if lacking:
            raise FileNotFoundError(f"missing, for example: {[r[0] for r in lacking]}")
    return df.join(files.select(F.col("path").alias(column)), column, "left_semi").select(*df.columns)


def outdated(sources: DataFrame, targets: DataFrame, stem: Column | None = None) -> DataFrame:
    """Sources (path, modified) without a target of the same stem that is as new: what an incremental run has to do."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "") if stem is None else stem
    done = targets.select(stem.alias("_stem"), F.col("modified").alias("_done")).groupBy("_stem").agg(F.max("_done").alias("_done"))
    out = sources.withColumn("_stem", stem).join(done, "_stem", "left")
    return out.filter(F.col("_done").isNull() | (F.col("_done") < F.col("modified"))).select(*sources.columns)


def mirrored(path: Column, old_root: str, new_root: str, suffix: str) -> Column:
    """The path below another root, with another suffix."""
    rest = F.regexp_replace(F.substring(path, F.lit(len(old_root.rstrip("/")) + 1), F.length(path)), r"\.[^./]*$", "")
    return F.concat(F.lit(new_root.rstrip("/")), rest, F.lit(suffix))


def anonymised(df: DataFrame, key: str, order: str, prefix: str = "pdf_") -> DataFrame:
    """``df`` with row_id (place in the order, from 0) and <key>_id: pdf_00000 for the key seen first."""
    first = df.groupBy(key).agg(F.min(order).alias("_o"))
    named = numbered(first, ["_o", key], "_i").select(key, F.format_string(prefix + "%05d", F.col("_i").cast("int")).alias(f"{key}_id"))
    return numbered(df.join(named, key), [order], "row_id")


def vocabulary(df: DataFrame, column: str, split: str | None = None) -> DataFrame:
    """label, idx (from 0, in code point order) of the values (of training rows, if a split column is given)."""
    rows = df if split is None else df.filter(F.col(split) == "train")
    values = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("label")).distinct()
    return values.withColumn("idx", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))  # a row for each class


def indexed(df: DataFrame, vocab: DataFrame, column: str, out: str = "label_idx", ignore: int = -100) -> DataFrame:
    """``df`` with the label's index; labels beyond the vocabulary and null ones have ``ignore``."""
    v = vocab.select(F.col("label").alias(column), F.col("idx").alias("_i"))
    return df.join(v, column, "left").withColumn(out, F.coalesce("_i", F.lit(ignore))).drop("_i").select(*df.columns, out)


def start_labels(df: DataFrame, column: str = "start_page") -> DataFrame:
    """label: 1 if the page starts a document ('yes' exactly), else 0."""
    return df.withColumn("label", F.coalesce((F.col(column) == "yes").cast("int"), F.lit(0)))


def type_labels(df: DataFrame, column: str = "document_type", start: str = "start_page") -> DataFrame:
    """Start pages of known type, with label: the type's index in the vocabulary of these pages."""
    rows = df.filter((F.col(start) == "yes") & F.col(column).isNotNull())
    return indexed(rows, vocabulary(rows, column), column, "label")


def class_weights(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """label, n, weight: inverse frequencies that sum to the number of classes; a class without rows counts as one row."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    out = classes.select("label").join(n, "label", "left").na.fill(0, ["n"])
    w = 1.0 / F.greatest(F.col("n"), F.lit(1))
    total = out.agg(F.sum(w).alias("_s"), F.count(F.lit(1)).alias("_k"))
    return out.crossJoin(F.broadcast(total)).select("label", "n", (w / F.col("_s") * F.col("_k")).alias("weight"))  # one row


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """label, weight: rows / (classes * rows of the class)."""
    n = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return n.crossJoin(F.broadcast(total)).select("label", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def year_index(df: DataFrame, year: str = "travel_year") -> DataFrame:
    """``df`` with year_idx: the years that occur, numbered from 0."""
    years = vocabulary(df, year).select(F.col("label").alias(year), F.col("idx").alias("year_idx"))
    return df.join(years, year, "left").select(*df.columns, "year_idx")


def matched_meta(pages: DataFrame, meta: DataFrame, identifier, key: str = "identifier") -> tuple[DataFrame, DataFrame]:
    """(the pages of dossiers that meta describes, meta with their dossier): ``identifier`` of a dossier's name is meta's key.

    A row of meta that no dossier or several have is an error, raised as it is met. All of meta's columns stay.
    """
    names = pages.select("dossier").distinct().groupBy(identifier(F.col("dossier")).alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("dossier").alias("dossier"))
    met = meta.join(names, F.col(key).cast("string") == F.col("_id"), "left")
    checked = F.assert_true(F.coalesce(F.col("_n"), F.lit(0)) == 1, F.concat(F.lit("not one dossier of "), F.col(key).cast("string")))
    out = met.filter(checked.isNull()).select("dossier", *[F.col(f"`{c}`") for c in meta.columns])
    return pages.join(out.select("dossier"), "dossier", "left_semi"), out


def in_periods(df: DataFrame, periods: list[tuple[str, int, int]], year: str = "travel_year") -> DataFrame:
    """A row for each period (name, first, last year) that a row lies in."""
    p = df.sparkSession.createDataFrame(periods, "period string, _first int, _last int")
    return df.join(F.broadcast(p), F.col(year).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")  # a few periods


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join; a key that is on either side more than once is an error, raised as it is met."""
    once = lambda df, c: df.withColumn(c, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    out = once(left, "_l").join(once(right, "_r"), keys)
    checked = F.assert_true((F.col("_l") == 1) & (F.col("_r") == 1), F.lit("keys repeat"))
    return out.filter(checked.isNull()).drop("_l", "_r")


def same_observations(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """table, n, digest: tables with the same observations have the same digest, in any order."""
    out = None
    for name, df in tables.items():
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(value).cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)")
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("digest")).select(F.lit(name).alias("table"), "n", "digest")
        out = row if out is None else out.unionByName(row)
    return out


def yearly(df: DataFrame, value: str, year: str = "travel_year") -> DataFrame:
    return df.groupBy(year).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.var_samp(value).alias("var"), F.count(value).alias("n"))


def yearly_ratio(df: DataFrame, part: str, whole: str, year: str = "travel_year") -> DataFrame:
    return df.groupBy(year).agg((F.sum(part) / F.sum(whole)).alias("ratio"))


def grouped_elpd(points: DataFrame, group: str, model: str = "model", value: str = "elpd") -> DataFrame:
    """group, model, elpd (sum), se (population sd times the root of the number of points)."""
    return points.groupBy(group, model).agg(F.sum(value).alias("elpd"), (F.stddev_pop(value) * F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))


def pareto_counts(points: DataFrame, k: str = "pareto_k") -> DataFrame:
    return points.agg(F.count_if(F.col(k) > 0.7).alias("bad"), F.count_if((F.col(k) > 0.5) & (F.col(k) <= 0.7)).alias("ok"), F.count(k).alias("n"))
