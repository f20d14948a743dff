"""Label curation: votes of annotators, spellings, mapping groups, rare classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import casefolded

VOTED = ["document_type", "layout_type", "functional_category", "start_page"]


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same keys the first in this order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def annotator_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """One long table of the annotators' tables, with annotator and annotator_order (that of the dict)."""
    out = None
    for i, (name, df) in enumerate(tables.items()):
        df = df.withColumns({"annotator": F.lit(name), "annotator_order": F.lit(i)})
        out = df if out is None else out.unionByName(df)
    return out


def votes(rows: DataFrame, keys: list[str], columns: list[str] = VOTED, order: str = "annotator_order") -> DataFrame:
    """keys, column, value, status, n_annotators, one row for each page and voted column.

    status: no-data, single, unanimous, majority or tie. Of values with as many votes the one that is commoner in the whole table wins, then the one
    of the first annotator.
    """
    long = rows.select(*keys, order, *columns).unpivot([*keys, order], columns, "column", "value")
    common = long.filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("_freq"))
    per = long.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    per = per.join(common, ["column", "value"], "left")
    given = F.col("value").isNotNull()
    win = F.struct(F.when(given, F.col("_n")).otherwise(-1), F.coalesce("_freq", F.lit(0)), -F.col("_first"))
    top = per.groupBy(*keys, "column").agg(
        F.max_by("value", win).alias("value"), F.max(F.when(given, F.col("_n"))).alias("top"), F.sum(F.when(given, F.col("_n")).otherwise(0)).alias("total"),
        F.sum("_n").alias("n_annotators"), F.collect_list(F.when(given, F.col("_n"))).alias("_counts"))  # as many as annotators
    several = F.size(F.filter("_counts", lambda x: x == F.col("top"))) > 1
    status = (F.when(F.col("total") == 0, "no-data").when(F.col("total") == 1, "single").when(several, "tie").when(F.col("top") == F.col("total"), "unanimous").otherwise("majority"))
    return top.select(*keys, "column", "value", status.alias("status"), "n_annotators")


def consensus(voted: DataFrame, keys: list[str], columns: list[str] = VOTED) -> DataFrame:
    """A row for each page: each column's value and <column>_agreement, n_annotators."""
    out = []
    for c in columns:
        out += [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c), F.max(F.when(F.col("column") == c, F.col("status"))).alias(f"{c}_agreement")]
    return voted.groupBy(*keys).agg(*out, F.max("n_annotators").alias("n_annotators"))


def agreement_summary(voted: DataFrame) -> DataFrame:
    return voted.groupBy("column", "status").agg(F.count(F.lit(1)).alias("n"))


def disagreements(voted: DataFrame, rows: DataFrame, keys: list[str], columns: list[str] = VOTED) -> DataFrame:
    """What each annotator gave on pages of several annotators where a column has no clear value."""
    odd = voted.filter(F.col("status").isin("majority", "tie", "no-data") & (F.col("n_annotators") > 1)).select(*keys).distinct()
    return rows.join(odd, keys, "left_semi").select(*keys, "annotator", *columns)


def canonical(rows: DataFrame, label: str, by=()) -> DataFrame:
    """by, variant, canonical of each spelling: the commonest that differs only in case and outer white space, then the least."""
    per = rows.filter(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("variant")).agg(F.count(F.lit(1)).alias("n")).withColumn("key", casefolded(F.col("variant")))
    w = Window.partitionBy(*by, "key").orderBy(F.desc("n"), "variant")
    return per.withColumn("canonical", F.first("variant").over(w)).select(*by, "variant", "canonical", "n")


def mapped(rows: DataFrame, mapping: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """``rows`` with the label replaced where ``mapping`` (keys, label, mapped) has it, and unmapped telling where it hasn't."""
    m = mapping.select(*keys, F.col("label").alias(label), F.col("mapped").alias("_mapped"))
    out = rows.join(m, [*keys, label], "left")
    return out.withColumns({"unmapped": F.col("_mapped").isNull() & F.col(label).isNotNull(), label: F.coalesce("_mapped", label)}).drop("_mapped").select(*rows.columns, "unmapped")


def shared_keys(rows: DataFrame, key: str, annotators: int) -> DataFrame:
    """Keys that all annotators have."""
    return rows.groupBy(key).agg(F.count_distinct("annotator").alias("_n")).filter(F.col("_n") == annotators).select(key)


def unused_labels(rows: DataFrame, label: str, shared: DataFrame, key: str) -> DataFrame:
    """annotator, label of labels never used on shared keys."""
    used = rows.filter(F.col(label).isNotNull()).select("annotator", F.col(label).alias("label"), key)
    return used.select("annotator", "label").distinct().join(used.join(shared, key, "left_semi").select("annotator", "label").distinct(), ["annotator", "label"], "left_anti")


def cooccurrence_edges(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """annotator_a, label_a, annotator_b, label_b, weight: on how many pages two annotators gave these labels."""
    one = rows.filter(F.col(label).isNotNull())
    a = one.select(*keys, F.col("annotator").alias("annotator_a"), F.col(label).alias("label_a"))
    b = one.select(*keys, F.col("annotator").alias("annotator_b"), F.col(label).alias("label_b"))
    return a.join(b, keys).filter("annotator_a < annotator_b").groupBy("annotator_a", "label_a", "annotator_b", "label_b").agg(F.count(F.lit(1)).alias("weight"))


def identity_edges(rows: DataFrame, label: str) -> DataFrame:
    """The same columns for labels of two annotators with one spelling, weight 0."""
    own = rows.filter(F.col(label).isNotNull()).select("annotator", F.col(label).alias("label")).distinct().withColumn("key", casefolded(F.col("label")))
    a, b = own.select("key", F.col("annotator").alias("annotator_a"), F.col("label").alias("label_a")), own.select("key", F.col("annotator").alias("annotator_b"), F.col("label").alias("label_b"))
    return a.join(b, "key").filter("annotator_a < annotator_b").select("annotator_a", "label_a", "annotator_b", "label_b", F.lit(0).cast("long").alias("weight"))


def unified_edges(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Both kinds, once each pair, with source: co-occurrence, identical-label, or co-occurrence+identical-label."""
    both = cooccurrence_edges(rows, keys, label).withColumn("source", F.lit("co-occurrence")).unionByName(identity_edges(rows, label).withColumn("source", F.lit("identical-label")))
    ends = ["annotator_a", "label_a", "annotator_b", "label_b"]
    return both.groupBy(*ends).agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"))


def mapping_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """annotator, label, component of each node: the least 'annotator|label' that it hangs together with."""
    from quire.operators.graph import connected_components

    name = lambda s: F.concat_ws("|", f"annotator_{s}", f"label_{s}")
    found = connected_components(edges.select(name("a").alias("src"), name("b").alias("dst")))
    own = nodes.select("annotator", "label").distinct().withColumn("id", F.concat_ws("|", "annotator", "label"))
    return own.join(found, "id", "left").select("annotator", "label", F.coalesce("component", "id").alias("component"))


def classified_components(groups: DataFrame, a: str, b: str) -> DataFrame:
    """component, n_a, n_b, kind (1-to-1, 1-to-many, many-to-1, many-to-many, unmatched) between two annotators."""
    n = groups.groupBy("component").agg(F.count_if(F.col("annotator") == a).alias("n_a"), F.count_if(F.col("annotator") == b).alias("n_b")).filter("n_a + n_b > 0")
    na, nb = F.col("n_a"), F.col("n_b")
    kind = F.when((na <= 1) & (nb <= 1), "1-to-1").when((na == 1) & (nb > 1), "1-to-many").when((na > 1) & (nb == 1), "many-to-1").when((na > 1) & (nb > 1), "many-to-many").otherwise("unmatched")
    return n.withColumn("kind", kind)


def preferred_labels(groups: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """component, preferred: the spelling that its annotators used most, then the least."""
    used = rows.filter(F.col(label).isNotNull()).groupBy("annotator", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    per = groups.join(used, ["annotator", "label"]).groupBy("component", "label").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("component").orderBy(F.desc("n"), "label")
    return per.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("component", F.col("label").alias("preferred"), "n")


def rare_merge(rows: DataFrame, label: str, layout: str, functional: str, min_count: int, count_by: str | None = None, split: str | None = None) -> DataFrame:
    """label, merged of the classes below ``min_count`` training rows (or distinct ``count_by``): 'Other (layout, functional)', the commonest of all its rows. A class that training lacks isn't rare."""
    train = rows if split is None else rows.filter(F.col(split) == "train")
    n = F.count(F.lit(1)) if count_by is None else F.count_distinct(count_by)
    rare = train.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(n.alias("n")).filter(F.col("n") < min_count)
    modes = rows.groupBy(F.col(label).alias("label")).agg(F.mode(layout, True).alias("l"), F.mode(functional, True).alias("f"))
    return rare.join(modes, "label").select("label", "n", F.concat(F.lit("Other ("), F.col("l"), F.lit(", "), F.col("f"), F.lit(")")).alias("merged"))


def apply_merge(rows: DataFrame, merged: DataFrame, label: str) -> DataFrame:
    m = merged.select(F.col("label").alias(label), F.col("merged").alias("_m"))
    return rows.join(m, label, "left").withColumn(label, F.coalesce("_m", label)).select(*rows.columns)


def odd_documents(truth: DataFrame, predicted: DataFrame, min_documents: int = 2) -> DataFrame:
    """``predicted`` documents with a reason: a type or a combination of type, layout and category that truth lacks, or another length than the only one that truth has.

    Both have document_type, layout_type, functional_category, page_count; predicted has dossier and head too. reasons are joined by '; '.
    """
    combos = truth.select("document_type", "layout_type", "functional_category").distinct()
    types = combos.select("document_type").distinct().withColumn("_type", F.lit(True))
    fixed = truth.groupBy("document_type").agg(F.min("page_count").alias("_lo"), F.max("page_count").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    fixed = fixed.filter((F.col("_lo") == F.col("_hi")) & (F.col("_n") >= min_documents)).select("document_type", F.col("_lo").alias("_pages"))
    out = predicted.join(types, "document_type", "left").join(combos.withColumn("_combo", F.lit(True)), ["document_type", "layout_type", "functional_category"], "left").join(fixed, "document_type", "left")
    reasons = F.concat_ws("; ", F.when(F.col("_type").isNull(), "unseen type").when(F.col("_combo").isNull(), "unseen combination"),
                          F.when(F.col("_pages") != F.col("page_count"), F.concat(F.lit("always "), F.col("_pages").cast("string"), F.lit(" pages, here "), F.col("page_count").cast("string"))))
    return out.withColumn("reasons", reasons).filter("reasons <> ''").select(*predicted.columns, "reasons")
