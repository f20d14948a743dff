"""Mixing sources to target weights (2): Poisson replication.

Each source has a mean repetition rate: its share of the wanted budget over its size. A document's count is
the inverse of the Poisson distribution with that mean at a uniform number hashed from its id, so the same
seed always gives the same copies. Documents are exploded by their counts and dealt out anew by a hash of
id and copy, which shuffles the corpus globally and splits any hot source evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fits, guarded, partitions, table, whole_text

#: Share of a source: its size to this power (1: as it is, 0: all sources alike).
TEMPERATURE = 0.7
#: Means above this are split, and the counts of the parts added up: e^-mean must stay a normal double, and the sum of terms short.
MAX_RATE = 64.0
_TERMS = 200


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The least k with P(Poisson(mean) <= k) > u; 0 for a null mean or one not above 0; means up to MAX_RATE.

    The terms of the distribution are summed in order, at most _TERMS of them, which for these means leaves
    less than 1e-30 of the probability.
    """
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("below"))

    def step(acc, i):
        done = acc["below"] > u
        term = acc["term"] * mean / i
        return F.struct(
            F.when(done, acc["k"]).otherwise(i).alias("k"),
            F.when(done, acc["term"]).otherwise(term).alias("term"),
            F.when(done, acc["below"]).otherwise(acc["below"] + term).alias("below"),
        )

    # as many terms as this mean can need: beyond mean + 12 sqrt(mean) + 12 no double u < 1 reaches
    terms = F.least(F.lit(_TERMS), F.ceil(mean + 12 * F.sqrt(mean) + 12).cast("int"))
    k = F.aggregate(F.sequence(F.lit(1), terms), start, step)["k"]
    return F.when(mean > 0, k).otherwise(F.lit(0))


def counts(name: Column, seed: str, rate: Column) -> Column:
    """The Poisson count of a row: means above MAX_RATE are split evenly and the counts of the parts, each by its own hash, added up."""
    parts = F.ceil(rate / MAX_RATE).cast("int")
    one = lambda i: poisson_inverse(uniform(name, F.lit(seed), i.cast("string")), rate / parts)
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0).cast("long"), lambda acc, i: acc + one(i))
    return F.when(rate > MAX_RATE, many).otherwise(poisson_inverse(uniform(name, F.lit(seed)), rate))


def rates(docs: DataFrame, targets: DataFrame | None = None, budget: float = 1.0, source_col: str = "source",
          text_col: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """A row for each source (null is one too): source, size (characters), weight (sums to 1), rate.

    ``targets`` holds source and weight (not negative; sources it lacks have weight 0); without it a source weighs
    its size to the power of ``temperature``. ``budget`` is the size wanted over the present one. Sources
    without text have rate 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(whole_text(text_col))).alias("size"))
    if targets is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        t = targets.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(t, sizes["source"].eqNullSafe(t["_s"]), "left").drop("_s")
        weighed = weighed.withColumn("weight", F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(0.0))))
    total = weighed.agg(F.sum("size").alias("_all"), F.sum("weight").alias("_weights"))
    out = weighed.crossJoin(F.broadcast(total))  # one row
    out = out.withColumn("weight", F.when(F.col("_weights") > 0, F.col("weight") / F.col("_weights")).otherwise(0.0))
    rate = F.when(F.col("size") > 0, F.lit(float(budget)) * F.col("weight") * F.col("_all") / F.col("size")).otherwise(0.0)
    return out.select("source", "size", "weight", rate.alias("rate"))


def replicate(docs: DataFrame, source_rates: DataFrame, seed: str = "mix", id_col: str = "doc_id",
              source_col: str = "source", shuffle: bool = True) -> DataFrame:
    """Every row as often as its count says, with _copy (from 0), _copies, _rate and _order added.

    Rows that repeat an id get the same count each, and so do rows with a null id (one of their source's mean; it is hashed as an empty one). Texts play no part here.
    The order is global: ascending _order (a hash of id and copy), uniform in [0, 1), of which each partition holds an equal range; that needs no sampling of the rows.
    """
    spark = docs.sparkSession
    r = source_rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    if fits(r.count(), 200):
        r = F.broadcast(r)
    out = docs.join(r, docs[source_col].eqNullSafe(r["_source"]), "left").drop("_source")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    out = out.withColumn("_copies", counts(name, seed, F.col("_rate")))
    out = out.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    out = out.withColumn("_order", uniform(name, F.col("_copy").cast("string"), F.lit(seed + ":order")))
    if not shuffle:
        return out
    n = partitions(spark)
    return out.repartitionById(n, F.floor(F.col("_order") * n).cast("int")).sortWithinPartitions("_order")


def mix(docs: DataFrame, targets: DataFrame | None = None, budget: float = 1.0, seed: str = "mix", id_col: str = "doc_id",
        source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """The mixed corpus in its new order, with the columns of ``docs``. Empty tables give empty ones."""
    base, at = guarded(docs)
    r = rates(base, targets, budget, at[source_col], at[text_col], temperature)
    return replicate(base, r, seed, at[id_col], at[source_col]).select(*base.columns).toDF(*docs.columns)


def op2_poisson_mixing(spark, sf_dir: str) -> DataFrame:
    """A row for each copy: doc_id, source, copy, copies, rate (8 digits), sort_key (in whose order the copies lie)."""
    docs = table(spark, sf_dir, "documents")
    r = rates(docs)
    out = replicate(docs.select("doc_id", "source"), r)
    return out.select("doc_id", "source", F.col("_copy").cast("long").alias("copy"), F.col("_copies").cast("long").alias("copies"),
                      F.round("_rate", 8).alias("rate"), F.round("_order", 12).alias("sort_key"))


# parts: a rate above MAX_RATE is that of several counts, each with its own hash; part 0 is the only one of a smaller rate.
OP2_SQL = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, pow(size, {TEMPERATURE}) AS w FROM sizes),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN (w / (SELECT sum(w) FROM weighed)) * (SELECT sum(size) FROM weighed) / size ELSE 0 END AS rate FROM weighed),
parted AS (SELECT source, rate, greatest(1, ceil(rate / {MAX_RATE}))::BIGINT AS parts FROM rates WHERE rate > 0),
terms AS (
  SELECT source, rate, parts, k, CASE WHEN k = 0 THEN exp(-rate / parts) ELSE exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)) END AS p
  FROM parted, range(0, {_TERMS}) r(k)),
cdf AS (SELECT source, rate, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
drawn AS (
  SELECT d.doc_id, d.source, p.rate, part, ('0x' || substr(md5(d.doc_id || '|mix' || CASE WHEN p.parts = 1 THEN '' ELSE '|' || part END), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u
  FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.parts + 1) r(part)),
found AS (
  SELECT d.doc_id, d.source, d.rate, d.part, min(c.k) AS k
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.below > d.u
  GROUP BY d.doc_id, d.source, d.rate, d.part),
counted AS (SELECT doc_id, source, rate, sum(k)::BIGINT AS copies FROM found GROUP BY doc_id, source, rate)
SELECT doc_id, source, copy, copies, round(rate, 8) AS rate,
       round(('0x' || substr(md5(doc_id || '|' || copy || '|mix:order'), 1, 13))::BIGINT / 4503599627370496::DOUBLE, 12) AS sort_key
FROM counted, range(0, copies) c(copy)
"""
