"""Page tables made of the generic tables, so that every operator has rows to run on. Noise comes from hashes: the same on any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.hashing import pick, uniform
from quire.operators.ranking import dealt

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
ROLES = ["assistant", "system", "user"]
LAYOUTS = ["Form", "Letter", "Other"]
CATEGORIES = ["Administrative", "Medical", "Personal"]
LANGUAGES = ["de", "en", "es", "fr"]
#: Rows of these tables that a task windows over.
EVENTS_A_TASK, LINES_A_TASK = 100_000, 400_000
ANNOTATORS = ["a1", "a2", "a3", "a4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u(column: str, salt: str):
    return uniform(column, F.lit(salt))


def start_score(pred, row: str = "row_id"):
    """The probability of a start in all its digits: from 0.5 on where one is predicted."""
    p = u(row, "sp")
    return F.when(pred == "yes", 0.5 + 0.5 * p).otherwise(0.5 * p)


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order as a dossier's pages, with noisy predictions and confidences."""
    e = dealt(table(spark, sf_dir, "events").withColumn("dossier", F.col("user_id").cast("string")), "dossier", EVENTS_A_TASK)
    i = "event_id"
    start = F.when((F.col("event_type") == "signup") | (u(i, "start") < 0.3), "yes").otherwise("no")
    flipped = F.when(start == "yes", "no").otherwise("yes")
    pred = F.when(u(i, "flip") < 0.1, flipped).otherwise(start)
    kind = F.when(u(i, "noise") < 0.15, pick(u(i, "alt"), EVENT_TYPES)).otherwise(F.col("event_type"))
    return e.select(
        "dossier", F.row_number().over(Window.partitionBy("dossier").orderBy("ts", i)).alias("page_num"), F.col(i).alias("row_id"),
        F.col("event_type").alias("document_type"), start.alias("start_page"), pred.alias("predicted_start_page"), kind.alias("predicted_document_type"),
        F.round(0.2 + 0.8 * u(i, "conf"), 6).alias("document_type_confidence"), F.round(start_score(pred, i), 6).alias("start_probability"),
        "value", "ts")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as pages; the user's start documents. Predictions flip a tenth of the flags."""
    c = table(spark, sf_dir, "conversations")
    key = uniform("conv_id", "turn", F.lit("flip"))
    start = F.when(F.col("role") == "user", "yes").otherwise("no")
    flipped = F.when(start == "yes", "no").otherwise("yes")
    return c.select(F.col("conv_id").cast("string").alias("dossier"), F.col("turn").cast("int").alias("page_num"), F.col("role").alias("document_type"), start.alias("start_page"),
                    F.when(key < 0.1, flipped).otherwise(start).alias("predicted_start_page"), uniform("conv_id", "turn", F.lit("score")).alias("noise"))


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as pages, typed by their flags."""
    x = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", LINES_A_TASK)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    key = uniform("l_orderkey", "l_partkey", "l_suppkey", F.lit("start"))
    return x.select(F.col("l_orderkey").alias("dossier"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("page_num"),
                    F.concat("l_returnflag", "l_linestatus").alias("document_type"), F.when(key < 0.4, "yes").otherwise("no").alias("start_page"),
                    F.when(uniform("l_orderkey", "l_partkey", "l_suppkey", F.lit("pred")) < 0.4, "yes").otherwise("no").alias("predicted_start_page"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages that up to four annotators label, with noise, gaps and other spellings."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("pdf"), F.col("doc_id").alias("page_num"), "lang")
    d = d.withColumn("a", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in ANNOTATORS]).alias("n"), F.array(*[F.lit(i) for i in range(4)]).alias("o"))))
    d = d.select("pdf", "page_num", "lang", F.col("a.n").alias("annotator"), F.col("a.o").alias("annotator_order"))
    k = lambda salt: uniform("page_num", "annotator", F.lit(salt))
    own = lambda salt: uniform("page_num", F.lit(salt))
    d = d.filter(k("has") < 0.7)
    kind = F.when(k("null") < 0.1, F.lit(None)).when(k("noise") < 0.2, pick(k("alt"), LANGUAGES)).otherwise(F.col("lang"))
    kind = F.when(k("case") < 0.15, F.upper(kind)).otherwise(kind)
    layout = F.when(k("lnoise") < 0.1, pick(k("lalt"), LAYOUTS)).otherwise(pick(own("layout"), LAYOUTS))
    category = F.when(k("cnoise") < 0.1, pick(k("calt"), CATEGORIES)).otherwise(pick(own("category"), CATEGORIES))
    start = F.when((own("start") < 0.5) != (k("snoise") < 0.1), "yes").otherwise("no")
    return d.select("pdf", "page_num", "annotator", "annotator_order", kind.alias("document_type"), layout.alias("layout_type"), category.alias("functional_category"), start.alias("start_page"))


def typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as labelled rows: type, layout, category, split."""
    p = table(spark, sf_dir, "part")
    split = F.when(u("p_partkey", "split") < 0.7, "train").when(u("p_partkey", "split") < 0.85, "val").otherwise("test")
    return p.select(F.col("p_partkey").alias("row_id"), F.concat_ws(" ", "p_type", "p_brand").alias("document_type"), F.col("p_brand").alias("layout_type"), F.col("p_type").alias("functional_category"),
                    F.col("p_size").alias("pdf"), split.alias("split"))


def dossier_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dossiers of a year, with persons and lines as documents."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dossier"), F.year("o_orderdate").alias("travel_year"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dossier")).agg(
        F.count(F.lit(1)).alias("num_docs"), F.count_if(F.col("l_returnflag") == "A").alias("n_a"), F.count_if(F.col("l_returnflag") == "N").alias("n_n"), F.count_if(F.col("l_returnflag") == "R").alias("n_r"))
    persons = 1 + F.floor(u("dossier", "persons") * 5)
    adults16 = 1 + F.floor(u("dossier", "a16") * persons)
    adults18 = F.greatest(F.lit(1), adults16 - F.floor(u("dossier", "a18") * 2))
    return o.join(n, "dossier").withColumns({"num_persons": persons.cast("int"), "num_16": adults16.cast("int"), "num_18": adults18.cast("int")})


def two_models(spark: SparkSession, sf_dir: str, salt: str) -> DataFrame:
    """A model's probabilities of the ten labels for each vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    raw = [F.round(uniform("vec_id", F.lit(f"{salt}{k}")) + F.when(F.col("label") == k, 0.6).otherwise(0.0), 9) for k in range(10)]
    e = e.withColumn("raw", F.array(*raw))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", "label", F.transform("raw", lambda x: x / total).alias("probs"))
