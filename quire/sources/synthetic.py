"""Synthetic dossiers of any number, by hashes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.hashing import pick, uniform

TYPES = ["Form", "Letter", "Receipt", "Photo"]

# Documents of a dossier, from and to; the chances of 1, 2, 3 and 4 pages.
DOCUMENTS, LENGTH_CHANCES = (3, 7), [0.5, 0.3, 0.15, 0.05]


def dossiers(spark: SparkSession, n: int, seed: str = "0", types: list[str] = TYPES) -> DataFrame:
    """dossier, page_num, document_type, start_page, split: 3 to 7 documents a dossier, of 1 to 4 pages with chances .5, .3, .15, .05."""
    d = spark.range(n).select(F.format_string("pdf_%05d", F.col("id").cast("int")).alias("dossier"))
    key = lambda *c: uniform(F.lit(seed), "dossier", *c)
    d = d.withColumn("doc", F.explode(F.sequence(F.lit(1), (DOCUMENTS[0] + F.floor(key(F.lit("n")) * (DOCUMENTS[1] - DOCUMENTS[0] + 1))).cast("int"))))
    u = key(F.lit("len"), "doc")
    length = F.lit(len(LENGTH_CHANCES))
    for n in range(len(LENGTH_CHANCES) - 1, 0, -1):
        length = F.when(u < round(sum(LENGTH_CHANCES[:n]), 10), n).otherwise(length)
    d = d.withColumns({"document_type": pick(key(F.lit("type"), "doc"), types), "p": F.explode(F.sequence(F.lit(1), length))})
    from pyspark.sql import Window

    page = F.row_number().over(Window.partitionBy("dossier").orderBy("doc", "p"))
    s = key(F.lit("split"))
    split = F.when(s < 0.7, "train").when(s < 0.85, "val").otherwise("test")
    return d.select("dossier", page.alias("page_num"), "document_type", F.when(F.col("p") == 1, "yes").otherwise("no").alias("start_page"), split.alias("split"))


def page_xml(lines: list[str]) -> str:
    """A PageXML document of these lines."""
    from xml.sax.saxutils import escape

    body = "".join(f"<TextLine><TextEquiv><Unicode>{escape(x)}</Unicode></TextEquiv></TextLine>" for x in lines)
    return f'<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page><TextRegion>{body}</TextRegion></Page></PcGts>'
