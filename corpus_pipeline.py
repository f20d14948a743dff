"""A corpus from raw documents: toxic ones go, then copies, then near copies; sources are mixed and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Between stages rows lie in a
written table, so a lost executor costs only its own stage's tasks.

In every stage a null text is an empty one (but stays null in the rows that go on), texts are read whole, an empty table gives an
empty one, rows that repeat each other are rows of their own until a stage drops them, and further columns of any name go along (packing returns its own columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, mixing, packing, shingle_join, toxicity
from quire.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a model of the labelled ones among them; all of them if no labels of both classes are left to learn from. Rows with a null id are scored too."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null id is smaller than all. Of rows that tie, with the same id and text, one stays. All empty and null texts are equal."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the least id, one row of those that repeat it. Rows with a null id, which no other row can be told from by its id, and rows without words all stay."""
    return shingle_join.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight has it, a null source being one too and sources without text dropping out. Rows with a null id, or the same id, have the same count."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies in windows of 4096 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length. A text without tokens is its end id."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("shingle_join", near), ("mixing", mix), ("packing", pack)]

#: A trained model, set similarity and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
