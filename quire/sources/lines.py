"""Delimited text in chunks with one header: a folder whose files, one after the other by name, are one table.

Tasks write their own chunks and Spark's committer moves only those of attempts that ended well, so a task that is tried again leaves nothing twice. The header is the one row of the first file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(c: Column, sep: str) -> Column:
    text = c.cast("string")
    special = F.contains(text, F.lit(sep)) | text.rlike('["\r\n]') | (text == "")
    return F.when(text.isNull(), F.lit("")).when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def as_lines(df: DataFrame, sep: str = "\t") -> DataFrame:
    """value: a line for each row. Nulls are empty fields, empty strings quoted ones; quotes inside are doubled."""
    return df.select(F.concat_ws(sep, *[_quoted(F.col(f"`{c}`"), sep) for c in df.columns]).alias("value"))


def write_lines(df: DataFrame, path: str, sep: str = "\t", rows_per_chunk: int = 1_000_000, mode: str = "error") -> None:
    """Writes the rows in chunks of at most ``rows_per_chunk``, after one header; an empty table is the header alone."""
    names = df.sparkSession.createDataFrame([tuple(df.columns)], T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(df.columns))]))
    header = as_lines(names, sep).coalesce(1)  # the first partition, and so the first file
    header.unionAll(as_lines(df, sep)).write.mode(mode).option("maxRecordsPerFile", rows_per_chunk).text(path)


def read_lines(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """The rows of such a folder. Its header is the first line of the first file, told from rows by its file's name alone."""
    kinds = T._parse_datatype_string(schema)
    raw = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", None).option("multiLine", True)
    text = raw.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in kinds.fields])).csv(path)
    first = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1).cast("int") == 0
    return text.filter(~first).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds.fields])
