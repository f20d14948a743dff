"""Secret scans (4): patterns over whole texts, then ownership frequency over the whole corpus.

Every candidate value is hashed; over all documents its distinct repositories and owners are counted.
A value that many owners hold is a copied example, one that few hold looks live. The patterns' own spans
always stay. Long mixed tokens outside them are candidates too, and become spans only where they look live.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import in_parts, table, text_batches, whole_text, written

# The patterns of the base spans, and what they need at least.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.A)  # a run of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}", re.A)  # a run of 24 or more
#: Beyond them: runs with a digit, a capital and a small letter each.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.A)
_MIXED = [re.compile(x) for x in ("[0-9]", "[A-Z]", "[a-z]")]
KINDS = ("assign", "access", "hex", "owned")
#: A value is owner-specific if it has no more owners and repositories than these.
MAX_OWNERS, MAX_REPOSITORIES = 2, 3


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order of start and kind; kind 3 are candidates beyond the base spans."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken = sorted((a, b) for a, _, b, _ in out)
    i = 0
    for m in TOKEN.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if (i == len(taken) or taken[i][0] >= m.end()) and all(p.search(m[0]) for p in _MIXED):
            out.append((m.start(), 3, m.end(), m[0]))
    return sorted(out)


_SPAN = "struct<start: bigint, kind: int, stop: bigint>"
_CANDIDATE = "struct<hash: string, start: bigint, kind: int, stop: bigint>"


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: list[str]) -> DataFrame:
    """A row for each row of ``docs``: row, doc_id, owner, repo and found (hash, start, kind, stop of each candidate)."""

    def scan(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.struct([("hash", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        for b in in_parts(batches):
            found = [
                [{"hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "start": s, "kind": k, "stop": e} for s, k, e, v in find(t)]
                for t in b.column("body").to_pylist()
            ]
            rows = pa.array(range(row, row + len(b)), pa.int64())
            row += len(b)
            yield pa.RecordBatch.from_arrays([rows, b.column("id"), b.column("owner"), b.column("repo"), pa.array(found, kind)], names=["row", "doc_id", "owner", "repo", "found"])

    text_batches(docs.sparkSession)
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), owner.alias("owner"), repo.alias("repo"), whole_text(text_col).alias("body"))
    return rows.mapInArrow(scan, f"row long, doc_id long, owner string, repo string, found array<{_CANDIDATE}>")


def ownership(found: DataFrame) -> DataFrame:
    """A row for each candidate value: hash, owners, repositories, looks_live. Counted over all rows, in two steps, so no value is one task's."""
    places = found.select(F.explode("found.hash").alias("hash"), "owner", "repo").distinct()
    by_owner = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    out = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    return out.withColumn("looks_live", (F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string")))
    return F.array_join(one, ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    n_live and n_example count the base spans whose values look live and those that are copied examples. A null
    or empty text has no span, a long one is searched whole; null owners are one owner; rows that repeat others count as rows, but not as further owners.
    An empty table gives an empty one; other columns take no part, whatever their names.
    """
    found = written(candidates(docs, id_col, text_col, owner_col, list(repo_cols)))
    known = written(ownership(found))  # a table of its own: a hash that is everywhere can then be split where it meets its places
    each = found.select("row", F.explode("found").alias("c")).select("row", "c.*").join(known, "hash")
    span = F.struct("start", "kind", "stop")
    base = F.col("kind") < 3
    per_row = each.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base | F.col("looks_live"), span))).alias("all"),
        F.count_if(base & F.col("looks_live")).alias("n_live"),
        F.count_if(base & ~F.col("looks_live")).alias("n_example"),
    )
    rows = found.join(per_row, "row", "left")
    every = F.coalesce("all", F.array().cast(f"array<{_SPAN}>"))
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_text_of(F.filter(every, lambda x: x["kind"] < 3)), 256).alias("base_sha256"), _text_of(every).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"),
    )


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
