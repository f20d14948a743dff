import math

from pyspark.sql import functions as F

from quire.llm import mixing as M


def inverse(u, mean):
    k, term = 0, math.exp(-mean)
    below = term
    while below <= u and k < M._TERMS:
        k += 1
        term *= mean / k
        below += term
    return k


def test_poisson_inverse(spark):
    rows = [(u, m) for u in (0.0, 0.1, 0.5, 0.9, 0.999, 0.9999999) for m in (0.0, 0.01, 0.7, 3.0, 20.0, 64.0)]
    got = spark.createDataFrame(rows, "u double, m double").select("u", "m", M.poisson_inverse(F.col("u"), F.col("m")).alias("k")).collect()
    assert all(r["k"] == (inverse(r["u"], r["m"]) if r["m"] else 0) for r in got)


def test_rates_reach_the_targets(spark, docs_of):
    df = docs_of(spark, [(i, "x" * (1 + i % 9)) for i in range(4000)], lambda i: "hot" if i % 3 else "cold")
    targets = spark.createDataFrame([("hot", 1.0), ("cold", 3.0)], "source string, weight double")
    out = M.mix(df, targets, budget=2.0)
    sizes = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    whole = df.agg(F.sum(F.length("text"))).first()[0]
    assert abs(sizes["cold"] / (sizes["cold"] + sizes["hot"]) - 0.75) < 0.03 and abs(sum(sizes.values()) / whole - 2) < 0.1
    assert out.columns == df.columns


def test_same_seed_same_copies(spark, docs_of, odd_rows):
    plain = docs_of(spark, odd_rows)
    a, b = M.mix(plain, budget=3.0).collect(), M.mix(plain.repartition(3), budget=3.0).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) > 0
    assert M.mix(plain.filter("false")).count() == 0


def test_rows_lie_in_the_order_of_their_hashes(spark, docs_of):
    df = docs_of(spark, [(i, f"text {i}") for i in range(500)])
    out = M.replicate(df, M.rates(df, budget=2.0))
    got = [r["_order"] for r in out.collect()]
    assert got == sorted(got) and len(got) > 700
    own = out.withColumn("_part", F.spark_partition_id()).groupBy("_part").count().collect()
    assert len(own) == 4 and max(r["count"] for r in own) < 1.3 * len(got) / 4
    assert [r["doc_id"] for r in M.mix(df, budget=2.0).collect()] == [r["doc_id"] for r in out.collect()]


def test_columns_that_clash(spark, docs_of, odd_rows):
    names = ["_rate", "_copies", "_copy", "_order", "_source", "rate", "size", "weight", "c0", "c1"]
    df = docs_of(spark, odd_rows).select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    out = M.mix(df, budget=3.0)
    assert out.columns == df.columns
    plain = M.mix(docs_of(spark, odd_rows), budget=3.0).collect()
    got = out.collect()
    assert [tuple(r)[:5] for r in got] == [tuple(r) for r in plain]
    assert all(r[n] == f"{n}{'-' if r['doc_id'] is None else r['doc_id']}" for r in got for n in names)


def test_a_rate_of_five_hundred(spark, docs_of):
    df = docs_of(spark, [(i, "x" * 10) for i in range(1000)], lambda i: "one" if i == 0 else "rest")
    targets = spark.createDataFrame([("one", 1.0), ("rest", 1.0)], "source string, weight double")
    r = M.rates(df, targets)
    assert {x["source"]: round(x["rate"], 6) for x in r.collect()}["one"] == 500.0
    n = M.replicate(df, r).filter("source = 'one'").count()
    parts = math.ceil(500 / M.MAX_RATE)
    import hashlib

    u = lambda i: int(hashlib.md5(f"0|mix|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    assert n == sum(inverse(u(i), 500 / parts) for i in range(1, parts + 1)) and abs(n - 500) < 100


def test_sql_states_rates_above_the_split(spark, docs_of, tmp_path):
    """The registered SQL and the operator agree where a source's rate is above the split."""
    import duckdb

    df = docs_of(spark, [(i, "x" * 10) for i in range(3)] + [(i, "word " * 400) for i in range(3, 40000)], lambda i: "small" if i < 3 else "large")
    r = M.rates(df)
    assert max(x["rate"] for x in r.collect()) > M.MAX_RATE
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, source, copy, copies, rate, sort_key FROM ({M.OP2_SQL}) WHERE source = 'small'").fetchall()
    got = M.op2_poisson_mixing(spark, str(tmp_path)).filter("source = 'small'").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3 * 64


def test_null_source_and_empty_source(spark, docs_of):
    df = docs_of(spark, [(i, "text") for i in range(200)] + [(i, "") for i in range(200, 210)], lambda i: None if i < 200 else "empty")
    r = {x["source"]: x["rate"] for x in M.rates(df).collect()}
    assert r[None] > 0 and r["empty"] == 0
    assert {x["source"] for x in M.mix(df).collect()} == {None}


def test_rates_above_the_split(spark, docs_of):
    df = docs_of(spark, [(i, "x" * 10) for i in range(8000)], lambda i: "small" if i < 40 else "large")
    targets = spark.createDataFrame([("small", 1.0), ("large", 1.0)], "source string, weight double")
    r = M.rates(df, targets)
    assert {x["source"]: round(x["rate"], 6) for x in r.collect()} == {"small": 100.0, "large": round(4000 / 7960, 6)}
    got = M.replicate(df, r).filter("source = 'small'").groupBy("doc_id").agg(F.max("_copies").alias("n"), F.count_distinct("_copy").alias("c")).collect()
    n = [x["n"] for x in got]
    assert len(n) == 40 and all(x["n"] == x["c"] for x in got) and abs(sum(n) / 40 - 100) < 8 and 40 < sum((x - 100) ** 2 for x in n) / 40 < 220
    assert abs(M.mix(df, targets).count() / 8000 - 1) < 0.05
