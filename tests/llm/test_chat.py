import hashlib
import json

from pyspark.sql import functions as F

from quire.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    return {r["id"]: r for r in C.link_calls(*C.from_conversations(spark.createDataFrame(rows, TURNS))).collect()}


def test_links_levels_and_canonical_json(spark):
    c = next(c for c in range(1, 999) if all(hashlib.md5(f"{c}:{t}".encode()).hexdigest()[0] > "4" for t in (0, 1, 3)))  # none of these is spoilt
    got = {k.replace(f"{c}:", "1:"): r for k, r in run(spark, [(c, 0, "system", "be kind"), (c, 1, "user", 'say "hi"\n'), (c, 2, "assistant", "hé"), (c, 3, "user", "")]).items()}
    assert [got[f"1:{t}"]["level"] for t in (0, 1, 3)] == [0, 1, 2]
    assert got["1:1"]["json"].replace(f'"id":"{c}:', '"id":"1:') == json.dumps({"arguments": json.dumps({"prompt": 'say "hi"\n', "turn": 1}, separators=(",", ":")), "id": "1:1", "level": 1, "name": "ask", "result": "hé", "valid": True}, separators=(",", ":"), ensure_ascii=False)
    assert got["1:3"]["problems"] == "prompt is below 1" and got["1:0"]["results"] == 0


def test_nulls_repeats_and_orphans(spark):
    assert hashlib.md5(b"1:0").hexdigest()[0] > "4"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "y"), (1, 1, "assistant", "x"), (1, 5, "assistant", "orphan"), (None, 3, "user", "lost"), (2, None, "user", None), (3, 0, None, "no role")]
    got = C.link_calls(*C.from_conversations(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted((r["id"] or "", r["results"]) for r in got) == [("", 0), ("", 0), ("1:0", 2)]
    record = json.loads(next(r["json"] for r in got if r["id"] == "1:0"))
    assert json.loads(record["arguments"])["prompt"] == "a" and record["result"] == "x"
    assert C.link_calls(*C.from_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_levels_of_chains_graphs_and_cycles(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(40)], "id string")
    chain = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 37)] + [("38", "39"), ("39", "38"), ("5", "nobody")], "id string, parent string")
    got = {r["id"]: r["level"] for r in C.levels(ids, chain).collect()}
    assert all(got[str(i)] == i for i in range(37)) and got["37"] == 0 and got["38"] is None and got["39"] is None
    graph = spark.createDataFrame([("2", "0"), ("2", "1"), ("3", "2"), ("3", "0"), ("4", "5"), ("5", "4"), ("6", "4")], "id string, parent string")
    got = {r["id"]: r["level"] for r in C.levels(ids.filter("id < '7' and length(id) = 1"), graph).collect()}
    assert (got["0"], got["1"], got["2"], got["3"], got["4"], got["6"]) == (0, 0, 1, 2, None, None)


def test_arguments_against_schemas(spark):
    schemas = {"f": {"n": ("BIGINT", 2), "s": ("STRING", 1)}}
    cases = {'{"n":3,"s":"x"}': "", '{"n":1,"s":"x"}': "n is below 2", '{"n":"3","s":""}': "n is not BIGINT; s is below 1", '{"s":"x"}': "n is missing", '{"n":2,"s":"x","z":1,"a":2}': "unknown: a,z", "[1]": "no JSON object", "oops": "no JSON object"}
    df = spark.createDataFrame([("f", a) for a in cases] + [("g", "{}")], "name string, arguments string")
    got = df.select("name", "arguments", C.problems(F.col("name"), F.col("arguments"), schemas).alias("p")).collect()
    assert {r["arguments"]: r["p"] for r in got if r["name"] == "f"} == cases
    assert [r["p"] for r in got if r["name"] == "g"] == ["unknown call"]


def test_spoilt_calls_are_found(spark):
    got = run(spark, [(c, 0, "user", "hello") for c in range(300)])
    want = {"0": "no JSON object", "1": "turn is not BIGINT", "2": "prompt is missing", "3": "unknown: urgent", "4": "unknown call"}
    digit = {k: hashlib.md5(k.encode()).hexdigest()[0] for k in got}
    assert all(r["problems"] == want.get(digit[k], "") for k, r in got.items()) and len({r["problems"] for r in got.values()}) == 6


def test_columns_that_clash(spark):
    """Further columns of the tables, named like the operator's own, change nothing."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for c in range(5) for t in range(6)]
    plain = spark.createDataFrame(rows, TURNS)
    more = plain.select("*", *[F.lit("mine").alias(n) for n in ("id", "name", "level", "parent", "arguments", "content", "_before", "problems", "results", "json")])
    one, two = (sorted(map(tuple, C.link_calls(*C.from_conversations(df)).collect())) for df in (plain, more))
    assert one == two and len(one) == 15
