import re

from quire.llm import surrogates as S

TEXT = "Mr John Smith wrote to jo.98@Mail5.Example.COM (JO.98@MAIL5.EXAMPLE.COM), +1 (017) 555-7713, 10.2.30.4, 4111-1111-1111-1111 or 4111111111111111, 123-45-6789, DE89 3704 0044 0532 0130 00; Frau Anna Weber and Mrs. Weber, иван@почта.рф."


def one(spark, docs_of, text, key="k"):
    return S.replace_entities(docs_of(spark, [(1, text)]), key).first()


def test_format_script_gender_and_coreference(spark, docs_of):
    r = one(spark, docs_of, TEXT)
    out = r["text"]
    assert r["n_entities"] == 12
    for gone in ("John", "Smith", "jo.98", "555-7713", "10.2.30.4", "4111", "123-45", "3704", "Anna", "Weber", "иван"):
        assert gone not in out
    low, up = re.search(r"to (\S+) \((\S+)\)", out).groups()
    assert low.lower() == up.lower() and up == up.upper() and re.fullmatch(r"[a-z]{2}\.\d\d@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.COM", low)
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out)
    a, b = re.search(r"(4\d{3}-\d{4}-\d{4}-\d{4}) or (\d{16})", out).groups()
    assert a.replace("-", "") == b
    assert re.search(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", out)
    full, short = re.search(r"Frau \w+(?:ina|ella|ara|issa) (\w+) and Mrs\. (\w+),", out).groups()
    assert full == short
    assert re.search(r"Mr \w+(?:ric|don|ter|vin) \w+ wrote", out) and re.search("[а-я]{4}@[а-я]{5}\\.рф", out)
    assert out == one(spark, docs_of, TEXT)["text"] != one(spark, docs_of, TEXT, "other")["text"]


def test_clean_and_odd_rows_stay(spark, docs_of, odd_rows):
    clean = [(50, "version 3.0 of 2024-01-01 has 12 parts, 9c8b45435718dcc700c184a7 and 3 of 4")]
    got = S.replace_entities(docs_of(spark, odd_rows + clean), "k").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(odd_rows + clean, key=str) and all(r["n_entities"] == 0 for r in got)
    assert S.replace_entities(docs_of(spark, []), "k").count() == 0


def test_collisions_are_hashed_again(spark, docs_of, monkeypatch):
    from pyspark.sql import functions as F

    # a space of 400 cards for 60 of them, and own forms in it (attempts are literals here)
    def tight(kind, norm, attempt, key):
        n = F.pmod(F.xxhash64(norm, attempt), F.lit(400))
        return F.concat(F.lit("40000000000"), F.lpad(n.cast("string"), 5, "0"))

    monkeypatch.setattr(S, "surrogate", tight)
    rows = [(i, f"card 40000000000{i % 60:05d} and 40000000000{(i * 7) % 60:05d}") for i in range(120)] + [(i, f"card 40000000000{i % 60:05d} and 40000000000{(i * 7) % 60:05d}") for i in range(5)]
    got = S.replace_entities(docs_of(spark, rows), "k").collect()
    assert len(got) == len(rows)
    seen = {}
    for (i, before), after in zip(sorted(rows), sorted((r["doc_id"], r["text"]) for r in got)):
        for x, y in zip(re.findall(r"\d{16}", before), re.findall(r"\d{16}", after[1])):
            assert seen.setdefault(x, y) == y
    assert len(seen) == 60 == len(set(seen.values())) and not set(seen) & set(seen.values())


def test_clashing_columns(spark, docs_of):
    from pyspark.sql import functions as F

    df = docs_of(spark, [(1, "a@b.com")]).withColumns({"n_entities": F.lit("x"), "kind": F.lit("y"), "norm": F.lit("z")})
    r = S.replace_entities(df, "k").first()
    assert r["n_entities"] == 1 and (r["kind"], r["norm"]) == ("y", "z")


def test_a_full_space_grows(spark, docs_of, monkeypatch):
    # all two-letter addresses are taken, and there are more names than two syllables make
    monkeypatch.setattr(S, "_SYLLABLES", ["bar", "den"] * 8)
    az = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{az[i // 26]}@{az[i % 26]}.com {az[i // 26]}@{az[i % 26]}.com".upper() + f" and Mr Z{az[i // 26]}{az[i % 26]}, +1 22 {i:03d}") for i in range(600)]
    got = [r["text"] for r in S.replace_entities(docs_of(spark, rows), "k").collect()]
    parts = [re.fullmatch(r"([A-Z]+@[A-Z]\.COM) ([A-Z]+@[A-Z]\.COM) and Mr ([A-Z][a-z]+), (\+\d \d\d \d{3,})", t).groups() for t in got]
    assert all(a == b for a, b, _, _ in parts) and all(len({p[k] for p in parts}) == 600 for k in (0, 2, 3))
    assert not {p[0] for p in parts} & {t.split()[0] for _, t in rows}


def test_many_one_word_names_keep_shared_surnames(spark, docs_of):
    """More surnames than the first space holds; whoever shares one shares the surrogate's."""
    az = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "Q" + az[i // 676 % 26] + az[i // 26 % 26] + az[i % 26] + az[i // 17576]
    rows = [(i, f"Mr {word(i)} met Mrs {word(i)} and Herr Otto {word(i)}") for i in range(20_000)]
    got = S.replace_entities(docs_of(spark, rows), "k").collect()
    names = [re.fullmatch(r"Mr (\w+) met Mrs (\w+) and Herr (\w+) (\w+)", r["text"]).groups() for r in got]
    assert all(a == b == d for a, b, _, d in names) and len({a for a, _, _, _ in names}) == 20_000 and len({c for _, _, c, _ in names}) == 1
    assert not {a for a, _, _, _ in names} & {word(i) for i in range(20_000)}


def test_a_full_format_of_fixed_length_grows(spark, docs_of, monkeypatch):
    # as if digits had two values: 16 network addresses and numbers can't all differ from 300
    real = S._number
    monkeypatch.setattr(S, "_number", lambda h, a, n: real(h, a, n) % 3)
    rows = [(i, f"at 10.0.{i // 100}.{i % 100}") for i in range(300)]
    got = [r["text"] for r in S.replace_entities(docs_of(spark, rows), "k").collect()]
    assert len(set(got)) == 300 and not set(got) & {t for _, t in rows} and all(re.fullmatch(r"at (\d+\.){3,}\d+", t) for t in got)


def test_against_a_plain_search(spark, docs_of, odd_rows):
    """The same mentions as a search of each whole text, everything between them as it was, one surrogate for each entity."""
    import random

    r = random.Random(2)
    bits = ["Mr John Smith", "Frau Anna Weber", "jo@x.org", "10.1.2.3", "123-45-6789", "plain", "\x01", "a\x01b", "4111 1111 1111 1111", "+1 (017) 555-7713", "$1", "\\", "", "\n"]
    rows = [x for x in odd_rows if x[0] is not None] + [(100 + i, " ; ".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(300)]
    got = {}
    for x in S.replace_entities(docs_of(spark, rows), "k").collect():
        got.setdefault(x["doc_id"], []).append((x["text"], x["n_entities"]))
    known = {"Mr John Smith": r"Mr [A-Z]\w+ [A-Z]\w+", "Frau Anna Weber": r"Frau [A-Z]\w+ [A-Z]\w+", "jo@x.org": r"[a-z]+@[a-z]+\.org", "10.1.2.3": r"\d+\.\d+\.\d+\.\d+", "123-45-6789": r"\d{3}-\d\d-\d{4}",
             "4111 1111 1111 1111": r"4\d{3} \d{4} \d{4} \d{4}", "+1 (017) 555-7713": r"\+1 \(\d{3}\) \d{3}-\d{4}"}
    split = re.compile("(" + "|".join(re.escape(k) for k in known) + ")")
    seen = {}
    for i, t in rows:
        parts = split.split(t or "")
        want = re.compile("".join(f"({known[p]})" if k % 2 else re.escape(p) for k, p in enumerate(parts)), re.S)
        text, n = got[i].pop()
        if t is None:
            assert text is None and n == 0
            continue
        m = want.fullmatch(text)
        assert m and n == len(parts) // 2, (t, text)
        for p, g in zip(parts[1::2], m.groups()):
            assert seen.setdefault(p, g) == g != p
    assert len(seen) == len(known) == len(set(seen.values()))


def test_every_title_gives_its_gender(spark, docs_of):
    titles = [(t + dot, g) for g, ts in S._TITLES.items() for x in ts for t in (x, x.upper()) for dot in ("", ".")]
    rows = [(i, f"so {t} Anna{chr(97 + i % 26)}{chr(97 + i // 26)} Weber came") for i, (t, _) in enumerate(titles)]
    got = {r["doc_id"]: r["text"] for r in S.replace_entities(docs_of(spark, rows), "k").collect()}
    surnames = set()
    for i, (t, g) in enumerate(titles):
        given, surname = re.fullmatch(f"so {re.escape(t)} (\\w+) (\\w+) came", got[i]).groups()
        assert given.endswith(tuple(S._ENDINGS[g])), (t, got[i])
        surnames.add(surname)
    assert len(surnames) == 1


def test_a_title_without_gender_doesnt_change_a_name(spark, docs_of):
    rows = [(1, "Frau Anna Weber"), (2, "Dr Anna Weber"), (3, "Prof. Anna Maier"), (4, "Dr Kim Weber"), (5, "Mr Kim Maier"), (6, "Mrs Kim Maier"), (7, "Dr Lou Maier")]
    got = {r["doc_id"]: r["text"].split()[1:] for r in S.replace_entities(docs_of(spark, rows), "k").collect()}
    assert got[1] == got[2] and got[3][0] == got[1][0] and got[4][1] == got[1][1]
    assert got[4][0].endswith(tuple(S._ENDINGS["n"])) and got[5][0].endswith(tuple(S._ENDINGS["m"])) and got[6][0].endswith(tuple(S._ENDINGS["f"])) and got[7][0].endswith(tuple(S._ENDINGS["n"]))


def test_hyphens_and_apostrophes_stay(spark, docs_of):
    got = one(spark, docs_of, "Mrs Mary-Jane Watson-Parker, MR O'NEIL, Mr O'Neil and Mr Parker")["text"]
    assert re.fullmatch(r"Mrs [A-Z][a-z]+-[A-Z][a-z]+(?:ina|ella|ara|issa) [A-Z][a-z]+-[A-Z][a-z]+, MR [A-Z]'[A-Z]+, Mr [A-Z]'[A-Z][a-z]+ and Mr [A-Z][a-z]+", got), got
    assert got.split(", ")[1][3:].lower() == got.split(", ")[2].split(" and ")[0][3:].lower()


def test_no_task_holds_the_texts_without_entities_or_all_copies(spark, docs_of, monkeypatch):
    """With broadcasts off, and an entity that moved in a text with many copies."""
    from pyspark.sql import functions as F

    real = S.surrogate
    monkeypatch.setattr(S, "surrogate", lambda kind, norm, attempt, key: F.when((attempt == 0) & norm.startswith("x"), F.lit("y@b.com")).otherwise(real(kind, norm, attempt, key)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, "no entity" if i % 3 else "copied xa@b.com") for i in range(3000)] + [(5000, "xb@b.com"), (5001, "xa@b.com")]
        out = S.replace_entities(docs_of(spark, rows).repartition(8), "k")
        per = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(per) == 3002 and max(per) < 900
        texts = {r["text"] for r in out.collect()}
        assert len(texts) == 4 and not any("xa@" in t or "xb@" in t for t in texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
