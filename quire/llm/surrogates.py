"""PII surrogates (10): detected entities get keyed, type-consistent replacements.

Native: DataFrame functions only. An entity's normal form (digits of a phone number, an address in small letters) is hashed
with a secret key; the hash fills the form anew, letter for letter of the same script, digit for digit, name for name of the
same gender. All mentions of an entity get the same surrogate, in the format and case of the mention. A name consists of words that
are entities of their own (surnames, and given names by gender), so that people who share a surname still do. Over the whole corpus
no two entities may share a surrogate and none may be an entity's own form: those that do are hashed again, into a larger space each few attempts.

Texts are searched once: what lies between mentions, and these, are written down as the parts of a text, and later steps read the parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fits, guarded, table, whole_text, written

_TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"],
    "n": ["Dr", "Prof"],
}
#: Longer ones first: none is taken for the beginning of another.
_TITLE = "(?:" + "|".join(sorted((x for ts in _TITLES.values() for t in ts for x in (t, t.upper())), key=len, reverse=True)) + r")\.?"
#: Types in the order in which they are tried at a place of the text (Java's regular expressions).
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?\.\p{L}{2,}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\p{L}\d-])",
    "phone": r"(?<![\p{L}\d+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\d]|-\d)",
    "ip": r"(?<![\p{L}\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\d]|\.\d)",
    "card": r"(?<![\p{L}\d-])\d{4}(?:[ -]?\d{4}){2}(?:[ -]?\d{1,4}){1,2}(?![\p{L}\d]|-\d)",
    "name": r"(?<![\p{L}\p{N}])" + _TITLE + r" \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these hold no entity: this spares them the patterns.
_GUARD = r"[@\d]|" + _TITLE + " "
#: Hex digits as letters, by script.
_LETTERS = {r"\p{IsCyrillic}": "аеиоустнрлвкмдпб", r"\p{IsGreek}": "αειουτνσρλκμπδθγ", r"\p{L}": "etaoinshrdlucmfw"}
_HEX = "0123456789abcdef"
_SYLLABLES = ["bar", "den", "fal", "gor", "hin", "jol", "kes", "lam", "mor", "nel", "pir", "ros", "sil", "tav", "ven", "wol"]
_ENDINGS = {"m": ["ric", "don", "ter", "vin"], "f": ["ina", "ella", "ara", "issa"], "n": ["en", "ay", "el", "ie"], "s": ["berg", "man", "field", "son"]}
#: Attempts after which a surrogate gets one more syllable, letter, digit or octet: no number of entities fills all spaces.
GROWS_AFTER = 3
#: Parts into which copies of one text are dealt where a shuffle brings them together.
_SALTS = 16
#: Parts a text by its mentions.
_MARK = "\u0001"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def kind_of(value: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def normal(value: Column, kind: Column) -> Column:
    """What all mentions of an entity have in common. A name's holds its gender: 'f|anna weber'."""

    def name(title):
        gender = reduce(lambda o, g: F.when(F.initcap(title).isin(*_TITLES[g]), g).otherwise(o), ("f", "m"), F.lit("n"))
        return F.concat(gender, F.lit("|"), F.lower(F.regexp_replace(value, f"^{_TITLE} ", "")))

    title = F.regexp_replace(F.regexp_extract(value, f"^{_TITLE}", 0), r"\.$", "")
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, r"\D", ""))
            .when(kind == "iban", F.replace(value, F.lit(" "))).when(kind == "name", _let(title, name)).otherwise(F.lower(value)))


def _fill(form: Column, hexes: Column, keep: Column | int = 0) -> Column:
    """Letters and digits of the form, but for its first ``keep`` characters, by the hash, the same class for each."""

    def one(c, i):
        def by(h):
            out = F.when(c.rlike(r"\d"), F.translate(h, "abcdef", "012345"))
            for script, letters in _LETTERS.items():
                letter = F.translate(h, _HEX, letters)
                out = out.when(c.rlike(script), F.when(c == F.upper(c), F.upper(letter)).otherwise(letter))
            return out.otherwise(c)

        return F.when(i < keep, c).otherwise(_let(F.substring(hexes, (i % 128) + 1, F.lit(1)), by))

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _number(hexes: Column, at: Column | int, n: Column | int) -> Column:
    return F.conv(F.substring(hexes, at, n), 16, 10).cast("int")


def _more(attempt: Column) -> Column:
    """How many syllables, letters or digits an attempt adds: a full space gives way to a larger one."""
    return F.floor(attempt / GROWS_AFTER).cast("int")


def _longer(form: Column, more: Column) -> Column:
    """The form with its first letter repeated in front."""
    lead = F.substring(form, 1, 1)
    return F.when(more > 0, F.concat(F.repeat(F.when(lead.rlike(r"\p{L}"), lead).otherwise("a"), more), form)).otherwise(form)


def units(kind: Column, norm: Column) -> Column:
    """What gets surrogates of its own in a mention: (kind, norm) of each word of a name, its surname last, or of the entity itself."""

    def words(t):
        last = F.size(t) - 2  # the first is the gender
        one = lambda w, i: F.struct(F.when(i == last, "surname").otherwise(F.concat(F.lit("given_"), t[0])).alias("kind"), w.alias("norm"))
        return F.transform(F.slice(t, F.lit(2), F.size(t)), one)

    return F.when(kind == "name", _let(F.split(norm, "[| ]"), words)).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"))))


def _word(kind: Column, word: Column, hexes: Column, more: Column) -> Column:
    """A name's word: two syllables and an ending of the gender, or three and a surname's."""
    at = lambda k: F.element_at(F.array(*[F.lit(s) for s in _SYLLABLES]), _number(hexes, k, F.lit(1)) + 1)
    added = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda k: at(k % 100 + 16)), "")).otherwise("")
    last = kind == "surname"
    lists = F.create_map(*[x for g, e in _ENDINGS.items() for x in (F.lit(g), F.array(*[F.lit(s) for s in e]))])
    ending = F.element_at(lists, F.when(last, F.lit("s")).otherwise(F.substring(kind, 7, 1)))
    latin = F.concat(at(F.lit(1)), at(F.lit(2)), F.when(last, at(F.lit(3))).otherwise(F.lit("")), added, F.element_at(ending, _number(hexes, 9, 1) % 4 + 1))
    # what stands before hyphens and apostrophes gets syllables of its own, a single letter a letter
    ahead = F.transform(F.regexp_extract_all(word, F.lit(r"[^'-]*['-]"), F.lit(0)), lambda p, i: F.concat(
        F.when(F.length(p) < 2, "").when(F.length(p) == 2, F.substring(at(2 * i % 80 + 20), 1, 1)).otherwise(F.concat(at(2 * i % 80 + 20), at(2 * i % 80 + 21))), F.substring(p, -1, 1)))
    latin = F.concat(F.array_join(ahead, ""), F.when(word.rlike("['-]$"), "").otherwise(latin))
    return F.when(word.rlike(r"^[\p{IsLatin}'-]+$"), latin).otherwise(_fill(_longer(word, more), hexes))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit's normal form, itself one. Country codes, first card digits and top-level domains stay."""
    of = lambda *what: F.sha2(F.concat_ws("|", F.lit(key), *what), 512)  # noqa: E731  128 hex digits
    more = _more(attempt)

    def by(hexes):
        octet = lambda i: (_number(hexes, i * 4 % 120 + 1, 4) % 254 + 1).cast("string")
        octets = F.array_join(F.transform(F.sequence(F.lit(0), more + 3), octet), ".")
        email = F.concat(_fill(_longer(F.regexp_replace(norm, r"[^.]*$", ""), more), hexes), F.regexp_extract(norm, r"[^.]*$", 0))
        keep = (F.when(kind == "phone", F.greatest(F.length(norm) - 10, F.lit(0))).when(kind == "iban", 2).when(kind == "card", 1).otherwise(0))
        longer = F.concat(norm, F.repeat(F.lit("0"), more))
        return (F.when(kind == "email", email).when(kind == "ip", octets).when((kind == "surname") | kind.startswith("given_"), _word(kind, norm, hexes, more))
                .otherwise(_let(keep, lambda k: _fill(longer, hexes, k))))

    return _let(of(kind, norm, attempt.cast("string")), by)


def restore(value: Column, kind: Column, found: Column) -> Column:
    """The surrogate in the format of the mention: separators, case, title."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc, c):
        used = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc["out"], F.when(used, F.substring(found, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + used.cast("int")).alias("at"))

    walked = F.aggregate(F.split(value, ""), start, step, lambda acc: F.concat(acc["out"], F.substring(found, acc["at"], F.length(found))))
    front = F.concat(F.repeat(F.substring(value, 1, 1), F.greatest(F.length(found) - F.length(value), F.lit(0))), value)  # as long as what was found
    cased = F.zip_with(F.split(front, ""), F.split(found, ""), lambda v, s: F.when((v != F.lower(v)) & v.isNotNull(), F.upper(s)).otherwise(s))
    name = F.substring(found, F.lit(3), F.length(found))
    shouted = (value == F.upper(value)) & (value != F.lower(value))
    capital = F.array_join(F.transform(F.split(name, "(?<=[-' ])"), F.initcap), "")
    titled = F.concat(F.regexp_extract(value, f"^{_TITLE} ", 0), F.when(shouted, F.upper(name)).otherwise(capital))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), walked).when(kind == "name", titled).when(kind == "email", F.array_join(cased, "")).otherwise(found)


def _replaced(values: Column, tries, key: str) -> Column:
    """The surrogates of mentions; tries(i, j, kind) is the kind and the attempt of the j-th unit of the i-th. Step by step, so that no step computes another's part again."""
    out = F.transform(values, lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))
    out = F.transform(out, lambda e: F.struct(e["v"].alias("v"), e["kind"].alias("kind"), normal(e["v"], e["kind"]).alias("norm")))
    out = F.transform(out, lambda e: F.struct(e["v"].alias("v"), e["kind"].alias("kind"), e["norm"].alias("norm"), units(e["kind"], e["norm"]).alias("units")))

    def fresh(e, i):
        new = F.array_join(F.transform(e["units"], lambda x, j: surrogate(*(lambda kind, attempt: (kind, x["norm"], attempt))(*tries(i, j, x["kind"])), key)), " ")
        return F.struct(e["v"].alias("v"), e["kind"].alias("kind"), F.when(e["kind"] == "name", F.concat(F.substring(e["norm"], 1, 2), new)).otherwise(new).alias("new"))

    return F.transform(F.transform(out, fresh), lambda e: restore(e["v"], e["kind"], e["new"]))


def parts_of(text: Column) -> Column:
    """The text in parts, every other one (from the second on) a mention; null without mentions. One search, but for texts that hold the mark itself."""
    marked = F.split(F.regexp_replace(text, f"({ANY})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    zipped = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("v")), lambda x: F.when(x["v"].isNull(), F.array(x["g"])).otherwise(F.array(x["g"], x["v"]))))
    parts = F.when(text.contains(_MARK), zipped).otherwise(marked)
    return F.when(text.rlike(_GUARD), _let(parts, lambda p: F.when(F.size(p) > 1, p)))


def _mentions(parts: Column) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == 1)


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, attempt of the entities whose first surrogate can't stay. ``entities`` holds each kind and norm once.

    Of entities with the same surrogate the least keeps it; one that is some entity's own form goes. The others
    hash again, against each other and all that is settled, until none is left; only they are computed and written in later rounds. Later attempts draw from larger spaces.
    """
    settled, moved, left, attempt = None, None, entities, 0
    own = entities.select("kind", F.col("norm").alias("sur"))
    while True:
        tried = written(left.select("kind", "norm", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key).alias("sur")))
        first = tried.groupBy("kind", "sur").agg(F.min("norm").alias("norm"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("kind", "sur", F.col("norm").alias("first"))
        taken = own if settled is None else own.unionByName(settled)
        n = tried.count() if attempt else None  # later rounds are small, and then go to the settled ones
        side = F.broadcast(tried) if n is not None and fits(n, 200) else tried
        bad = taken.join(side, ["kind", "sur"]).select("kind", "norm").unionByName(tried.join(first, ["kind", "sur"]).filter("norm <> first").select("kind", "norm"))
        bad = written(bad.distinct())
        kept = written(tried.join(bad, ["kind", "norm"], "left_anti"))
        settled = kept.select("kind", "sur") if settled is None else settled.unionByName(kept.select("kind", "sur"))
        if attempt:
            now = kept.select("kind", "norm", F.lit(attempt).alias("attempt"))
            moved = now if moved is None else moved.unionByName(now)
        if bad.isEmpty():
            return written(moved) if moved is not None else kept.select("kind", "norm", F.lit(0).alias("attempt")).filter("false")
        left, attempt = bad, attempt + 1


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the entities in ``text_col`` replaced, and n_entities added (a name taken before is replaced).

    Texts without entities stay as they are, null ones null, long ones are searched whole. Rows that repeat each other get the same text. An empty table gives an empty one. Of
    entities that tie for a surrogate the least in code point order keeps it, so results don't depend on the order of rows.
    """
    base, at = guarded(docs.drop("n_entities"))
    names, text_col = list(at), at[text_col]
    body = whole_text(text_col)
    rows = base.withColumn("_parts", parts_of(body))
    rows = written(rows.withColumns({"_h": F.when(F.col("_parts").isNotNull(), F.md5(body)), text_col: F.when(F.col("_parts").isNull(), F.col(text_col))}))
    found = rows.filter("_parts is not null")
    each = found.select(F.explode(_mentions(F.col("_parts"))).alias("v")).distinct().withColumn("kind", kind_of(F.col("v")))
    each = written(each.select("v", F.posexplode(units(F.col("kind"), normal(F.col("v"), F.col("kind")))).alias("j", "unit")).select("v", "j", "unit.kind", "unit.norm", F.col("unit.kind").alias("own")))
    each = _with_genders(each)
    exceptions = attempts(each.select("kind", "norm").distinct(), key)
    # Mentions with a unit that moved, or whose gender others tell; only texts that hold one are joined, repeated texts once.
    odd = written(each.join(exceptions, ["kind", "norm"], "left").filter("attempt IS NOT NULL OR kind <> own").select("v", "j", F.struct("kind", F.coalesce("attempt", F.lit(0)).alias("attempt")).alias("as")))
    tries = lambda i, j, kind: (kind, F.lit(0))
    if not odd.isEmpty():
        held = found.select("_h", F.posexplode(_mentions(F.col("_parts"))).alias("at", "v")).distinct()
        hit = held.join(odd, "v").groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("at", "j"), "as"))).alias("_tries"))  # a text's own mentions
        # Dealt by text and salt, so that a text's copies aren't one task's.
        hit = written(hit).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        found = found.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_SALTS)).cast("int")).join(hit, ["_h", "_salt"], "left")

        def tries(i, j, kind):
            moved = F.element_at("_tries", F.struct(i.alias("at"), j.alias("j")))
            return F.coalesce(moved["kind"], kind), F.coalesce(moved["attempt"], F.lit(0))

    parts = F.col("_parts")
    found = found.withColumn("_new", _replaced(_mentions(parts), tries, key))
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.element_at("_new", ((i + 1) / 2).cast("int"))).otherwise(p)), "")
    out = found.withColumns({text_col: text, "n_entities": ((F.size(parts) - 1) / 2).cast("long")}).select(*base.columns, "n_entities")
    plain = rows.filter("_parts is null").select(*base.columns, F.lit(0).cast("long").alias("n_entities"))
    return out.unionByName(plain).toDF(*names, "n_entities")


def _with_genders(each: DataFrame) -> DataFrame:
    """Units of mentions (v, j, kind, norm, own), given names after titles without gender as of the one gender that the corpus has them with, if it is one: Dr Anna Weber is Frau Anna Weber."""
    given = each.filter("kind IN ('given_f', 'given_m')").groupBy("norm").agg(F.min("kind").alias("is"), F.max("kind").alias("other")).filter("`is` = other").select("norm", "is")
    told = written(each.filter("kind = 'given_n'").join(given, "norm").select("v", "j", "is"))
    if told.isEmpty():
        return each
    return written(each.join(told, ["v", "j"], "left").withColumn("kind", F.coalesce("is", "kind")).drop("is"))


#: The query's key. A caller passes one of its own and keeps it secret.
QUERY_KEY = "public-example-key"


def op10_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, text (with the surrogates), n_entities of every document."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
