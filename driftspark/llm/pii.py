"""Operator 10: surrogates for personal data, in DataFrame functions only.

Detected entities are replaced by keyed surrogates of the same kind. An entity is its kind and its normal form
(digits of a number, lower case of an address, each part of a name), so every mention of it, in any text and
format, gets the same surrogate; a corpus-wide check makes sure that no two entities share one.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import table
from driftspark.session import settle

# Titles that introduce a name, by gender: m, f, n (either).
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "господин", "г-н", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Signora", "госпожа", "г-жа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
# Possessive quantifiers and the look-behinds keep the scan linear: a run of characters is entered once. Every
# repeated group has a bound, as the regex engine recurses for each round of one; a domain has 127 labels at most.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|(?<=\+[0-9]{1,3}[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
    "name": r"(?<!\p{L})(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? \p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A text without any of these has no entity: the full pattern is tried on the others only.
HINT = r"@|[0-9][0-9.)( -]{2,}|(?<!\p{L})(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.? \p{Lu}"
# Syllables of made-up names and words, by script.
SYLLABLES = {
    "latin": "ba be bo ca co da de di do fa fe ga go ka ke ki la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se so ta te ti to va vi".split(),
    "cyrillic": "ба бе бо ва ве ви га да де ди до за ка ки ко ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се со та те ти".split(),
    "greek": "βα βε βο γα γε δα δε δι κα κε κι λα λε λι λο μα με μι μο να νε νι νο πα ρα ρε ρι ρο σα σε σο τα τε τι το".split(),
}
# How given names end, by gender and script, so that a surrogate reads as the same gender.
ENDINGS = {
    "latin": {"m": "n", "f": "na", "n": "l"}, "cyrillic": {"m": "н", "f": "на", "n": "ль"}, "greek": {"m": "νος", "f": "νη", "n": "λι"},
}
KEPT_DOMAINS = ("com", "org", "net")
# Rounds of the collision check that draw codes of the usual length; later rounds draw longer ones.
ROUNDS = 8


def digest(key: str, *parts: Column) -> Column:
    """128 hexadecimal characters that depend on the key and the parts."""
    text = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit("\x1f+")), 256))


def number_at(hex_: Column, at: int, width: int = 4) -> Column:
    return F.conv(F.substring(hex_, at, width), 16, 10).cast("int")


def pick(hex_: Column, at: int, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), number_at(hex_, at) % len(words) + 1)


def kind_of(value: Column) -> Column:
    """The first kind whose pattern is the whole mention."""
    out: Column = F.lit("name")
    for kind, pattern in reversed([(k, p) for k, p in PATTERNS.items() if k != "name"]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def mentions(text: Column) -> Column:
    """All mentions of a text in order; none for null and empty texts."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def title_of(value: Column) -> Column:
    return F.regexp_extract(value, r"^([^ ]*) ", 1)


def gender_of(title: Column) -> Column:
    bare = F.rtrim(title, F.lit("."))
    return F.when(bare.isin(*TITLES["m"]), "m").when(bare.isin(*TITLES["f"]), "f").otherwise("n")


def script_of(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def entities_of(value: Column, kind: Column) -> Column:
    """The entities of a mention as (kind, normal form, gender): one, or one for each part of a name.

    The last part is a family name, the others are given names. The script is part of the kind; the gender that
    the title tells is not, as a name may follow titles of any."""
    parts = F.split(F.regexp_replace(value, r"^[^ ]* ", ""), "[ -]")
    family = F.concat(F.lit("family "), script_of(value))
    given = F.concat(F.lit("given "), script_of(value))
    gender = F.when(kind == "name", gender_of(title_of(value))).otherwise("n")
    entity = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"), gender.alias("gender"))
    names = F.transform(parts, lambda p, i: entity(F.when(i == F.size(parts) - 1, family).otherwise(given), F.lower(p)))
    norm = (
        F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(F.lower(value))
    )
    return F.when(kind == "name", names).otherwise(F.array(entity(kind, norm)))


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes ``digits`` plus it valid."""
    total = F.aggregate(
        F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    return ((F.lit(10) - total % 10) % 10).cast("string")


def settled_gender(gender: Column) -> Column:
    """One gender for all mentions of a name: that of most of its titles that tell one (f if there are as many of
    both), else n."""
    m, f = F.count_if(gender == "m"), F.count_if(gender == "f")
    return F.when(m > f, "m").when(f > 0, "f").otherwise("n")


def surrogate(key: str, kind: Column, norm: Column, attempt: Column, gender: Column) -> Column:
    """The keyed surrogate of an entity, in the normal form of its kind.

    Numbers keep their length (a card number that is valid stays valid, a telephone number keeps its first
    digit), an address gets a made-up name at a reserved domain that is the same for every address of a domain,
    an IP address stays one, a name keeps script and gender."""
    hex_ = digest(key, kind, norm, attempt.cast("string"))
    digits = F.translate(hex_, "abcdef", "284617")
    size = F.length(norm)
    valid = luhn_digit(F.substring(norm, F.lit(1), size - 1)) == F.substring(norm, size, F.lit(1))
    body = F.concat((number_at(hex_, 120) % 9 + 1).cast("string"), F.substring(digits, F.lit(2), size - 2))
    card = F.when(valid, F.concat(body, luhn_digit(body))).otherwise(F.concat(body, F.substring(digits, size, F.lit(1))))
    phone = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(1), size - 1))
    account = F.concat(
        F.substring(norm, 1, 2),
        F.array_join(
            F.transform(F.split(F.substring(norm, F.lit(3), size - 2), ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, i + 1, F.lit(1))).otherwise(
                F.char(F.lit(65) + F.conv(F.substring(hex_, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 26))), ""),
    )
    octet = lambda at, least, most: (number_at(hex_, at) % (most - least + 1) + least).cast("string")
    ip = F.concat_ws(".", octet(1, 1, 223), octet(5, 0, 255), octet(9, 0, 255), octet(13, 1, 254))
    word = lambda h, at, n: F.concat(*(pick(h, at + 4 * i, SYLLABLES["latin"]) for i in range(n)))
    domain = F.regexp_extract(norm, "@(.*)$", 1)
    place = digest(key, F.lit("domain"), domain)
    ending = F.regexp_extract(domain, r"\.([^.]*)$", 1)
    email = F.concat(
        word(hex_, 1, 3), F.lit("."), (number_at(hex_, 30, 5) % 10000).cast("string"), F.lit("@"), word(place, 1, 3),
        F.lit(".example."), F.when(ending.isin(*KEPT_DOMAINS), ending).otherwise("org"),
    )
    name: Column = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        stem = F.concat(*(pick(hex_, 1 + 4 * i, syllables) for i in range(4)))
        name = F.when(kind == f"family {script}", stem).otherwise(name)
        ends = ENDINGS[script]
        end = F.when(gender == "m", ends["m"]).when(gender == "f", ends["f"]).otherwise(ends["n"])
        name = F.when(kind == f"given {script}", F.concat(stem, end)).otherwise(name)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "iban", account).when(kind == "card", card)
        .when(kind == "phone", phone).when(kind == "ssn", F.substring(digits, F.lit(1), size)).otherwise(name)
    )


def lengthened(key: str, kind: Column, norm: Column, attempt: Column, code: Column, extra: int) -> Column:
    """``code`` made longer by ``4 * extra`` digits or, for names and addresses, ``2 * extra`` syllables.

    Valid card numbers stay valid, names keep script and gender; an IP address becomes one of version 6."""
    more = digest(key, F.lit("longer"), kind, norm, attempt.cast("string"))
    tail = F.substring(F.translate(more, "abcdef", "284617"), 1, 4 * extra)
    size = F.length(code)
    valid = luhn_digit(F.substring(norm, F.lit(1), F.length(norm) - 1)) == F.substring(norm, F.length(norm), F.lit(1))
    body = F.concat(F.substring(code, F.lit(1), size - 1), tail)
    card = F.concat(body, F.when(valid, luhn_digit(body)).otherwise(F.substring(code, size, F.lit(1))))
    ip = F.concat_ws(":", F.lit("2001:db8"), *(F.substring(more, i, 4) for i in range(1, 25, 4)))
    syllables = lambda script: F.concat(*(pick(more, 1 + 4 * i % 124, SYLLABLES[script]) for i in range(2 * extra)))
    out = F.when(kind == "email", F.concat(syllables("latin"), code)).when(kind == "ip", ip).when(kind == "card", card)
    for script in SYLLABLES:
        out = out.when(kind.rlike(f"^(family|given) {script}"), F.concat(syllables(script), code))
    return out.otherwise(F.concat(code, tail))


def surrogates(entities: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """``kind``, ``norm``, ``gender`` and ``code`` for each distinct entity; codes differ within a kind. ``gender``
    (n where ``entities`` has none) chooses the ending of a given name.

    An entity draws again while its code is shared with a smaller one or is the normal form of an entity of the
    corpus. The table holds one row per entity; each round looks at all of them by joins on the code. Rounds go
    on until no code is shared: after ``rounds`` of them, what is drawn gets longer with each round, so a kind
    with more entities than codes of the usual length comes to an end too."""
    gender = F.col("gender") if "gender" in entities.columns else F.lit("n").alias("gender")
    first = entities.select("kind", "norm", gender, F.lit(0).alias("attempt"))
    drawn = settle(first.withColumn("code", surrogate(key, F.col("kind"), F.col("norm"), F.col("attempt"), F.col("gender"))), "surrogates")
    for number in itertools.count(1):
        taken = drawn.select(F.col("kind").alias("k"), F.col("norm").alias("c"), F.lit("").alias("owner")).union(
            drawn.select(F.col("kind"), F.col("code"), F.col("norm"))
        ).groupBy("k", "c").agg(F.min("owner").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        clash = drawn.join(taken, (F.col("kind") == F.col("k")) & (F.col("code") == F.col("c")) & (F.col("norm") != F.col("owner"))).select("kind", "norm")
        if clash.isEmpty():
            return drawn
        again = drawn.join(clash.select(F.col("kind").alias("k2"), F.col("norm").alias("n2")), (F.col("kind") == F.col("k2")) & (F.col("norm") == F.col("n2")), "left")
        attempt = F.when(F.col("k2").isNull(), F.col("attempt")).otherwise(F.col("attempt") + 1)
        code = F.when(F.col("k2").isNull(), F.col("code")).otherwise(surrogate(key, F.col("kind"), F.col("norm"), attempt, F.col("gender")))
        fresh = again.select("kind", "norm", "gender", attempt.alias("attempt"), code.alias("code"), F.col("k2").isNotNull().alias("redrawn"))
        if number > rounds:
            fresh = settle(fresh, "surrogates")
            longer = lengthened(key, F.col("kind"), F.col("norm"), F.col("attempt"), F.col("code"), number - rounds)
            fresh = fresh.withColumn("code", F.when(F.col("redrawn"), longer).otherwise(F.col("code")))
        drawn = settle(fresh.drop("redrawn"), "surrogates")


def filled(value: Column, code: Column) -> Column:
    """``value`` with its letters and digits replaced by those of ``code`` in turn, everything else kept; what a
    longer code has beyond them follows at the end."""
    chars = F.split(value, "")
    step = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")),
        lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["out"], F.substring(code, a["i"] + 1, F.lit(1))).alias("out"), (a["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["i"].alias("i"))),
    )
    whole = F.transform(F.array(step), lambda a: F.concat(a["out"], F.substring(code, a["i"] + 1, F.length(code))))
    return F.element_at(whole, 1)


def rendered(value: Column, kind: Column, codes: Column) -> Column:
    """The surrogate in the format of the mention: its punctuation, its case, the title of a name."""
    first = F.element_at(codes, 1)
    cased = lambda code, like: F.when((like == F.upper(like)) & (like != F.lower(like)), F.upper(code)).otherwise(code)
    breaks = F.regexp_extract_all(F.regexp_replace(value, r"^[^ ]* ", ""), F.lit("[ -]"), F.lit(0))
    name = F.concat(
        title_of(value), F.lit(" "),
        F.array_join(F.transform(codes, lambda c, i: F.concat(F.initcap(c), F.coalesce(F.get(breaks, i), F.lit("")))), ""),
    )
    return F.when(kind == "name", name).when(kind.isin("email", "ip"), cased(first, value)).otherwise(filled(value, first))


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced, and ``n_entities`` (long), the mentions in it.

    Other columns stay; one named ``n_entities`` is replaced. Null and empty texts have no entities and stay as
    they are. Rows that repeat key and text are changed alike, rows with a null key like all others.
    """
    rows = docs.drop("n_entities").withColumn("__th", F.xxhash64(F.col(text)))
    found = settle(
        rows.select(F.col(key).alias("id"), F.col("__th").alias("th"), F.col(text).alias("text"), mentions(F.col(text)).alias("values"))
        .filter("size(values) > 0").dropDuplicates(["id", "th"]),
        "mentions",
    )
    each = found.select("id", "th", F.posexplode("values").alias("pos", "value")).withColumn("kind", kind_of(F.col("value")))
    parts = settle(
        each.select("id", "th", "pos", "value", F.col("kind").alias("sort"), F.posexplode(entities_of(F.col("value"), F.col("kind"))).alias("part", "entity"))
        .select("id", "th", "pos", "value", "sort", "part", "entity.kind", "entity.norm", "entity.gender"),
        "entities",
    )
    codes = surrogates(parts.groupBy("kind", "norm").agg(settled_gender(F.col("gender")).alias("gender")), secret)
    coded = parts.join(codes.select("kind", "norm", "code"), ["kind", "norm"]).groupBy("id", "th", "pos", "value", "sort").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda s: s["code"]).alias("codes")
    )
    shown = coded.select("id", "th", "pos", rendered(F.col("value"), F.col("sort"), F.col("codes")).alias("shown"))
    lists = shown.groupBy("id", "th").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda s: s["shown"]).alias("shown"))
    between = F.split("text", ANY, -1)
    whole = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.get("shown", i), F.lit("")))), "")
    texts = found.join(
        lists.select(F.col("id").alias("i2"), F.col("th").alias("t2"), "shown"), F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("t2"))
    ).select(F.col("id").alias("__id"), F.col("th").alias("__th2"), whole.alias("__text"), F.size("shown").cast("long").alias("n_entities"))
    joined = rows.join(settle(texts, "texts"), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__th2")), "left")
    kept = [F.coalesce("__text", text).alias(text) if c == text else F.col(c) for c in rows.columns if c != "__th"]
    return joined.select(*kept, F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, "driftspark")
