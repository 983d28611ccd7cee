"""Operator 10: surrogates for personal data."""

import re

import pytest
from pyspark.sql import functions as F

from driftspark.llm import pii

TEXTS = [
    "Mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM now",
    "Call +1 (017) 555-7713, or +1 017 555 7713. Not 12-34.",
    "Host 97.51.17.173 and version 1.2.3 and 999.1.1.1",
    "Cards 4111 1111 1111 1111 and 4111111111111111 and 9807915762804490",
    "Mr John Smith met Mrs Mary Smith; Mr Smith left. Frau Erika Meyer-Lang kam. господин Иван Петров",
    "123-45-6789 is a number, 2024-01-02 a date",
    "DE89 3704 0044 0532 0130 00 is an account",
    None, "", "nothing to see", "und.34@mail7.example.com", "und.34@mail7.example.com",
]


@pytest.fixture(scope="module")
def out(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities string")
    return {r["doc_id"]: r for r in pii.pseudonymise(docs, "secret").collect()}


def test_rows(out):
    assert len(out) == len(TEXTS) + 1
    assert out[7]["text"] is None and out[8]["text"] == "" and out[9]["text"] == "nothing to see"
    assert [out[i]["n_entities"] for i in range(12)] == [2, 2, 1, 3, 5, 1, 1, 0, 0, 0, 1, 1]


def test_nothing_is_left_and_all_else_is(out):
    for i, value in [(0, "und.34@mail7"), (1, "555-7713"), (2, "97.51.17.173"), (3, "4111111111111111"), (4, "Smith"), (4, "Петров"), (5, "123-45-6789"), (6, "0532 0130")]:
        assert value.lower() not in out[i]["text"].lower()
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4}, or \+1 \d{3} \d{3} \d{4}\. Not 12-34\.", out[1]["text"])
    assert out[2]["text"].endswith("and version 1.2.3 and 999.1.1.1")
    assert out[5]["text"].endswith("is a number, 2024-01-02 a date")


def test_same_entity_same_surrogate(out):
    first, second = re.search(r"Mail (\S+) or (\S+) now", out[0]["text"]).groups()
    assert second == first.upper() and out[10]["text"] == out[11]["text"] == first
    assert out[None]["text"] == out[0]["text"]
    a, b = re.search(r"Call (.*), or (.*)\. Not", out[1]["text"]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    a, b, c = re.search(r"Cards (\d{4} \d{4} \d{4} \d{4}) and (\d{16}) and (\d{16})", out[3]["text"]).groups()
    assert a.replace(" ", "") == b != c
    m = re.fullmatch(r"Mr (\w+n) (\w+) met Mrs (\w+na) (\w+); Mr (\w+) left\. Frau (\w+na) (\w+)-(\w+) kam\. господин ([а-я]+н) ([а-я]+)", out[4]["text"], re.IGNORECASE)
    assert m and m[2] == m[4] == m[5]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_valid_cards_stay_valid(out):
    assert luhn(re.search(r"and (\d{16}) and", out[3]["text"]).group(1))


def test_distinct_entities_stay_distinct(spark):
    entities = spark.range(3000).select(F.lit("ssn").alias("kind"), F.format_string("%03d", F.col("id") % 1000).alias("norm")).distinct()
    few = pii.surrogates(entities.filter("norm < '300'"), "k", rounds=30).collect()
    assert len({r["code"] for r in few}) == 300 and not {r["code"] for r in few} & {r["norm"] for r in few}


def test_full_code_spaces_stay_distinct(spark):
    """As many entities as codes, all taken by the corpus itself, with the rounds of production."""
    numbers = spark.range(1000).select(F.lit("ssn").alias("kind"), F.format_string("%03d", "id").alias("norm"))
    few = spark.range(10).select(F.lit("phone").alias("kind"), F.format_string("1%d", "id").alias("norm"))
    got = pii.surrogates(numbers.union(few), "k").collect()
    codes = {(r["kind"], r["code"]) for r in got}
    assert len(got) == len(codes) == 1010 and not codes & {(r["kind"], r["norm"]) for r in got}


def test_longer_codes_keep_their_kind(spark):
    cases = [("card", "4111111111111111", "5000000000000009"), ("ip", "1.2.3.4", "5.6.7.8"), ("given greek", "x", "βαβανη"), ("email", "a@b.com", "ba.1@bo.example.com")]
    rows = spark.createDataFrame(cases, "kind string, norm string, code string")
    got = {r["kind"]: r["c"] for r in rows.select("kind", pii.lengthened("k", F.col("kind"), F.col("norm"), F.lit(9), F.col("code"), 1).alias("c")).collect()}
    assert luhn(got["card"]) and len(got["card"]) == 20 and got["ip"].startswith("2001:db8:")
    assert re.fullmatch("[α-ω]{4}βαβανη", got["given greek"]) and re.fullmatch(r"\w{4}ba\.1@bo\.example\.com", got["email"])
    shown = spark.range(1).select(pii.filled(F.lit("(1) 23 45"), F.lit("167899999"))).first()[0]
    assert shown == "(1) 67 899999"


def test_a_name_has_one_surrogate_under_all_titles(spark):
    docs = spark.createDataFrame([(1, "Mrs Anna Smith and Dr Anna Smith"), (2, "Prof Anna Smith"), (3, "Dr Karl Smith"), (4, "Mr Karl Smith")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    a, b = re.fullmatch(r"Mrs (\w+na \w+) and Dr (\w+ \w+)", got[1]).groups()
    assert a == b and got[2] == f"Prof {a}"
    assert got[3].removeprefix("Dr ") == got[4].removeprefix("Mr ") and got[4].split()[1].endswith("n")


def test_the_key_matters(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    a, b = (pii.pseudonymise(docs, k).first()["text"] for k in ("one", "two"))
    assert a != b and pii.pseudonymise(docs, "one").first()["text"] == a
    assert pii.pseudonymise(docs.limit(0), "one").count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    plan = pii.pseudonymise(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_mentions_end_quickly(spark):
    texts = ["x@" + "b." * 200_000, "x@" + "b." * 200_000 + "com", "a@b.com " + "c." * 100_000 + "d@e.org", "x@" + "b" * 400_000 + ".com"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r["m"] for r in df.select(pii.mentions(pii.F.col("text")).alias("m")).collect()]
    assert found[0] == [] and found[2][0] == "a@b.com" and found[3] == [texts[3]]
    labels = "x@" + "b." * 126 + "com"
    assert [r["m"] for r in spark.createDataFrame([(labels,)], "text string").select(pii.mentions(pii.F.col("text")).alias("m")).collect()] == [[labels]]
