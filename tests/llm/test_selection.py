"""Operators 11, 12 and 13 against plain restatements, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from driftspark.llm import chat, lexical, radix, resampling
from driftspark.llm.words import word_lists

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def odd_texts(seed, count=60):
    rng = random.Random(seed)
    pool = ["The", "on", "É", "ß1", "数据", "😀", "a-b", "x_y", "\x00", "\t", "q" * 300, "12", "...", "on"]
    texts = [None, "", " ", "!?", "one", "one", "The on " * 3000, "word " * 25]
    return texts + [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(count)]


# --- words ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_of_cut_texts(piece):
    for text in odd_texts(1):
        got = [w.decode() for part in word_lists(text, piece) for w in part]
        assert got == words(text)


# --- radix sort -------------------------------------------------------------------------------------


def test_radix_ranks(spark):
    rng = random.Random(3)
    big = [-(1 << 63), (1 << 63) - 1, 0, -1, 5]
    rows = [(rng.choice(big), rng.randint(-50, 50), rng.choice([None, 1, 1 << 40]), i) for i in range(500)]
    rows += [(7, 7, 7, 1000)] * 200  # repeated rows, more than a block
    df = spark.createDataFrame(rows, "a long, b int, c long, rank long")
    got = radix.radix_ranks(df, [("b", True), ("a", False), ("c", True)], digit_bits=5, block=64)
    assert got.columns == ["a", "b", "c", "rank"]
    found = sorted(map(tuple, got.collect()), key=lambda r: r[3])
    assert [r[3] for r in found] == list(range(1, len(rows) + 1))
    order = sorted([r[:3] for r in rows], key=lambda r: (-r[1], r[0], r[2] is None, -(r[2] or 0)))
    assert [r[:3] for r in found] == order


def test_radix_of_nothing_and_of_equal_rows(spark):
    empty = spark.createDataFrame([], "a long")
    assert radix.radix_ranks(empty, [("a", True)]).collect() == []
    same = spark.createDataFrame([(None,)] * 5, "a long")
    assert sorted(r["rank"] for r in radix.radix_ranks(same, [("a", False)]).collect()) == [1, 2, 3, 4, 5]


# --- operator 11 ------------------------------------------------------------------------------------


def plain_resampling(docs, target, longest, buckets=10_000, percent=10):
    def found(text):
        w = words(text)
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(r.encode()) % buckets for r in runs]

    measured = [(key, *found(text)) for key, text in docs]
    s, t = Counter(b for *_, bs in measured for b in bs), Counter(b for _, text in target for b in found(text)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in set(s)}
    rows = []
    for key, n, bs in measured:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: len(able) * percent // 100]
    return [(*r, i + 1) for i, r in enumerate(drawn)] + [(*r, None) for r in able[len(drawn) :]] + [(*r, None) for r in rows if r[1] < 20]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling(spark, longest):
    docs = [(i // 2 if i % 9 else None, t) for i, t in enumerate(odd_texts(4) + odd_texts(4))]
    target = [(1, "The on the ON"), (None, None), (1, "数据 ß1")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, weight string, rank int")
    aim = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(frame, aim, longest=longest, percent=40)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_resampling(docs, target, longest, percent=40)))


def test_drawn_documents_keep_their_columns(spark):
    texts = odd_texts(5)
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, __drawn long")
    aim = spark.createDataFrame([(1, "on")], "item_id long, text string")
    want = {r[0] for r in plain_resampling(list(enumerate(texts)), [(1, "on")], 1, percent=50) if r[-1]}
    frame = frame.withColumnRenamed("__drawn", "score")
    got = resampling.draw(frame, aim, percent=50)
    assert got.columns == frame.columns and {r["doc_id"] for r in got.collect()} == want and want


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    aim = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(none, aim).collect() == []
    one = spark.createDataFrame([(1, "on " * 30), (2, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_words"], r["rank"]) for r in resampling.resample(one, aim, percent=100).collect()} == {(1, 30, 1), (2, 0, None)}


# --- operator 12 ------------------------------------------------------------------------------------

MESSAGES = "tree long, id long, parent long, role string, text string, score double, extra int"
ODD = [None, "", "plain", r"\### Assistant: </turn> ok", "####### a: b", "</turn>\n### x: y</turn>\n", "\\", "\\\\n", "#", "<", "</tur", "a\nb", "😀é"]


def forest(seed, trees=6):
    rng = random.Random(seed)
    rows = []
    for tree in [*range(trees), None]:
        for i in range(rng.randint(1, 30)):
            parent = rng.randint(0, i - 1) if i and rng.random() < 0.95 else None
            score = rng.choice([None, 0.0, 1.0, -2.5, 4.0])
            rows.append((tree, i, parent, rng.choice(["user", "assistant", "a: b", None]), rng.choice(ODD), score, 1))
    return rows


def plain_paths(rows, best):
    out = []
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        parent = {i: (r[2] if r[2] in nodes and r[2] != i else None) for i, r in nodes.items()}
        leaves = []
        for i in set(nodes) - {p for p in parent.values() if p is not None}:
            path, at = [], i
            while at is not None and at not in path:
                path.append(at)
                at = parent[at]
            if at is None:
                leaves.append((-sum(nodes[x][5] or 0.0 for x in path), i, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(leaves)):
            if best is None or rank < best:
                out.append((tree, leaf, rank + 1, -score, [(nodes[x][3] or "", nodes[x][4] or "") for x in path]))
    return out


@pytest.mark.parametrize("best", [1, 3, None])
def test_reply_trees(spark, best):
    rows = forest(8)
    got = chat.format_paths(spark.createDataFrame(rows, MESSAGES), best).select(
        "tree", "leaf", "rank", "path_score", chat.read_turns(chat.F.col("formatted")).alias("turns"),
        chat.read_loss(chat.F.col("formatted"), chat.F.col("loss")).alias("learnt"), "formatted", "loss", "n_turns",
    ).collect()
    want = plain_paths(rows, best)
    assert sorted(((r["tree"], r["leaf"], r["rank"], r["path_score"], [tuple(t) for t in r["turns"]]) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        turns = [tuple(t) for t in r["turns"]]
        assert r["n_turns"] == len(turns) == r["formatted"].count(chat.END)
        assert r["learnt"] == "".join(t for role, t in turns if role == "assistant")
        spans = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert len(spans) == sum(role == "assistant" for role, _ in turns)
        data = r["formatted"].encode()
        assert spans == [data[s["start_byte"] : s["end_byte"]].decode() for s in r["loss"]]


def test_long_chain_and_circle(spark):
    rows = [(1, i, i - 1 if i else None, "user", f"t{i}", 1.0, 0) for i in range(300)]
    rows += [(2, 0, 1, "user", "a", 1.0, 0), (2, 1, 0, "user", "b", 1.0, 0), (2, 2, 2, "user", "own parent", 1.0, 0)]
    got = chat.format_paths(spark.createDataFrame(rows, MESSAGES)).collect()
    assert sorted((r["tree"], r["leaf"], r["n_turns"], r["path_score"]) for r in got) == [(1, 299, 300, 300.0), (2, 2, 1, 1.0)]


def test_messages_without_or_with_repeated_ids(spark):
    rows = [(1, 0, None, "user", "b", None, 0), (1, 0, None, "user", "a", None, 0), (1, None, 0, "user", "lone", 1.0, 0), (1, None, None, "x", "lone", 1.0, 0)]
    frame = spark.createDataFrame(rows, MESSAGES)

    def texts(best):
        read = chat.format_paths(frame, best).select("leaf", "rank", chat.read_turns(chat.F.col("formatted")).alias("turns"))
        return sorted((r["leaf"] is None, r["rank"], r["turns"][0]["text"]) for r in read.collect())

    assert texts(1) == [(False, 1, "a")]
    assert texts(None) == [(False, 1, "a"), (True, 2, "lone"), (True, 3, "lone")]
    assert chat.format_paths(frame.limit(0)).collect() == []


def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["#", "##", "<", "/turn>", "</turn>", "\\", ":", " ", "a", "\n", "$1"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts.append("\\#</turn>" * 100_000)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", chat.escape(chat.F.col("text")).alias("e")).select("text", "e", chat.unescape(chat.F.col("e")).alias("back")).collect():
        assert r["back"] == r["text"] and "###" not in r["e"] and "</turn>" not in r["e"]


def test_chat_plan_is_native(spark):
    rows = spark.createDataFrame(forest(9), MESSAGES)
    plan = chat.format_paths(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- operator 13 ------------------------------------------------------------------------------------


def plain_search(docs, items, top):
    held = [(key, Counter(words(text))) for key, text in docs]
    held = [(key, c) for key, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        asked, scores = Counter(words(text)), []
        for key, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // length
            score = sum(q * weight[w] * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in asked.items() if w in c)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("block, bundle, top", [(1024, 128, 20), (4, 2, 3)])
def test_search(spark, block, bundle, top):
    docs = [(i // 2 if i % 11 else None, t) for i, t in enumerate(odd_texts(6) + odd_texts(7))]
    items = [(1, "The on"), (1, "the the 数据 nowhere"), (None, "ß1 É 12"), (2, None), (3, "")] + [(10 + i, t) for i, t in enumerate(odd_texts(9, 6))]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, terms string")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    got = lexical.search(frame.repartition(5), asked, top=top, block=block, bundle=bundle)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_search(docs, items, top)))


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "on")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "on off"), (2, "other")], "doc_id long, text string")
    assert lexical.search(none, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert [r["doc_id"] for r in lexical.search(docs, items).collect()] == [1]
