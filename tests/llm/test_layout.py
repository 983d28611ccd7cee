"""Operators 5 and 6: packing and sharding."""

import glob
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftspark.llm import bpe, packing, sharding
from driftspark.llm.common import numbered
from driftspark.session import shared_folder


def least_padding(lengths, buckets):
    distinct = sorted(set(lengths))
    best = None
    for n in range(1, min(buckets, len(distinct)) + 1):
        for edges in itertools.combinations(distinct[:-1], n - 1):
            edges = [*edges, distinct[-1]]
            cost = sum(min(e for e in edges if e >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(0, 12) for _ in range(rng.randint(1, 30))]
        bars = [(x, lengths.count(x), x * lengths.count(x)) for x in sorted(set(lengths))]
        edges = packing.boundaries(bars, 3)
        assert sum(min(e for e in edges if e >= x) - x for x in lengths) == least_padding(lengths, 3)
    assert packing.boundaries([]) == []


def test_boundaries_of_long_texts_are_optimal():
    rng = random.Random(4)
    for _ in range(3):
        bars = [(x, rng.choice([1, 1, 2, 50, 1000])) for x in sorted(rng.sample(range(100_000), 300))]
        best = [0.0] + [float("inf")] * len(bars)
        before = [0, *itertools.accumulate(r for _, r in bars)]
        for _ in range(16):
            ends = range(1, len(bars) + 1)
            best = [float("inf"), *(min(best[i] + bars[e - 1][0] * (before[e] - before[i]) for i in range(e)) for e in ends)]
        edges = packing.boundaries(bars, 16)
        assert sum(min(e for e in edges if e >= x) * r for x, r in bars) == best[-1]


def test_packing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, i * 100, f"s{i}", i) for i in range(9)], "doc_id long, n long, slot string, before int")
    got = packing.pack(docs, "n", packing.spread("doc_id"), buckets=3, budget=500)
    assert got.columns == ["doc_id", "n", "slot", "before", "bucket", "boundary", "batch", "position", "padding"]
    assert sorted((r["doc_id"], r["slot"], r["before"]) for r in got.collect()) == [(i, f"s{i}", i) for i in range(9)]
    assert packing.histogram(docs.withColumn("n", packing.F.col("n") % 300), "n").tolist() == [[0, 3], [100, 3], [200, 3]]


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, None if i == 5 else rng.choice([0, 3, 40, 41, 300, 1000, 70000]), "x") for i in range(400)] + [(7, 3, "x"), (None, 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens int, bucket string")
    got = packing.pack(docs, "n_tokens", packing.spread("doc_id"), buckets=4, budget=1200).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r["padding"] == r["boundary"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    assert len({b for b, _ in batches}) == 4
    for (bucket, _), members in batches.items():
        assert sorted(m["position"] for m in members) == list(range(len(members)))
        assert len(members) * members[0]["boundary"] <= 1200 or len(members) == 1
    for bucket in {b for b, _ in batches}:
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))
        full = [len(batches[bucket, n]) for n in numbers[:-1]]
        assert len(set(full)) <= 1
    assert packing.pack(docs.limit(0), "n_tokens", packing.spread("doc_id")).count() == 0


def test_word_tokens(spark):
    texts = [(None,), ("",), (" a\tb\nc  d",), ("é x y",)]
    got = spark.createDataFrame(texts, "t string").select(packing.word_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 4, 2]


@pytest.mark.parametrize("parts", [1, 50])
def test_numbering_without_gaps(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 5), i, rng.randint(0, 9)) for i in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "g string, o int, id int, w int")
        got = numbered(df, "g", [F.col("o"), F.col("id")], "w", "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for group in ("a", "b", None):
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))
        mine = {r["id"]: r for r in got if r["g"] == group}
        total = 0
        for slot, (_, _, i, w) in enumerate(members):
            assert (mine[i]["slot"], mine[i]["before"]) == (slot, total)
            total += w


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(4)
    for _ in range(20):
        old = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))]
        new = sharding.even(sum(old), rng.randint(1, 8))
        flow = sharding.transfers(old, new)
        assert [sum(v for (s, _), v in flow.items() if s == i) for i in range(len(old))] == old
        assert [sum(v for (_, t), v in flow.items() if t == i) for i in range(len(new))] == new
        stay = sum(min(a, b) for a, b in zip(old, new))
        assert sum(v for (s, t), v in flow.items() if s != t) == sum(old) - stay


def test_flow_with_other_costs():
    cost = lambda s, t: [[1, 9], [2, 3]][s][t]
    assert sharding.transfers([4, 4], [4, 4], cost) == {(0, 0): 4, (1, 1): 4}


def test_resharding(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, ""] + ["é" * rng.randint(0, 300) for _ in range(300)] + ["same"] * 40
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op6_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["size"] == 8 and by_id[0]["text_crc32"] == 0
    shards = {s: [r for r in got if r["shard"] == s] for s in range(24)}
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    sizes = [sum(r["size"] for r in m) for m in shards.values()]
    assert max(sizes) - min(sizes) <= 3 * max(r["size"] for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.op6_sharding(spark, str(tmp_path)).count() == 0
    assert packing.op5_packing(spark, str(tmp_path)).count() == 0


def test_only_affected_shards_are_written(spark, tmp_path):
    rows = [(i, i % 3, 1 if i % 3 == 0 and i < 6 else i % 3) for i in range(30)]
    placed = spark.createDataFrame(rows, "id int, old int, shard int")
    folder = str(tmp_path / "shards")
    spark.createDataFrame(rows, "id int, old int, new int").withColumnRenamed("old", "shard").select("id", "shard").write.partitionBy("shard").parquet(folder)
    before = set(os.listdir(f"{folder}/shard=2"))
    assert sharding.rewrite(placed.select("id", "old", "shard"), "old", folder) == [0, 1]
    assert set(os.listdir(f"{folder}/shard=2")) == before
    now = {(r["id"], r["shard"]) for r in spark.read.parquet(folder).collect()}
    assert now == {(i, s) for i, _, s in rows}


def test_fewer_shards_leave_no_row_twice(spark, tmp_path):
    rng = random.Random(7)
    rows = [(None if i == 9 else i // 2, None if i % 50 == 0 else "t" * rng.randint(0, 40), i % 24) for i in range(600)] + [(1, "same", 3)] * 30
    folder, schema = str(tmp_path / "shards"), "doc_id int, text string, old_shard int, shard int"
    sharding.store(spark.createDataFrame([(*r[:2], r[2], r[2]) for r in rows], schema), folder)
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    sharding.reshard_files(spark, folder, schema, size, 24, 16, [-size, F.col("doc_id")])
    assert sorted(d for d in os.listdir(folder) if d.startswith("shard=")) == sorted(f"shard={s}" for s in range(16))
    got = spark.read.schema(schema).parquet(folder).collect()
    assert sorted(((r["doc_id"], r["text"], r["old_shard"]) for r in got), key=repr) == sorted(rows, key=repr)
    sizes = [sum(len(r["text"] or "") for r in got if r["shard"] == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 3 * 40


def test_the_query_writes_its_shards(spark, tmp_path):
    texts = ["w " * i for i in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/shards-*/shard=*"))
    got = sharding.op6_sharding(spark, str(tmp_path)).collect()
    written = sorted(set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/shards-*/shard=*")) - before)
    folder = os.path.dirname(written[0])
    files = spark.read.parquet(folder).collect()
    assert {os.path.dirname(w) for w in written} == {folder}
    assert sorted((r["doc_id"], r["text"]) for r in files) == list(enumerate(texts))
    assert {(r["doc_id"], r["shard"]) for r in files} == {(r["doc_id"], r["shard"]) for r in got}


def test_packing_counts_tokens_of_the_tokenizer(spark, tmp_path):
    texts = ["汉字文本没有空格" * 400, "some plain words here", None, "", "QUJDREVGRw" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in packing.op5_packing(spark, str(tmp_path)).collect()}
    want = {r["doc_id"]: len(r["ids"]) for r in bpe.encode(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert {k: r["n_tokens"] for k, r in got.items()} == want and want[0] > 400 and want[2] == want[3] == 0
    staged = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["text"]) for r in staged} == {k: (n, texts[k]) for k, n in want.items()}
