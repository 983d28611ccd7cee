"""The pipeline and the registered queries of this subpackage."""

import random
import re

import corpus_pipeline
from driftspark.llm import quality
from driftspark.llm.queries import QUERIES

import __spark_entry__ as entry_point

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    word = lambda: "w%d" % rng.randint(0, 3000)
    clean = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(20)]
    passage = " ".join(word() for _ in range(55))
    texts = clean + [clean[0], clean[1] + " more", "short", None, "", " ".join(["spam again and again it goes so on"] * 9)]
    texts += [clean[2][:40] + " " + passage + " one " + " ".join(word() for _ in range(60)), passage + " two " + " ".join(word() for _ in range(70))]
    texts += [" ".join(word() for _ in range(40)) + " token = abcdef0123456789abcdef"]
    return texts


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_point.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "suffix-array dedup", "secret scans", "packing",
    ]


def test_pipeline(spark, tmp_path):
    texts = corpus()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = [i for i, t in enumerate(texts) if quality.passes(quality.measures(t), quality.MAX_COVERED, quality.MAX_LONGEST)]
    assert {22, 23, 24, 25}.isdisjoint(good)
    assert set(got) == set(good) - {20, 21}
    assert all(got[i]["text"] == texts[i] for i in range(20))
    passage = texts[27].split(" two ")[0]
    assert passage in got[26]["text"] and passage[60:-60] not in got[27]["text"]
    assert got[28]["text"].endswith("<secret>") and got[28]["n_chars"] == len(got[28]["text"])


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0




def test_python_workers_get_bounded_batches(spark):
    import pyarrow as pa

    from driftspark.llm.common import ready

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    many = ready(spark).range(0, 3000, 1, 1)
    assert max(r.n for r in many.mapInArrow(sizes, "n long").collect()) <= 1000
    long = many.limit(400).selectExpr("repeat(cast(id as string), 20000) AS t")
    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 400
