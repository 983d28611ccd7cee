"""Operator 11: importance resampling towards a target distribution, ranked by a distributed radix sort."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import map_texts, ready, table
from driftspark.llm.radix import radix_ranks
from driftspark.llm.words import word_lists
from driftspark.session import settle

BUCKETS = 10_000
SEED = 2024
MIN_WORDS, PERCENT = 20, 10


def features(rows: DataFrame, key: str, text: str, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``key``, ``n_words`` and ``buckets`` of every row: one bucket for each run of 1 to ``longest`` words of the
    whole text, repeats included (null and empty texts: none)."""

    def make():
        def work(t: str | None):
            count, found, tail = 0, [], []
            for words in word_lists(t):
                count += len(words)
                joined = tail + words
                for size in range(1, longest + 1):
                    # Runs that end in this piece; the words kept from the one before were counted there.
                    begin = max(len(tail) - size + 1, 0)
                    runs = (b" ".join(joined[i : i + size]) for i in range(begin, len(joined) - size + 1)) if size > 1 else words
                    found.append(np.fromiter((zlib.crc32(r) % buckets for r in runs), np.int32))
                tail = joined[max(len(joined) - longest + 1, 0) :] if longest > 1 else []
            return count, np.concatenate(found) if found else np.empty(0, np.int32)

        return work

    return map_texts(rows, [key], text, make, "n_words long, buckets array<int>")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features stand in each bucket; ``buckets`` rows come to the driver, whatever the corpus."""
    out = np.zeros(buckets, np.int64)
    for bucket, count in found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        out[bucket] = count
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of each bucket in target and source, floored."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def noise(seed: int, key: object) -> int:
    """1000 times a Gumbel variate that depends on the seed and the key alone, floored. A null key reads ``null``."""
    digits = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8]
    return math.floor(-1000 * math.log(-math.log((int(digits, 16) + 0.5) / 4294967296)))


def scored(found: DataFrame, key: str, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``key``, ``n_words``, ``n_features``, ``weight`` (floored mean of the gains of all features; 0 without any)
    and ``score`` (weight plus Gumbel noise) of every row of :func:`features`."""
    source = found.select(key, "n_words", "buckets")
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            sizes = np.diff(ends)
            sums = np.concatenate(([0], np.cumsum(gain[lists.values.to_numpy()[ends[0] : ends[-1]]])))
            totals = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
            weight = np.where(sizes > 0, totals // np.maximum(sizes, 1), 0)
            score = weight + np.array([noise(seed, k) for k in batch.column(0).to_pylist()], np.int64)
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "n_features", "weight", "score"])

    return source.mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text",
    longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``.

    Features are hashed runs of words; a bucket's gain is the log ratio of its share in ``target`` and in
    ``docs``, a document's weight the mean gain of its features. Of the rows with at least ``min_words`` words,
    ``percent`` in a hundred (floored) are drawn without replacement: the highest of weight plus Gumbel noise,
    ties to the smaller key (a null one last), then to fewer features. ``rank`` is null where a row is not drawn.

    Texts are read once; their buckets are written. Only bucket counts come to the driver and only gains go
    out, ``buckets`` numbers each. Ranks come from :func:`radix.radix_ranks`. Null and empty texts have no
    feature and weight 0; without any row to draw, or with an empty ``target``, nothing else changes. Rows that
    repeat a key count and are drawn one by one, with the same noise. ``key`` must be an integer column. No other
    column is carried, so none can clash.
    """
    ready(docs.sparkSession)
    found = settle(features(docs, key, text, longest, buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, target_key, target_text, longest, buckets), buckets))
    judged = settle(scored(found, key, gain, seed), "scores")
    able = F.col("n_words") >= min_words
    quota = judged.filter(able).count() * percent // 100
    ranks = radix_ranks(judged.filter(able), [("score", True), (key, False), ("n_features", False)])
    drawn = ranks.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return drawn.unionByName(judged.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, with all their columns.

    Rows that repeat a key are drawn together as soon as one of them is; rows with a null key are left out.
    """
    drawn = resample(docs, target, key, text, **options).filter("rank IS NOT NULL")
    return docs.join(drawn.select(F.col(key).alias("__drawn")).distinct(), F.col(key) == F.col("__drawn"), "left_semi")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of ``documents`` drawn towards ``benchmark``; one row for each document."""
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 by its defining rule: eight shifts for each byte, polynomial 0xEDB88320.
OP11_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, row, lower_w AS w, false AS target FROM (
    SELECT doc_id, row_number() OVER () AS row, text FROM documents) d,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS u(lower_w)
  UNION ALL
  SELECT NULL, NULL, lower_w, true FROM benchmark,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS u(lower_w)
), bytes AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)
), crc AS (
  SELECT w, h, 0 AS i, 4294967295::BIGINT AS c FROM bytes
  UNION ALL
  SELECT w, h, i + 1, list_reduce([xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
  FROM crc WHERE i < length(h) // 2
), bucket AS (
  SELECT w, xor(c, 4294967295::BIGINT) % 10000 AS b FROM crc WHERE i = length(h) // 2
), counts AS (
  SELECT b, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM words JOIN bucket USING (w) GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g
  FROM counts, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts)
), weights AS (
  SELECT row, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN bucket USING (w) JOIN gain USING (b) WHERE NOT target GROUP BY row
), scores AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN weights USING (row)
), ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS r,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END AS rank FROM ranked
"""
