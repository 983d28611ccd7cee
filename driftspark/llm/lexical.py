"""Operator 13: ranked lexical search by pipelined term partitioning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftspark.llm.common import map_texts, ready, table
from driftspark.llm.words import word_lists
from driftspark.session import settle

TOP = 20
# Fixed numbers of the score.
B, K1 = 25, 12
# Term owners, from rare terms to frequent ones: the least weight of a term of each but the last.
OWNERS = (4600, 2300, 1100)
# Rows of a block of documents and items of a bundle; their product bounds the accumulators of a task's group.
BLOCK, BUNDLE = 1024, 128


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n`` (terms with repeats) and ``terms`` (term and its occurrences) of every whole text."""

    def make():
        def work(t: str | None):
            found: Counter = Counter()
            for words in word_lists(t):
                found.update(words)
            return sum(found.values()), [{"term": w.decode("utf-8"), "tf": c} for w, c in found.items()]

        return work

    return map_texts(rows, [key], text, make, "n long, terms array<struct<term:string,tf:long>>")


def _div(a: Column | str, b: Column | int) -> Column:
    """Whole quotient of two longs, rounded down for values from 0 on."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def _owner(w: Column) -> Column:
    out = F.lit(len(OWNERS))
    for owner, least in reversed(list(enumerate(OWNERS))):
        out = F.when(w >= least, owner).otherwise(out)
    return out


def weighted_terms(counted: DataFrame, wanted: DataFrame, documents: int) -> DataFrame:
    """``term``, ``term_id``, ``w`` and ``owner`` of the terms in ``wanted`` that any document holds, settled."""
    held = counted.select(F.explode("terms.term").alias("t")).join(wanted, F.col("t") == F.col("term"), "left_semi")
    df = held.groupBy(F.col("t").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2.0 * documents + 2.0) / (2.0 * F.col("df") + 1.0)
    weighed = df.withColumn("w", F.floor(1000 * F.log(ratio)))
    return settle(weighed.select("term", F.monotonically_increasing_id().alias("term_id"), "w", _owner(F.col("w")).alias("owner")), "terms")


def _visit(bundle: pa.Table, postings: pa.Table, block_rows: int, bundle_items: int) -> pa.Table:
    """A bundle of items at one owner: the owner's contributions over one block of documents are added.

    ``bundle`` is one row: the terms it asks for (item, term, repeats) and the accumulators it carries (item, row
    of the block, score). ``postings`` are the owner's (term, row, part) of the block. Terms meet by binary search.
    """
    if not bundle.num_rows or not postings.num_rows:
        return bundle
    row = bundle.combine_chunks()

    def carried(name: str) -> np.ndarray:
        return row.column(name).chunk(0).flatten().to_numpy(zero_copy_only=False)

    asked, repeats, items = carried("ask_term"), carried("ask_repeats"), carried("ask_item")
    term, at, part = (postings.column(c).to_numpy() for c in ("term_id", "row", "part"))
    order = np.argsort(term, kind="stable")
    term, at, part = term[order], at[order] % block_rows, part[order]
    sums = np.zeros(bundle_items * block_rows, np.int64)
    sums[carried("acc_item").astype(np.int64) * block_rows + carried("acc_row")] = carried("acc_score")
    low, high = np.searchsorted(term, asked, "left"), np.searchsorted(term, asked, "right")
    for item, repeat, start, end in zip(items.tolist(), repeats.tolist(), low.tolist(), high.tolist()):
        # A document has one posting of a term, so no place stands twice in a slice.
        sums[item * block_rows + at[start:end]] += repeat * part[start:end]
    some = np.flatnonzero(sums)
    for name, values in (("acc_item", some // block_rows), ("acc_row", some % block_rows), ("acc_score", sums[some])):
        place = row.schema.get_field_index(name)
        kind = row.schema.field(place).type
        lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values).cast(kind.value_type))
        row = row.set_column(place, row.schema.field(place), lists.cast(kind))
    return row


def _best(item: np.ndarray, row: np.ndarray, score: np.ndarray, ids: pa.Array, top: int) -> np.ndarray:
    """Which accumulators of a block are among the ``top`` of their item, by score and then id (null last)."""
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    order = np.lexsort((rank[row], -score, item))
    groups, first = np.unique(item[order], return_index=True)
    place = np.arange(len(order)) - first[np.searchsorted(groups, item[order])]
    return order[place < top]


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP,
    block: int = BLOCK, bundle: int = BUNDLE,
) -> DataFrame:
    """The ``top`` rows of ``docs`` for each row of ``items``: ``item_key``, ``rank``, ``key`` and ``score``.

    Terms belong to owners by their weight, rare ones first. A bundle of items, one for each block of documents,
    visits the owners one after the other (a cogroup each) and carries a sparse accumulator for each (item,
    document) it has met; the owner adds its whole integer contributions. After the last owner the best of
    each block are taken, then the best of all; ties go to the smaller key (a null one last).

    A block holds at most ``block`` documents and a bundle at most ``bundle`` items (both must divide 2 ** 33), so no group grows with the
    corpus, with the documents of a term or with the items of one. Texts are read once, their term counts are
    written; only terms of items go on. Rows with null, empty or termless texts are found by nothing and find
    nothing. Rows that repeat a key stand for themselves, on both sides. An empty table gives an empty result.
    No other column is carried, so none can clash.
    """
    ready(docs.sparkSession)
    source = term_counts(docs, key, text).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), "n", "terms")
    counted = settle(source.filter("n > 0"), "term_counts").withColumn("block", _div("row", block))
    queries = term_counts(items, item_key, item_text)
    asked = settle(queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).alias("of"), "terms"), "items")
    documents, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    terms = weighted_terms(counted, asked.select(F.explode("terms.term").alias("term")).distinct(), documents)

    wanted = asked.select("item", F.explode("terms").alias("t")).join(terms, F.col("t.term") == F.col("term"))
    ask = settle(
        wanted.select(
            _div("item", bundle).alias("bundle"), F.pmod("item", F.lit(bundle)).cast("int").alias("item"), "term_id", F.col("t.tf").alias("repeats")
        ),
        "asked",
    )
    bundles = ask.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("item", "term_id", "repeats"))).alias("ask")).select(
        "bundle", F.col("ask.item").alias("ask_item"), F.col("ask.term_id").alias("ask_term"), F.col("ask.repeats").alias("ask_repeats"),
        F.array().cast("array<int>").alias("acc_item"), F.array().cast("array<int>").alias("acc_row"), F.array().cast("array<long>").alias("acc_score"),
    )
    found = counted.select("row", "n", F.explode("terms").alias("t")).join(terms.filter("w > 0"), F.col("t.term") == F.col("term"))
    m = F.lit(100 - B).cast("long") + _div(F.lit(B).cast("long") * F.col("n") * F.lit(documents).cast("long"), max(length, 1))
    tf = F.col("t.tf")
    part = F.col("w") * _div(F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(K1).cast("long") * m)
    goes = ask.select("bundle", F.col("term_id").alias("asked_id")).distinct()
    postings = found.select("row", "term_id", "owner", part.alias("part")).filter("part > 0").join(goes, F.col("term_id") == F.col("asked_id"))
    postings = settle(postings.select("bundle", "row", "term_id", "owner", "part"), "postings").withColumn("block", _div("row", block))

    ids = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", "id"))).alias("ids"))
    held = ids.select("block", F.col("ids.row").alias("rows"), F.col("ids.id").alias("ids"))
    state = postings.select("bundle", "block").distinct().join(bundles, "bundle").join(held, "block")
    for owner in range(len(OWNERS) + 1):
        owned = postings.filter(F.col("owner") == owner).select(F.col("bundle").alias("to"), F.col("block").alias("over"), "term_id", "row", "part")
        state = state.groupBy("bundle", "block").cogroup(owned.groupBy("to", "over")).applyInArrow(
            lambda carried, postings: _visit(carried, postings, block, bundle), state.schema
        )

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, item, row, score, rows, held_ids = (batch.column(j).slice(i, 1) for j in range(6))
                item, row, score, rows = (x.flatten().to_numpy(zero_copy_only=False) for x in (item, row, score, rows))
                names = held_ids.flatten()
                # Rows of a block that hold no term are not among its ids.
                place = np.searchsorted(rows % block, row)
                best = _best(item.astype(np.int64), place, score, names, top)
                whole = of[0].as_py() * bundle + item[best].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(whole), names.take(pa.array(place[best])), pa.array(score[best])], ["item", "id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    finals = state.select("bundle", "acc_item", "acc_row", "acc_score", "rows", "ids").mapInArrow(select, f"item long, id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = finals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = asked.select(F.col("item").alias("of_item"), "of")
    return ranked.join(names, F.col("item") == F.col("of_item")).select(F.col("of").alias(item_key), "rank", F.col("id").alias(key), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each item of ``benchmark``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH terms AS (
  SELECT d, doc_id, w FROM (SELECT doc_id, text, row_number() OVER () AS d FROM documents),
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS u(w)
), asked AS (
  SELECT i, item_id, w, count(*) AS repeats FROM (SELECT item_id, text, row_number() OVER () AS i FROM benchmark),
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS u(w) GROUP BY ALL
), held AS (
  SELECT d, doc_id, w, count(*) AS tf FROM terms GROUP BY ALL
), docs AS (
  SELECT d, sum(tf)::BIGINT AS n FROM held GROUP BY d
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM docs
), weight AS (
  SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM held, whole GROUP BY w, docs
), parts AS (
  SELECT d, doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS part
  FROM held JOIN docs USING (d) JOIN weight USING (w), whole
), scores AS (
  SELECT i, item_id, d, doc_id, sum(repeats * part)::BIGINT AS score FROM asked JOIN parts USING (w) GROUP BY ALL
)
SELECT item_id, row_number() OVER best::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER best <= 20
"""
