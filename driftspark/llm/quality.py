"""Operator 8: quality rules on repetition, from a suffix array over the words of each text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from driftspark.llm.common import WORD, map_texts, ready, table

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
# A text fails the base rules with fewer words, or when more of its words lie in repeated windows.
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 0.30
# The method's limits: repeats of at least so many words, the part of the words they may cover, and how long
# one of them may be.
REPEAT, MAX_COVERED, MAX_LONGEST = 6, 0.30, 100


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of ``codes`` (ints from 0 up), and their ranks by 1, 2, 4, ... leading words.

    Prefix doubling: each round sorts by pairs of ranks; it ends as soon as all ranks differ. Ranks are kept in
    32 bits, so a text of n words takes 4 n bytes a round, n times 12 + 4 log n at the widest.
    """
    n = len(codes)
    rank = codes.astype(np.int32)
    levels = [rank]
    width = 1
    while True:
        pair = rank.astype(np.int64) * (n + 1)
        pair[: max(n - width, 0)] += rank[width:] + 1
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        differ = np.zeros(n, bool)
        np.not_equal(pair[1:], pair[:-1], out=differ[1:])
        fresh = np.empty(n, np.int32)
        fresh[order] = np.cumsum(differ, dtype=np.int32)
        del pair
        rank, width = fresh, width * 2
        if rank[order[-1]] == n - 1 or width >= 2 * n:
            return order, levels
        levels.append(rank)


def repeated_lengths(codes: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on are found again elsewhere in the text.

    That is the longest common prefix with the neighbours in the suffix array, read off the ranks of the
    doubling rounds from the widest to the narrowest.
    """
    n = len(codes)
    if n < 2:
        return np.zeros(n, np.int64)
    order, levels = suffix_array(codes)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = np.r_[levels[level], -1]
        same = (left < n) & (right < n)
        same &= ranks[np.minimum(left, n)] == ranks[np.minimum(right, n)]
        step = np.where(same, 1 << level, 0)
        common += step
        left += step
        right += step
    out = np.zeros(n, np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """Size of the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeat_spans(lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal repeats of ``least`` words or more, from :func:`repeated_lengths`.

    A word's length is that of the deepest interval of common prefixes that its suffix lies in. A repeat that
    is the tail of the one at the word before is left out: that one covers it.
    """
    inner = np.zeros(len(lengths), bool)
    inner[1:] = lengths[:-1] == lengths[1:] + 1
    starts = np.flatnonzero((lengths >= least) & ~inner)
    return starts, lengths[starts]


def maximal_repeats(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, words) of the maximal repeats of ``least`` words or more of a text."""
    starts, lengths = repeat_spans(repeated_lengths(codes), least)
    return list(zip(starts.tolist(), lengths.tolist()))


def measures(text: str | None, least: int = REPEAT) -> tuple[int, int, int, int, int, int, int]:
    """words, characters in words, symbols, duplicate lines, words in repeated windows, words covered by
    repeats, longest repeat."""
    words = WORDS.findall(text) if text else []
    if not words:
        return 0, 0, sum(text.count(c) for c in SYMBOLS) if text else 0, 0, 0, 0, 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(words)
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif WORDS.search(line):
            seen.add(line)
    lengths = repeated_lengths(codes) if len(ids) < n else np.zeros(n, np.int64)
    windows = np.flatnonzero(lengths >= WINDOW)
    repeats, repeated = repeat_spans(lengths, least)
    return (
        n,
        sum(map(len, words)),
        sum(text.count(c) for c in SYMBOLS),
        duplicates,
        covered(windows, np.full(len(windows), WINDOW), n) if len(windows) else 0,
        covered(repeats, repeated, n) if len(repeats) else 0,
        int(repeated.max()) if len(repeats) else 0,
    )


def assess(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = REPEAT,
    max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """``key``, the measures of every whole text, ``base_failed`` and ``kept``.

    ``kept`` is false where the base rules fail, where repeats of ``least`` words or more cover over
    ``max_covered`` of the words, or where one repeat is longer than ``max_longest`` words. Null and empty
    texts have no words and so fail; repeated rows are judged alike; a null key is carried along.
    """
    measured = map_texts(
        docs, [key], text, lambda: lambda t: measures(t, least),
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "covered_words long, longest_repeat long",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MAX_REPEATED) * F.col("n_words"))
    within = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))


def filtered(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that are kept by :func:`assess`, columns unchanged; rows without a key are judged too."""
    ready(docs.sparkSession)
    least = limits.get("least", REPEAT)
    max_covered, max_longest = limits.get("max_covered", MAX_COVERED), limits.get("max_longest", MAX_LONGEST)

    @F.pandas_udf(BooleanType())
    def good(column: pd.Series) -> pd.Series:
        return pd.Series([passes(measures(t, least), max_covered, max_longest) for t in column], dtype=bool)

    return docs.filter(good(text))


def passes(m: tuple[int, int, int, int, int, int, int], max_covered: float, max_longest: int) -> bool:
    n, repeated, inside, longest = m[0], m[4], m[5], m[6]
    failed = n < MIN_WORDS or 100 * repeated > round(100 * MAX_REPEATED) * n
    return not failed and inside <= max_covered * n and longest <= max_longest
