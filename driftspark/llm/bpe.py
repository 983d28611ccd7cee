"""Operator 2: byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

from driftspark.llm.common import map_texts, ready, table

RANKS = "byte_bpe_multi_50k.tiktoken"
# Texts above this many code points are cut, at safe boundaries only.
PIECE = 1 << 15
# Single white space between two letters: every match of the pattern that contains the left letter ends
# before it, and no match that starts at it depends on what is to its left.
SAFE = re.compile(r"(?<=[^\W\d_])[ \n](?=[^\W\d_])")
# Runs of white space (as Unicode has it) from this length on are not put through the pattern, whose look-ahead
# would take a step of the stack for each of their characters. LAST are the alternatives that match such a run:
# all of it at the end of a text, else all but its last character; no other alternative takes two blanks.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % PIECE)
LAST = r"\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoding of a rank file (one per Python worker); each line is a base64 token and its rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` cut at safe boundaries into parts of ``size`` code points or a little more.

    Encoding the parts one by one gives the ids of the whole; a text without a safe boundary stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, coder) -> list[int]:
    if not text:
        return []
    if len(text) <= PIECE:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for whole, part in parted(text, BLANKS) if coder._pat_str.endswith(LAST) else [(False, text)]:
        if whole:
            ids += coder._encode_single_piece(part)
        else:
            for piece in pieces(part):
                ids += coder.encode_ordinary(piece)
    return ids


def parted(text: str, blanks: re.Pattern) -> Iterator[tuple[bool, str]]:
    """``text`` in parts that are encoded one by one; True marks one that is a single match of the pattern.

    Nothing that ends in front of a run of white space takes any of it, and what matches from there on does not
    depend on what is to its left, so the cuts change no match."""
    at = 0
    for run in blanks.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield False, text[at : run.start()]
        yield True, text[run.start() : end]
        at = end
    yield False, text[at:]


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every whole text, without special tokens.

    Null and empty texts have no ids; repeated rows give repeated rows; a null key is carried along.
    ``path`` is the rank file, which every executor must be able to open.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def make():
        coder = encoding(path, pattern)
        return lambda t: (encode_text(t, coder),)

    return map_texts(docs, [key], text, make, "ids array<int>")


def with_counts(
    docs: DataFrame, name: str = "n_tokens", text: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """``docs`` with ``name`` (long), the number of ids that :func:`encode` gives for the whole text: 0 for null and
    empty ones, for each row of repeated ones. A column ``name`` that is there already is replaced."""
    ready(docs.sparkSession)
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    @F.pandas_udf(LongType())
    def count(column: pd.Series) -> pd.Series:
        coder = encoding(path, pattern)
        return pd.Series([len(encode_text(t, coder)) for t in column], dtype="int64")

    return docs.withColumn(name, count(text))


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``tokens`` with ``decoded`` (binary): the raw bytes of the ids, valid UTF-8 or not.

    Null ids give no bytes.
    """
    ready(tokens.sparkSession)
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    @F.pandas_udf(BinaryType())
    def raw(column: pd.Series) -> pd.Series:
        coder = encoding(path, pattern)
        return pd.Series([b"" if x is None else coder.decode_bytes(x.tolist()) for x in column], dtype=object)

    return tokens.withColumn("decoded", raw(ids))


@F.pandas_udf(StringType())
def ids_sha256(column: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in column], dtype=object)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = encode(table(spark, sf_dir, "documents"))
    return decode(tokens).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_sha256("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
