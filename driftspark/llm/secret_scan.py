"""Operator 9: secret scans by patterns and by token efficiency."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from driftspark.llm.bpe import encoding
from driftspark.llm.common import map_texts, ready, table

VOCABULARY = "byte_bpe_50k.tiktoken"
KINDS = ("assign", "access", "hex", "opaque")
# Letters in either case are ASCII letters only, hence the ASCII flag.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
# A run is taken whole, so a run that is too short fails wherever it is entered: the length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# Strings that may be random: runs of the characters that keys are written in.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
# Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
# Parts of an identifier: words in one case, numbers of up to six digits.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^A-Za-z0-9]+")
# Characters per token below which a string counts as random; words of any of our languages have more.
RATIO = 2.0


def is_known(text: str) -> bool:
    """Digests of known lengths, UUIDs and plain numbers."""
    return bool(UUID.fullmatch(text)) or text.isdigit() or (len(text) in DIGESTS and HEX_RUN.fullmatch(text) is not None)


def efficiency(text: str, coder) -> float:
    """Characters per token. Of a string of letters that falls into parts of four letters or more on average,
    a possible word or compound name, each part counts as a word in lower case behind a blank, as texts have
    it: then words lie above the ratio in any case and joined in any way, and random letters below it."""
    words = [p for p in PART.findall(text) if p[0].isalpha()]
    letters = sum(map(len, words))
    if words and letters >= 4 * len(words) and not any(c.isdigit() for c in text):
        return letters / sum(len(coder.encode_ordinary(" " + word.lower())) for word in words)
    return len(text) / len(coder.encode_ordinary(text))


def random_strings(text: str, coder, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Spans of strings with under ``ratio`` characters per token that are no known digests, UUIDs or numbers."""
    spans = []
    for match in CANDIDATE.finditer(text):
        value = match.group().strip("=-_/+")
        if len(value) < 20 or is_known(value):
            continue
        if efficiency(value, coder) < ratio:
            start = match.start() + match.group().index(value)
            spans.append((start, start + len(value)))
    return spans


def spans_of(text: str, coder, ratio: float = RATIO) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` by start, then kind as listed; code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ("passw", "secret", "token", "api_key", "apikey")):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [
        ("opaque", start, end)
        for start, end in random_strings(text, coder, ratio)
        if not any(a < end and start < b for _, a, b in found)
    ]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ratio: float = RATIO
) -> DataFrame:
    """``key`` and ``spans`` (array of kind, start, end) of every whole text.

    ``assign``, ``access`` and ``hex`` are patterns; ``opaque`` is what the token-efficiency test adds where
    none of them overlaps. Null and empty texts have no spans; repeated rows give repeated rows.
    """
    path, pattern = path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN

    def make():
        coder = encoding(path, pattern)

        def work(t: str | None):
            return ([{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, coder, ratio)] if t else [],)

        return work

    return map_texts(docs, [key], text, make, "spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text: str = "text", mask: str = "<secret>", path: str | None = None, ratio: float = RATIO) -> DataFrame:
    """``docs`` with every span of every kind replaced by ``mask`` (overlapping spans by one); columns unchanged.

    ``n_chars``, where there is one, is set to the new length. Texts without spans, empty and null ones stay
    as they are.
    """
    ready(docs.sparkSession)
    path, pattern = path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN

    @F.pandas_udf(StringType())
    def masked(column):
        coder = encoding(path, pattern)
        return column.map(lambda t: mask_text(t, spans_of(t, coder, ratio), mask) if t else t)

    out = docs.withColumn(text, masked(text))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mask_text(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("opaque"),
    )
