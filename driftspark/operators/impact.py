"""Who uses a broken field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions import patterns as P
from driftspark.session import settle

# Fixed values of the impact report: references listed per field and characters of each line (defaults).
MAX_REFERENCES = 12
MAX_TEXT = 120

# What JavaScript's trim() removes.
_SPACE = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
# Words, and every other character by itself.
_TOKEN = "(?s)[A-Za-z0-9_]+|[^A-Za-z0-9_]"


def broken_fields(changes: DataFrame) -> DataFrame:
    """Response fields named by breaking changes."""
    return changes.where((F.col("change_type") == "breaking") & F.col("message").contains('"response.')).select(
        "*", F.regexp_extract("message", r'"response\.([^"]+)"', 1).alias("field_name")
    ).where("field_name <> ''")


def consumer_files(files: DataFrame) -> DataFrame:
    """Script files outside API and build directories; decided by the path alone."""
    path = F.col("rel_path")
    skipped = "|".join(d.replace(".", r"\.") for d in P.CONSUMER_SKIP_DIRS)
    return files.where(
        path.rlike(rf"[^/]\.({'|'.join(P.CONSUMER_EXTENSIONS)})$")
        & ~path.rlike(rf"(^|/)({skipped})/")
        & ~path.contains("app/api")
        & ~path.contains("pages/api")
    )


def _anchor(field: Column) -> Column:
    """A token every line that mentions the field must contain: its longest word, else its first character."""
    words = F.regexp_extract_all(field, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    longest = F.element_at(
        F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1
    )["w"]
    return F.when(F.size(words) > 0, longest).otherwise(F.substring(field, 1, 1))


def _whole_word(field: Column) -> Column:
    """Pattern for the field between word boundaries, its characters taken literally."""
    quoted = F.regexp_replace(field, r"([^A-Za-z0-9_])", r"\\$1")

    def edge(char: Column, behind: bool) -> Column:
        look = "?<" if behind else "?"
        word = char.rlike("[A-Za-z0-9_]")
        return F.when(word, f"({look}!{P.WORD})").otherwise(f"({look}={P.WORD})")

    return F.concat(edge(F.substring(field, 1, 1), True), quoted, edge(F.substring(field, -1, 1), False))


_PLAIN = "^[A-Za-z0-9_]+$"


def _wanted(fields: DataFrame) -> DataFrame:
    """Names with the word to look for, written, so that Spark knows their true size: names that can be broadcast meet
    the words where these are found."""
    names = fields.select("repo", "field").where("field <> ''").distinct()
    return settle(names.select("repo", "field", _anchor(F.col("field")).alias("token"), (~F.col("field").rlike(_PLAIN)).alias("odd")), "wanted")


def _mentions(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(repo, rel_path, i, field, odd) of the lines that hold the word of a name; ``i`` counts from 0."""
    numbered = files.select("repo", "rel_path", F.posexplode(F.split("content", "\n", -1)).alias("i", "raw"))
    tokens = F.array_distinct(F.regexp_extract_all(F.col("raw"), F.lit(_TOKEN), F.lit(0)))
    return numbered.select("repo", "rel_path", "i", F.explode(tokens).alias("token")).join(wanted, ["repo", "token"]).drop("token")


def _shown(raw: Column, max_text: int | None) -> Column:
    text = F.regexp_replace(raw, f"^{_SPACE}+|{_SPACE}+$", "")
    return text if max_text is None else F.substring(text, 1, max_text)


def consumer_lines(files: DataFrame, fields: DataFrame, max_text: int | None = None) -> DataFrame:
    """Every (repo, field, file, line) where a field name stands as a whole word, with the line's text.

    ``fields`` holds (repo, field). Words are extracted once: each line gives its distinct words (and, for
    names made of odd characters only, its odd characters), which meet the names by an equi-join on
    (repo, word). A name of several words is sought by its longest word and confirmed on the text of the line.
    Only (file, line, name) moves until the names are found; the contents of files with a hit are then read
    once more. ``max_text`` cuts the shown text to so many characters; without it, lines come whole.
    """
    files = consumer_files(files)
    found = (
        _mentions(files, _wanted(fields))
        .groupBy("repo", "rel_path", "i")
        .agg(F.collect_list(F.struct("field", "odd")).alias("names"))
        .groupBy("repo", "rel_path")
        .agg(F.collect_list(F.struct("i", "names")).alias("hits"))
    )
    split = F.split("content", "\n", -1)
    lines = files.join(found, ["repo", "rel_path"]).select("repo", F.col("rel_path").alias("file"), split.alias("all"), F.explode("hits").alias("h"))
    raw = lines.select("repo", "file", F.col("h.i").alias("i"), F.get("all", F.col("h.i")).alias("raw"), F.col("h.names").alias("names"))
    shown = raw.withColumn("text", _shown(F.col("raw"), max_text))
    each = shown.select("repo", F.explode("names").alias("n"), "file", (F.col("i") + 1).alias("line"), "text", "raw")
    here = ~F.col("n.odd") | (F.contains("raw", F.col("n.field")) & F.rlike(F.col("raw"), _whole_word(F.col("n.field"))))
    return each.where(here).select("repo", F.col("n.field").alias("field"), "file", "line", "text")


def consumer_refs(
    files: DataFrame, fields: DataFrame, limit: int | None = MAX_REFERENCES, max_text: int | None = MAX_TEXT
) -> DataFrame:
    """The first ``limit`` references per (repo, field), by file and line, all with ``limit=None``.

    ``total`` is the number of references of the field before the limit. The rank is limited inside each task
    before the shuffle, so a name used in a third of all lines still moves ``limit`` rows per task. Words alone tell
    where a plain name stands, so its references are counted and ranked without their texts; only the files of the
    listed ones are read again.
    """
    if limit is None:
        return consumer_lines(files, fields, max_text)
    files = consumer_files(files)
    wanted = _wanted(fields)
    # Files that share a path count once for each of them, as many times as their lines meet it.
    shared = files.groupBy("repo", "rel_path").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = settle(shared, "shared")
    plain = _mentions(files, wanted.where("NOT odd")).join(shared, ["repo", "rel_path"], "left")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))).alias("copy")
    refs = plain.select("repo", "field", F.col("rel_path").alias("file"), (F.col("i") + 1).alias("line"), copy, F.lit(None).cast("string").alias("text"))
    odd = wanted.where("odd")
    if not odd.isEmpty():
        confirmed = consumer_lines(files, odd, max_text)
        refs = refs.unionByName(confirmed.withColumn("copy", F.lit(None).cast("long")))
    refs = settle(refs, "references")
    # Read twice, so rows that tie are equal in every column.
    first = Window.partitionBy("repo", "field").orderBy("file", "line", "copy", "text")
    ranked = refs.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)
    totals = refs.groupBy("repo", "field").agg(F.count(F.lit(1)).alias("total"))
    listed = ranked.where("copy IS NOT NULL").groupBy("repo", F.col("file").alias("rel_path")).agg(
        F.collect_list(F.struct("field", "rank", "line", "copy")).alias("hits")
    )
    lines = files.join(settle(listed, "listed"), ["repo", "rel_path"]).select(
        "repo", F.split("content", "\n", -1).alias("all"), F.explode("hits").alias("h")
    ).select("repo", "h.field", "h.rank", "h.copy", _shown(F.get("all", F.col("h.line") - 1), max_text).alias("text"))
    texts = lines.groupBy("repo", "field", "rank", "copy").agg(F.array_sort(F.collect_list(F.struct("text"))).alias("texts"))
    read = texts.select("repo", "field", "rank", F.get("texts", (F.col("copy") - 1).cast("int"))["text"].alias("read"))
    out = ["repo", "field", "file", "line", F.coalesce("read", "text").alias("text"), "total"]
    return ranked.join(read, ["repo", "field", "rank"], "left").join(totals, ["repo", "field"]).select(*out)


def impact_table(fields: DataFrame, refs: DataFrame) -> DataFrame:
    """C4: the references per broken field, counted in full and listed as one text, ``none found`` without any.

    ``refs`` comes from :func:`consumer_refs` with a limit, so that a listing is bounded."""
    listing = F.transform(
        F.array_sort(F.collect_list(F.struct("file", "line", "text"))),
        lambda r: F.concat(F.lit("  "), r.file, F.lit(":"), r.line.cast("string"), F.lit("  "), r.text),
    )
    per_field = refs.groupBy("repo", "field").agg(
        F.max("total").alias("references"), F.array_join(listing, "\n").alias("listing")
    )
    return fields.select("repo", "field").distinct().join(per_field, ["repo", "field"], "left").select(
        "repo", "field",
        F.coalesce("references", F.lit(0)).alias("references"),
        F.coalesce("listing", F.lit("none found")).alias("listing"),
    )
