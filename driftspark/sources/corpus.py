"""Source corpus scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions.patterns import ROUTE_SKIP_DIRS


def read_corpus(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("ts", "tsx", "js", "jsx")) -> DataFrame:
    """``source_files`` of a folder with one directory per repository.

    File extensions are decided while listing and directories before any content is read.
    """
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .text(root, wholetext=True)
    )
    # Listed paths carry a scheme and percent escapes; what follows the root is relative.
    base = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/") + "/"
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tail = path.substr(F.locate(base, path) + len(base), F.length(path))
    named = files.select(tail.alias("tail"), F.col("value").alias("content"))
    split = named.select(
        F.substring_index("tail", "/", 1).alias("repo"),
        F.col("tail").substr(F.locate("/", "tail") + 1, F.length("tail")).alias("rel_path"),
        "content",
    )
    return split.where(outside(F.col("rel_path"), ROUTE_SKIP_DIRS))


def outside(rel_path: Column, skipped: list[str]) -> Column:
    """True for paths without any of the skipped directories."""
    names = "|".join(name.replace(".", r"\.") for name in skipped)
    return ~rel_path.rlike(rf"(^|/)({names})/")
