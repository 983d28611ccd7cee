"""Operator 1: near-duplicate embeddings by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm.common import ready, table
from driftspark.llm.components import components
from driftspark.session import settle

THRESHOLD = 0.93
# Vectors of a tile: the product of two tiles takes 16 MB.
TILE = 2048
# Covers rounding in the double-precision bound itself.
SLACK = 1e-9


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales and error norms of the unit vectors of ``vectors`` (rows, double).

    The error of a vector is the length of what its codes miss, so for unit u, v the product u.v differs
    from scale_u * scale_v * (code_u . code_v) by at most error_u + (1 + error_u) * error_v.
    """
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, error


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``left``, row of ``right``) with cosine >= ``threshold`` in double precision; with
    ``same``, both sides are one tile and only pairs with a smaller left row count.

    Int8 products come first; only pairs that their error bound leaves possible are computed again.
    """
    ql, sl, el = quantise(left)
    qr, sr, er = (ql, sl, el) if same else quantise(right)
    # Sums of products of int8 are exact in single precision up to 1,040 dimensions, in double far beyond.
    exact = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    found_l, found_r = [], []
    wide = qr.astype(exact).T
    for start in range(0, len(left), 512):
        part = slice(start, start + 512)
        estimate = (ql[part].astype(exact) @ wide).astype(np.float64)
        estimate *= sl[part, None]
        estimate *= sr[None, :]
        bound = el[part, None] + (1.0 + el[part, None]) * er[None, :] + SLACK
        i, j = np.nonzero(estimate + bound >= threshold)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            a, b = left[i[at : at + (1 << 16)]], right[j[at : at + (1 << 16)]]
            cosine = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            good = cosine >= threshold
            found_l.append(i[at : at + (1 << 16)][good])
            found_r.append(j[at : at + (1 << 16)][good])
    if not found_l:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_l), np.concatenate(found_r)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches over the links ``a`` - ``b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        np.minimum.at(fresh, root[a], low)
        np.minimum.at(fresh, root[b], low)
        fresh = fresh[fresh]
        if (fresh == root).all() and (fresh[a] == fresh[b]).all():
            return root
        root = fresh


def tile_links(data: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of tiles: each linked vector with the number of its links here, counting copies, and
    the smallest vector that it reaches over them."""
    data = data.sort_by([("side", "ascending"), ("rep", "ascending")])
    side = data.column("side").to_numpy()
    rep = data.column("rep").to_numpy()
    copies = data.column("copies").to_numpy()
    vectors = data.column("vector").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    cut = int(np.searchsorted(side, 1))
    if cut == len(side):  # a tile with itself
        a, b = linked_pairs(flat, flat, threshold, True)
    else:
        a, b = linked_pairs(flat[:cut], flat[cut:], threshold, False)
        b = b + cut
    links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
    some = np.flatnonzero(links)
    low = np.argsort(np.argsort(rep, kind="stable"), kind="stable")  # so that the root is the smallest id
    root = np.sort(rep)[forest(len(rep), low[a], low[b])][low] if len(rep) else rep
    return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[some]})


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, tile: int = TILE,
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    All vectors of one label and length are compared, tile against tile; null labels, vectors that are null,
    empty, zero or hold nulls or non-finite numbers link with nothing. Equal vectors of one label are
    compared once and count as often as they occur. A label of any size is spread: its tiles hold about
    ``tile`` vectors each, a task gets two, and sends on one row for each linked vector, never the pairs.
    Rows that repeat key, vector and label count once; rows with a null key link with nothing, have a null
    component and are kept.
    """
    ready(rows.sparkSession)
    number = F.col(vector)
    sound = F.coalesce(
        F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(number, lambda x: x != 0)
        & F.col(label).isNotNull() & F.col(key).isNotNull(),
        F.lit(False),
    )
    one = rows.select(F.col(key), number.alias("vector"), F.col(label).alias("label")).distinct()
    valid = one.filter(sound).select(F.col(key).alias("id"), "label", "vector")
    reps = valid.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vector"))
    reps = settle(reps, "representatives")
    tiles = reps.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = reps.join(tiles, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "copies", "vector",
    )
    kind = rows.schema[key].dataType.simpleString()
    found = settle(
        sent.groupBy("label", "dim", "i", "j").applyInArrow(
            lambda data: tile_links(data, threshold), f"rep {kind}, links long, root {kind}"
        ),
        "tile_links",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    judged = reps.join(links, "rep", "left").join(roots, F.col("rep") == F.col("id"), "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    linked = valid.join(judged, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select(
        F.col("id").alias(key), "n_links", "component_id"
    )
    alone = one.filter(~sound).select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
