"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors of a label are first folded into one with a count, so copies cost nothing more. The centroids are fitted
on at most `sample` folded vectors; every vector is then indexed, in the cell of its nearest centroid and in those
cells that a partner could have as its nearest: for partners at the threshold, at most chord * |c - c'| may separate
the two products, of which `slack` is allowed for (1.0 would make the search exact). A pair is counted in the smallest
cell that it shares. There is a cell for about `cell_rows` vectors of a label, up to a quarter of the sample; beyond that
cells grow, and nothing is left out: cells above `block` vectors are split into blocks by hash, and a task compares one
pair of blocks of one cell; it returns sums of links and a spanning forest, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels or vec_ids,
link with nothing; vectors of different length never link. Repeated vec_ids count as vectors of their own. A null
vec_id has no component and is kept. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, map_arrow, saved

ROWS = 256  # vectors whose products with all centroids are in memory at once


def fold_keys(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, size, k1, k2): vectors fit for comparison, with a 128-bit hash of their components."""

    def run(part):
        out = [[] for _ in range(6)]
        for i, label, v in zip(part["vec_id"].to_pylist(), part["label"].to_pylist(), part["embedding"].to_pylist(), strict=True):
            if i is None or label is None or not v or None in v:
                continue
            x = np.array(v, dtype=np.float64)
            if not np.isfinite(x).all() or not x.any() or not np.isfinite(norm := np.linalg.norm(x)) or norm == 0:
                continue
            h = np.frombuffer(xxhash.xxh3_128_digest((x + 0.0).tobytes()), dtype="<i8")
            for column, value in zip(out, (i, label, v, len(v), int(h[0]), int(h[1])), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int64(), pa.int64())
        return [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return map_arrow(rows, run, "vec_id long, label long, embedding array<double>, size int, k1 long, k2 long")


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centroids of the rows of x (unit vectors)."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        total = np.zeros_like(c)
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            np.add.at(total, (part @ c.T).argmax(axis=1), part)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def cells_of(x: np.ndarray, c: np.ndarray, chord: float, slack: float) -> list[list[int]]:
    """For unit rows the cell of the nearest centroid and those that a partner's nearest could be, sorted."""
    found = []
    for at in range(0, len(x), ROWS):
        products = x[at : at + ROWS] @ c.T
        home = products.argmax(axis=1)
        apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))
        inside = products >= products[np.arange(len(home)), home][:, None] - slack * chord * apart
        found += [np.flatnonzero(r).tolist() for r in inside]
    return found


def compare(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks: for each vector the linked weight, and an edge to the root of its local group."""
    one = pdf["b1"].iat[0] == pdf["b2"].iat[0]
    x = np.array(pdf["embedding"].tolist(), dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, weight = pdf["rep"].to_numpy(), pdf["weight"].to_numpy()
    # smaller cells that two of the vectors at least are in: a pair that shares one is counted there
    cell = pdf["cell"].iat[0]
    size = [len(v) for v in pdf["cells"]]
    owner, flat = np.repeat(np.arange(len(pdf)), size), np.concatenate([np.asarray(v) for v in pdf["cells"]])
    owner, flat = owner[flat < cell], flat[flat < cell]
    names, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    member = np.zeros((len(pdf), len(names)), dtype=np.float32)
    member[owner, column] = 1
    member = member[:, times > 1]
    left = np.arange(len(pdf)) if one else np.flatnonzero(pdf["block"].to_numpy() == pdf["b1"].to_numpy())
    right = left if one else np.flatnonzero(pdf["block"].to_numpy() == pdf["b2"].to_numpy())
    links = np.zeros(len(pdf), dtype=np.int64)
    root = np.arange(len(pdf))
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero((x[rows] @ x[right].T >= threshold) & (member[rows] @ member[right].T == 0))
        i, j = rows[i], right[j]
        if one:
            i, j = i[i < j], j[i < j]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        while True:  # smallest root of both ends, until nothing moves
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            root = root[root]
            if (root == before).all():
                break
    while (root[root] != root).any():
        root = root[root]
    hit = links > 0
    return pd.DataFrame({"rep": ids[hit], "links": links[hit], "root": ids[root[hit]]})


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 500, block: int = 1000, sample: int = 20_000, slack: float = 0.4
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links between vectors of equal label with cosine >= threshold."""
    rows = saved(fold_keys(vectors))
    key = ["label", "size", "k1", "k2"]
    folded = saved(rows.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")))
    spark = vectors.sparkSession
    n, groups = folded.agg(F.count("*"), F.count_distinct("label", "size")).first()
    k = int(max(1, min(sample // 4, n / max(groups, 1) / cell_rows)))
    tables = {}
    if k > 1:
        some = folded.orderBy(F.xxhash64("k1", "k2"), "rep").limit(sample).select("size", "embedding").toPandas()
        for size, part in some.groupby("size"):
            x = np.array(part["embedding"].tolist())
            tables[size] = centroids(x / np.linalg.norm(x, axis=1, keepdims=True), k)
    shared = spark.sparkContext.broadcast(tables)  # at most sample / 4 centroids for each vector length
    chord = float(np.sqrt(2 - 2 * threshold))

    def index(part):
        sizes, lists = part["size"].to_numpy(), part["embedding"].to_pylist()
        found = [[0]] * len(lists)
        for size in np.unique(sizes):
            c, rows = shared.value.get(int(size)), np.flatnonzero(sizes == size)
            if c is not None:
                x = np.array([lists[i] for i in rows])
                for i, cells in zip(rows, cells_of(x / np.linalg.norm(x, axis=1, keepdims=True), c, chord, slack), strict=True):
                    found[i] = cells
        return part["rep"], part["weight"], part["label"], part["size"], part["embedding"], pa.array(found, pa.list_(pa.int32()))

    schema = "rep long, weight long, label long, size int, embedding array<double>, cells array<int>"
    indexed = saved(map_arrow(folded.select("rep", "weight", "label", "size", "embedding"), index, schema))
    spread = indexed.withColumn("cell", F.explode("cells"))
    cell = ["label", "size", "cell"]
    counts = indexed.select("label", "size", F.explode("cells").alias("cell")).groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = spread.join(counts, cell).withColumn("block", F.pmod(F.xxhash64("rep", "cell"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("rep", "weight", "embedding", "cells", "block", *cell, F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    found = saved(
        pairs.groupBy(*cell, "b1", "b2").applyInPandas(lambda pdf: compare(pdf, threshold), "rep long, links long, root long")
    )
    forget(indexed)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    reps = folded.select(*key, "rep", "weight").join(linked, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    inside = rows.select("vec_id", *key).join(reps, key).select("vec_id", "n_links", "component_id")
    # rows not fit for comparison: all that the first pass left out
    every = vectors.select(F.col("vec_id").cast("long")).groupBy("vec_id").agg(F.count("*").alias("n_all"))
    fit = rows.groupBy(F.col("vec_id").alias("fit_id")).agg(F.count("*").alias("n_fit"))
    rest = every.join(fit, F.col("vec_id") == F.col("fit_id"), "left").withColumn("left_out", F.col("n_all") - F.coalesce("n_fit", F.lit(0))).where("left_out > 0")
    rest = rest.select("vec_id", F.explode(F.sequence(F.lit(1), F.col("left_out")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
