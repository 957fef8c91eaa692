"""Exact nearest known vector: queries and references meet in numpy products, of all references or of what the index opens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from .metric import k_nearest

#: Fixed value: least squared distance from every known vector that makes a vector novel (strictly above).
NOVEL = 0.35
OUT = "query_id long, distance double, ref_id long, label string"


def _nearest(q: pd.DataFrame, ids: np.ndarray, labels: np.ndarray, refs: np.ndarray) -> pd.DataFrame:
    """ids rise, so that the first of equal distances is the smallest id."""
    out = []
    for i in range(0, len(q), 512):
        x = np.array(q["vector"].iloc[i : i + 512].tolist(), dtype=np.float64)
        rough = (x * x).sum(1)[:, None] + (refs * refs).sum(1) - 2 * x @ refs.T
        # the product form is rounded, by a share of the norms: take the differences of all that could be nearest
        own = (x * x).sum(1)[:, None] + (refs * refs).sum(1)
        margin = 4 * (x.shape[1] + 4) * np.finfo(float).eps * own.max(axis=1, keepdims=True)
        close = rough <= rough.min(axis=1, keepdims=True) + margin
        rows, cols = np.nonzero(close)
        exact = ((x[rows] - refs[cols]) ** 2).sum(1)
        order = np.lexsort((cols, exact, rows))
        first = order[np.unique(rows[order], return_index=True)[1]]
        out.append(pd.DataFrame({"query_id": q["query_id"].to_numpy()[i : i + 512], "distance": exact[first], "ref_id": ids[cols[first]], "label": labels[cols[first]]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "distance": [], "ref_id": [], "label": []})


def nearest_known(queries: DataFrame, refs: DataFrame, broadcast_rows: int = 20_000, block: int = 1_000, write=stored, report: list | None = None) -> DataFrame:
    """(query_id, distance, ref_id, label): the nearest row of refs (ref_id, label, vector) for each query (query_id, vector).

    distance is squared; ties go to the smallest ref_id; with no refs it is infinite and the label is `unknown`. Up to
    broadcast_rows references are broadcast, by count; more are searched by the metric index, with the same result. Of
    references with one vector the smallest ref_id, then label, stands for all; a null vector is no reference. report, if
    given, gets the number of (query, block) pairs that the index opened and the number that there are.
    """
    refs = refs.where("vector is not null").select(F.col("ref_id").cast("long"), F.col("label").cast("string"), F.col("vector").cast("array<double>"))
    queries = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    valid = queries.where("vector is not null")
    known = refs.limit(broadcast_rows + 1).toPandas()
    if len(known) <= broadcast_rows:
        known = known.sort_values(["ref_id", "label"])
        held = queries.sparkSession.sparkContext.broadcast((known["ref_id"].to_numpy(), known["label"].to_numpy(), np.array(known["vector"].tolist())))
        some = len(known) > 0

        def run(parts):
            for q in parts:
                if some:
                    yield _nearest(q, *held.value)

        found = valid.mapInPandas(run, OUT)
    else:
        one = write(refs.groupBy("vector").agg(F.min(F.struct("ref_id", "label")).alias("r")).select("r.*", "vector"))
        near = k_nearest(valid.withColumnRenamed("query_id", "id"), one.withColumnRenamed("ref_id", "id"), 1, write, rows=block, report=report)
        labels = one.groupBy("ref_id").agg(F.min("label").alias("label"))
        found = near.join(labels, "ref_id").select("query_id", F.col("d").alias("distance"), "ref_id", "label")
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("distance", F.lit(float("inf"))).alias("distance"), "ref_id", F.coalesce("label", F.lit("unknown")).alias("label")
    )


def nearest_label(queries: DataFrame, refs: DataFrame) -> DataFrame:
    return nearest_known(queries, refs).select("query_id", "label")


def novel(nearest: DataFrame, threshold: float = NOVEL) -> DataFrame:
    return nearest.where(F.col("distance") > threshold)


def novelty_summary(nearest: DataFrame, threshold: float = NOVEL) -> DataFrame:
    return nearest.agg(F.count_if(F.col("distance") > threshold).alias("novel"), F.count("*").alias("total"))
