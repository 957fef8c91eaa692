"""Models that the caller supplies: embedding, scoring, annotation; and steps that record how they went."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from .classes import register_classes


def embed_images(tensors: DataFrame, make_fn: Callable, batch_size: int = 32) -> DataFrame:
    """tensors (crop_path, tensor) as unit vectors; make_fn() gives a function from a batch array to a batch of vectors."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    size = tensors.select(F.size("tensor")).first()
    model = predict_batch_udf(make_fn, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[size[0] if size else 1]])
    raw = tensors.select("crop_path", model("tensor").alias("_raw"))
    return raw.select("crop_path", l2_normalize(F.col("_raw")).cast("array<float>").alias("vector"))


def score_images(images: DataFrame, make_fn: Callable, batch_size: int = 16) -> DataFrame:
    """Detections of images; make_fn() gives a function from a list of rows to rows of (image_path, class_id, class_name, confidence, bbox_xyxy)."""

    def run(parts):
        model = make_fn()
        for pdf in parts:
            for i in range(0, len(pdf), batch_size):
                rows = model(pdf.iloc[i : i + batch_size].to_dict("records"))
                yield pd.DataFrame(rows, columns=["image_path", "class_id", "class_name", "confidence", "bbox_xyxy"])

    return images.mapInPandas(run, "image_path string, class_id int, class_name string, confidence double, bbox_xyxy array<double>")


def annotate_images(images: DataFrame, make_fn: Callable, parallel: int = 1, tries: int = 5, pause: float = 4.5, sleep: Callable = time.sleep) -> DataFrame:
    """(image_path, reply, error): make_fn() gives a function from a path to a reply; failures wait 2, 4, 8, ... seconds.

    Write the result before any other use: a second evaluation would call again.
    """

    def run(parts):
        call = make_fn()
        for pdf in parts:
            out = []
            for path in pdf["image_path"]:
                reply = error = None
                for k in range(tries):
                    try:
                        reply, error = call(path), None
                        break
                    except Exception as e:  # the caller's function may raise anything
                        error = str(e)
                        if k + 1 < tries:
                            sleep(2 ** (k + 1))
                out.append((path, reply, error))
                sleep(pause)
            yield pd.DataFrame(out, columns=["image_path", "reply", "error"])

    return images.select("image_path").repartition(parallel).mapInPandas(run, "image_path string, reply string, error string")


def build_index(vectors: DataFrame) -> DataFrame:
    """(ref_id, label, vector) of labelled unit vectors; ref_id is a hash of the crop's path."""
    return vectors.where("label is not null and vector is not null").select(F.xxhash64("crop_path").alias("ref_id"), "label", "vector")


def rebuild_index(vectors: DataFrame, events: DataFrame, source: str, at) -> tuple[DataFrame, DataFrame]:
    """(index, class events): the index of all labelled vectors, with its classes registered where they are new."""
    index = build_index(vectors)
    return index, register_classes(events, index.select(F.col("label").alias("class_name")), source, at)


def run_step(name: str, step: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame], empty: DataFrame) -> tuple[DataFrame, dict]:
    """A step's stored result and its record; if it raises, the empty table and the error."""
    began = time.time()
    record = {"step": name, "status": "success", "error": None}
    try:
        out = write(step())
        record["items"] = out.count()
    except Exception as e:  # any failure is recorded and the run goes on
        out, record = empty, record | {"status": "failed", "error": str(e), "items": 0}
    return out, record | {"latency": round(time.time() - began, 3)}


def random_projection(size: int, seed: int = 0) -> Callable:
    """A stand-in for an embedding model: make_fn of a fixed random projection to `size` numbers."""

    def make_fn():
        def embed(x: np.ndarray) -> np.ndarray:
            return x @ np.random.default_rng(seed).standard_normal((x.shape[1], size)).astype(np.float32)

        return embed

    return make_fn
