"""Files: images, label lines, JSON documents and tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import parent_name, path_stem, path_suffix

#: Suffixes of image files; size, mean and deviation of prepared images (red, green, blue).
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
SIDE, MEAN, STD = 224, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
IMAGE = "image_path string, height int, width int, channels int, data binary"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_images(spark: SparkSession, directory: str, suffixes=SUFFIXES, recursive: bool = False) -> DataFrame:
    """(image_path, length, content) of image files by suffix in any case; a missing directory has none."""
    if not _exists(spark, directory):
        return spark.createDataFrame([], "image_path string, length long, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return files.where(path_suffix(F.col("path")).isin(list(suffixes))).select(F.col("path").alias("image_path"), "length", "content")


def scan_labeled_images(spark: SparkSession, directory: str, by_directory: bool = True, allowed: list[str] | None = None) -> DataFrame:
    """Images with label: the name of their directory, or `known` when flat; optionally only allowed labels in any case."""
    found = scan_images(spark, directory, recursive=by_directory)
    found = found.withColumn("label", parent_name(F.col("image_path")) if by_directory else F.lit("known"))
    return found if allowed is None else found.where(F.lower("label").isin([x.lower() for x in allowed]))


def decode_images(spark: SparkSession, directory: str, keep_broken: bool = False) -> DataFrame:
    """Pixels (blue, green, red) of the files that can be read; with keep_broken the others too, with height -1 and no data."""
    found = spark.read.format("image").option("dropInvalid", str(not keep_broken).lower()).option("recursiveFileLookup", "true").load(directory)
    # the image reader writes paths as addresses; scan_images has them as the file system does
    path = F.regexp_replace(F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return found.select(path.alias("image_path"), *[F.col(f"image.{a}").alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the 3 x 3 Laplacian with mirrored borders."""
    p = np.pad(gray.astype(float), 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray.astype(float), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def crop_pixels(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes (image_path, crop_path, px) cut out of images, with the Laplacian variance of the grey crop."""
    both = boxes.select("image_path", "crop_path", "px").join(images, "image_path")

    def cut(parts):
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                y1, x1, y2, x2 = r.px
                c = np.ascontiguousarray(_pixels(r)[y1:y2, x1:x2])
                if c.size:
                    gray = c[..., 0] if r.channels == 1 else np.rint(c[..., 0] * 0.114 + c[..., 1] * 0.587 + c[..., 2] * 0.299)
                    out.append((r.crop_path, r.image_path, c.shape[0], c.shape[1], r.channels, c.tobytes(), laplacian_variance(gray)))
            yield pd.DataFrame(out, columns=["crop_path", "image_path", "height", "width", "channels", "data", "variance"])

    return both.mapInPandas(cut, "crop_path string, image_path string, height int, width int, channels int, data binary, variance double")


def resize_weights(n: int, side: int) -> np.ndarray:
    """side x n weights of a bilinear resize; when it shrinks, the triangle covers all pixels of a cell."""
    scale = n / side
    reach = max(scale, 1.0)
    center = (np.arange(side)[:, None] + 0.5) * scale
    w = np.maximum(0, 1 - np.abs((np.arange(n)[None, :] + 0.5 - center) / reach))
    return w / w.sum(axis=1, keepdims=True)


def preprocess_images(images: DataFrame, side: int = SIDE) -> DataFrame:
    """(image_path, tensor, error): resized to side x side, scaled, less the mean, over the deviation; channel first.

    An image that could not be decoded has a tensor of zeros and an error.
    """

    def run(parts):
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                if r.height <= 0 or r.width <= 0:
                    out.append((r.image_path, [0.0] * (3 * side * side), "the image can't be read"))
                    continue
                p = _pixels(r)[..., ::-1] if r.channels >= 3 else np.repeat(_pixels(r)[..., :1], 3, axis=2)
                rgb = np.einsum("ij,jkc,lk->ilc", resize_weights(r.height, side), p[..., -3:].astype(float), resize_weights(r.width, side), optimize=True)
                t = (np.rint(rgb) / 255.0 - np.array(MEAN)) / np.array(STD)
                out.append((r.image_path, t.transpose(2, 0, 1).astype(np.float32).ravel().tolist(), None))
            yield pd.DataFrame(out, columns=["image_path", "tensor", "error"])

    return images.mapInPandas(run, "image_path string, tensor array<float>, error string")


def missing_directories(spark: SparkSession, root: str, needed: tuple = ("images/train", "images/val", "labels/train", "labels/val")) -> DataFrame:
    """(fault): the folders of a label set that are not there."""
    return spark.createDataFrame([(f"missing directory {d}",) for d in needed if not _exists(spark, f"{root}/{d}")], "fault string")


def read_label_lines(spark: SparkSession, directory: str) -> DataFrame:
    """(split, stem, line_no, line) of text files in <directory>/<split>/."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(directory)
    path = F.col("_metadata.file_path")
    rows = files.select(parent_name(path).alias("split"), path_stem(path).alias("stem"), F.posexplode(F.split(F.trim("value"), "\n")).alias("n", "line"))
    return rows.select("split", "stem", (F.col("n") + 1).alias("line_no"), "line")


def read_crop_sources(raw: DataFrame) -> DataFrame:
    """(stem, source_image, center) from JSON maps (value)."""
    kind = "map<string, struct<source_image string, bbox_normalized array<double>>>"
    return raw.select(F.explode(F.from_json("value", kind)).alias("stem", "s")).select("stem", "s.source_image", F.col("s.bbox_normalized").alias("center"))


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, label, vector); a missing index is empty, so that everything is novel."""
    schema = "ref_id long, label string, vector array<float>"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, step, status, latency, items, failures) of all runs; none where nothing was written."""
    schema = "run string, step string, status string, latency double, items long, failures long"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.read.schema(schema).parquet(path).select(names) if _exists(spark, path) else spark.createDataFrame([], schema)


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, bool]:
    """Cached annotations, and whether the cache counts: at least one row has findings.

    multi_line: the file is one JSON document; else it has one a line, as write_annotations leaves it.
    """
    schema = "image_path string, image_name string, anomalies_found boolean, findings array<struct<box_2d array<double>, physical_traits string>>, prompt_tokens int, error string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema), False
    found = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)
    found = found.select("image_path", "image_name", "anomalies_found", "findings", "prompt_tokens", "error")
    return found, bool(found.where(F.size("findings") > 0).limit(1).count())
