"""Writers. All of them can be run again with the same result: they replace what is there, or add only what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _exists
from .tables import upsert


def write_crops(crops: DataFrame, path: str) -> None:
    """Cut regions with their pixels, in 64 folders by a hash of the source image; what was there before goes."""
    crops.withColumn("part", F.pmod(F.xxhash64("image_path"), F.lit(64))).write.mode("overwrite").partitionBy("part").parquet(path)


def write_crop_sources(sources: DataFrame, path: str) -> None:
    """(stem, source_image, center) as JSON maps from stem to its image and box, one entry a line."""
    entry = F.struct("source_image", F.col("center").alias("bbox_normalized"))
    sources.select(F.to_json(F.create_map("stem", entry)).alias("value")).write.mode("overwrite").text(path)


def clean_run(spark: SparkSession, root: str, names: list[str]) -> None:
    """Deletes the folders of a run before the next one starts; those that are not there are no error."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_clusters(crops: DataFrame, path: str) -> None:
    """One folder a cluster; what was there before goes."""
    crops.write.mode("overwrite").partitionBy("cluster_name").parquet(path)


def write_manifest(nested: DataFrame, path: str, run: str) -> None:
    nested.write.mode("overwrite").json(f"{path}/run={run}")


def write_label_set(lines: DataFrame, path: str) -> None:
    """Label lines (split, source_image, lines) by split; only the splits given are replaced."""
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def write_class_descriptor(classes: DataFrame, path: str) -> None:
    """nc, names in order, and the places of both splits, as one JSON row (one entry a class)."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("class_id", "label"))), lambda x: x["label"])
    one = classes.agg(F.count("*").alias("nc"), names.alias("names"))
    one.select(F.lit("images/train").alias("train"), F.lit("images/val").alias("val"), "nc", "names").write.mode("overwrite").json(path)


def write_unknowns(classified: DataFrame, path: str) -> None:
    classified.where("classified_as = 'unknown'").select("image_path").write.mode("overwrite").json(path)


def write_annotations(annotations: DataFrame, path: str) -> None:
    """Adds to the cache, one JSON row an image: images that it has keep what they have."""
    upsert(annotations, path, ["image_path"], kind="json")


def write_step_metrics(metrics: DataFrame, path: str) -> None:
    """Adds the steps of runs that are not there yet, one row a run and step; runs are named by text."""
    upsert(metrics.withColumn("run", F.col("run").cast("string")), path, ["run", "step"])


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def reset_index(spark, path: str) -> None:
    save_index(spark.createDataFrame([], "ref_id long, label string, vector array<float>"), path)


def write_dataset_version(dataset: DataFrame, path: str, tag: str, message: str = "") -> None:
    """An immutable snapshot under its tag, and a row in the table of tags; an existing tag is left as it is."""
    dataset.write.mode("ignore").parquet(f"{path}/data/version={tag}")
    row = dataset.sparkSession.range(1).select(F.lit(tag).alias("tag"), F.lit(message).alias("message"), F.current_timestamp().alias("at"))
    upsert(row, f"{path}/tags", ["tag"], buckets=1)


def write_deployment(deployment: DataFrame, path: str) -> None:
    """Adds deployments (line, model, deployed_at, action) that are not there yet."""
    upsert(deployment, path, ["line", "model", "deployed_at"])


def reset_tables(spark: SparkSession, root: str, names: list[str], backup: str, index: DataFrame | None = None) -> None:
    """Every named table back to its backup; without one the index is rebuilt from the given rows, others are emptied."""
    for name in names:
        if _exists(spark, f"{backup}/{name}"):
            restore_table(spark, f"{backup}/{name}", f"{root}/{name}")
        elif name == "index" and index is not None:
            save_index(index, f"{root}/{name}")
        else:
            clean_run(spark, root, [name])


def restore_table(spark, snapshot: str, path: str) -> None:
    """A table back to its snapshot."""
    spark.read.parquet(snapshot).write.mode("overwrite").parquet(path)
