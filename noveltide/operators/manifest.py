"""The manifest: cluster assignments with crop metadata, and the edits that people make to it.

A manifest is flat: one row a crop with crop_path, cluster_id, cluster_name, defect_name and the crop's metadata.
Edits give a new table; counts are always derived.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import path_name
from .indexing import running_index

CROP = "struct<crop_path string, source_image string, finding_index int, physical_traits string>"
MANIFEST = f"map<string, struct<cluster_id int, crop_count int, defect_name string, crops array<{CROP}>>>"


def cluster_name(cluster_id: Column) -> Column:
    return F.when(cluster_id == -1, "noise").otherwise(F.format_string("cluster_%03d", cluster_id))


def attach_crop_metadata(crops: DataFrame, metadata: DataFrame) -> DataFrame:
    """crops with source_image, physical_traits and finding_index by file name; missing gives defaults, last of several wins."""
    last = metadata.groupBy(path_name(F.col("crop_path")).alias("_name")).agg(F.max_by(F.struct("source_image", "physical_traits", "finding_index"), F.col("seq")).alias("_m"))
    both = crops.withColumn("_name", path_name(F.col("crop_path"))).join(last, "_name", "left")
    return both.select(
        *crops.columns,
        F.coalesce("_m.source_image", F.lit("")).alias("source_image"),
        F.coalesce("_m.physical_traits", F.lit("")).alias("physical_traits"),
        F.coalesce("_m.finding_index", F.lit(0)).alias("finding_index"),
    )


def build_manifest(flat: DataFrame) -> DataFrame:
    """One row a cluster: cluster_name, cluster_id, crop_count, defect_name, crops in path order."""
    crop = F.struct("crop_path", "source_image", "finding_index", "physical_traits")
    return flat.groupBy("cluster_name").agg(
        F.min("cluster_id").alias("cluster_id"), F.count("*").cast("int").alias("crop_count"), F.max("defect_name").alias("defect_name"), F.sort_array(F.collect_list(crop)).alias("crops")
    )


def cluster_pages(flat: DataFrame, write, rows: int = 1000) -> DataFrame:
    """(cluster_name, page, crop_paths): each cluster's crops in path order, in pages from 0 of at most `rows` crops.

    Places come from one running number over all crops, so that no task holds a cluster whole.
    """
    placed = write(running_index(flat.select("cluster_name", "crop_path"), write, "cluster_name", "crop_path"))
    first = placed.groupBy("cluster_name").agg(F.min("index").alias("first"))
    page = F.floor((F.col("index") - F.col("first")) / rows).cast("int")
    paged = placed.join(F.broadcast(first) if first.limit(20_001).count() <= 20_000 else first, "cluster_name")
    return paged.groupBy("cluster_name", page.alias("page")).agg(F.sort_array(F.collect_list("crop_path")).alias("crop_paths"))


def read_manifest(nested: DataFrame) -> DataFrame:
    """Flat crops of a table of (run_id, json) manifests; clusters without crops keep a row with null crop."""
    entries = nested.select("run_id", F.explode(F.from_json("json", MANIFEST)).alias("cluster_name", "c"))
    return entries.select("run_id", "cluster_name", "c.cluster_id", "c.defect_name", F.explode_outer("c.crops").alias("crop")).select(
        "run_id", "cluster_name", "cluster_id", "defect_name", "crop.*"
    )


def named_clusters(manifest: DataFrame) -> DataFrame:
    return manifest.where("defect_name is not null and defect_name <> ''")


def without_noise(manifest: DataFrame) -> DataFrame:
    return manifest.where("cluster_name <> 'noise'")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_name").agg(F.count("*").alias("n"))


def cluster_summary(assigned: DataFrame) -> DataFrame:
    """Clusters without noise, noise rows, and their share."""
    noise = F.col("cluster_id") == -1
    return assigned.agg(
        F.count_distinct(F.when(~noise, F.col("cluster_id"))).alias("clusters"), F.count_if(noise).alias("noise"), F.count("*").alias("total")
    ).withColumn("noise_ratio", F.when(F.col("total") > 0, F.col("noise") / F.col("total")).otherwise(0.0))


def thumbnails(manifest: DataFrame, n: int = 4) -> DataFrame:
    """The first n crops of each cluster."""
    w = Window.partitionBy("cluster_name").orderBy("crop_path")
    return manifest.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def name_clusters(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """The manifest with defect_name set from names (cluster_name, new_name); names of clusters that aren't there do nothing."""
    new = names.groupBy("cluster_name").agg(F.max("new_name").alias("_new"))
    return manifest.join(new, "cluster_name", "left").withColumn("defect_name", F.coalesce("_new", "defect_name")).drop("_new")


def naming_report(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """How many names found their cluster, and how many crops then have a name."""
    named = name_clusters(manifest, names)
    updated = names.join(manifest.select("cluster_name").distinct(), "cluster_name", "left_semi")
    return updated.agg(F.count_distinct("cluster_name").alias("updated")).join(named_clusters(named).agg(F.count("*").alias("labelled_crops")), F.lit(True))


def move_crops(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """Crops of edits (crop_path, source, target) put into the cluster target, where crop, source and target exist."""
    targets = manifest.groupBy(F.col("cluster_name").alias("target")).agg(F.min("cluster_id").alias("_id"), F.max("defect_name").alias("_defect"))
    good = edits.join(targets, "target").select("crop_path", F.col("source").alias("cluster_name"), "target", "_id", "_defect").dropDuplicates(["crop_path", "cluster_name"])
    both = manifest.join(good, ["crop_path", "cluster_name"], "left")
    moved = F.col("target").isNotNull()
    return both.select(
        *[
            {
                "cluster_name": F.coalesce("target", "cluster_name").alias(c),
                "cluster_id": F.when(moved, F.col("_id")).otherwise(F.col("cluster_id")).alias(c),
                "defect_name": F.when(moved, F.col("_defect")).otherwise(F.col("defect_name")).alias(c),
            }.get(c, F.col(c))
            for c in manifest.columns
        ]
    )


def edit_errors(manifest: DataFrame, edits: DataFrame) -> DataFrame:
    """edits with why each can't be done: unknown source, no match, unknown target; null if it can."""
    clusters = manifest.select("cluster_name").distinct()
    have = manifest.select("crop_path", F.col("cluster_name").alias("source")).distinct().withColumn("_crop", F.lit(1))
    out = edits.join(clusters.select(F.col("cluster_name").alias("source"), F.lit(1).alias("_source")), "source", "left")
    out = out.join(clusters.select(F.col("cluster_name").alias("target"), F.lit(1).alias("_target")), "target", "left").join(have, ["crop_path", "source"], "left")
    why = F.when(F.col("_source").isNull(), "unknown source").when(F.col("_crop").isNull(), "no match").when(F.col("_target").isNull(), "unknown target")
    return out.select("crop_path", "source", "target", why.alias("error"))


def drop_crops(manifest: DataFrame, crops: DataFrame) -> DataFrame:
    return manifest.join(crops.select("crop_path", "cluster_name").distinct(), ["crop_path", "cluster_name"], "left_anti")


def select_crops(manifest: DataFrame, crops: DataFrame, rest: bool = False) -> DataFrame:
    return manifest.join(crops.select("crop_path").distinct(), "crop_path", "left_anti" if rest else "left_semi")


def reconcile_clusters(clusters: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Clusters that have crops in the manifest and files."""
    return clusters.join(manifest.select("cluster_name").distinct(), "cluster_name", "left_semi").join(files.select("cluster_name").distinct(), "cluster_name", "left_semi")


def label_mapping(manifest: DataFrame) -> DataFrame:
    """One row for each crop of a named cluster."""
    return named_clusters(manifest).select("crop_path", "cluster_name", "cluster_id", "source_image", F.col("defect_name").alias("label"))
