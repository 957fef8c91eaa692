"""Routing of scored images to known or unknown."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_stem

#: Least confidence of a known detection; the detection added for a name match.
MIN_CONFIDENCE, MATCH_ID, MATCH_CONFIDENCE = 0.30, -99, 1.0


def known_detections(detections: DataFrame, known: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """Detections (class_name, confidence, ...) of a known class, in any case, with enough confidence."""
    names = known.select(F.lower("class_name").alias("_known")).distinct()
    return detections.where(F.col("confidence") >= least).join(names, F.lower("class_name") == F.col("_known"), "left_semi")


def prefix_matches(images: DataFrame, known_crops: DataFrame, exact_stem: bool = False) -> DataFrame:
    """A detection for each image whose stem starts the name of a known crop: smallest class, then file.

    Candidates meet by equality: the prefixes of a crop's name that are as long as some stem are keys, so there is no
    product of the two tables.
    """
    name = F.col("crop_name")
    stems = images.select("image_path", path_stem(F.col("image_path")).alias("_stem"))
    if exact_stem:
        keys = known_crops.select("class_name", "crop_name", path_stem(name).alias("_stem"))
    else:
        sizes = stems.agg(F.collect_set(F.length("_stem")).alias("_sizes"))  # one row: lengths of file names
        cut = F.explode(F.transform(F.filter("_sizes", lambda n: (n > 0) & (n <= F.length("crop_name"))), lambda n: F.substr(name, F.lit(1), n)))
        keys = known_crops.join(F.broadcast(sizes), F.lit(True)).select("class_name", "crop_name", cut.alias("_stem"))
    best = stems.join(keys, "_stem").groupBy("image_path").agg(F.min(F.struct("class_name", "crop_name")).alias("m"))
    return best.select("image_path", F.lit(MATCH_ID).alias("class_id"), "m.class_name", F.lit(MATCH_CONFIDENCE).alias("confidence"), F.col("m.crop_name").alias("note"))


def classify_images(images: DataFrame, detections: DataFrame, known: DataFrame, known_crops: DataFrame | None = None) -> DataFrame:
    """(image_path, n_detections, classified_as): known if a detection is known or a crop name matches, else unknown."""
    names = known.select(F.lower("class_name").alias("_known")).distinct()
    marked = detections.join(names, F.lower("class_name") == F.col("_known"), "left")
    sure = F.col("_known").isNotNull() & (F.col("confidence") >= MIN_CONFIDENCE)
    counts = marked.groupBy("image_path").agg(F.count("*").alias("n"), F.count_if(sure).alias("n_known"))
    out = images.select("image_path").join(counts, "image_path", "left").withColumn("n_known", F.nullif("n_known", F.lit(0)))
    if known_crops is not None:
        missing = out.where("n_known is null").select("image_path")
        added = prefix_matches(missing, known_crops).select("image_path", F.lit(1).alias("added"))
        out = out.join(added, "image_path", "left")
    else:
        out = out.withColumn("added", F.lit(None).cast("int"))
    known_now = F.col("n_known").isNotNull() | F.col("added").isNotNull()
    n = F.coalesce("n", F.lit(0)) + F.coalesce("added", F.lit(0))
    return out.select("image_path", n.cast("long").alias("n_detections"), F.when(known_now, "known").otherwise("unknown").alias("classified_as"))


def routing_counts(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count_if(F.col("classified_as") == "known").alias("known"), F.count_if(F.col("classified_as") == "unknown").alias("unknown"), F.count("*").alias("total")
    )


def all_detections(detections: DataFrame, added: DataFrame) -> DataFrame:
    """Scored rows and rows added by name, whichever columns each has."""
    return detections.unionByName(added, allowMissingColumns=True)


def pending_annotations(images: DataFrame, cached: DataFrame) -> DataFrame:
    return images.join(cached.select("image_path").distinct(), "image_path", "left_anti")
