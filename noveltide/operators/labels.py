"""Label sets: crops mapped back to boxes on their source images, written as lines, and checked."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import format_label_line, parse_label_line


def encode_classes(labels: DataFrame, known: DataFrame) -> DataFrame:
    """(label, class_id): known (label, pos) keep their order, new labels follow in the order first seen (seq)."""
    fresh = labels.join(known.select("label"), "label", "left_anti").groupBy("label").agg(F.min("seq").alias("seq"))
    order = known.select("label", F.lit(0).alias("part"), F.col("pos").cast("long").alias("at")).union(fresh.select("label", F.lit(1), F.col("seq").cast("long")))
    # one row a class: the window sorts class names, not crops
    return order.select("label", (F.row_number().over(Window.orderBy("part", "at", "label")) - 1).alias("class_id"))


def crops_to_sources(labelled: DataFrame, sources: DataFrame) -> DataFrame:
    """labelled crops (stem, label) with their source_image and center box; those without either are left out."""
    return labelled.join(sources, "stem").where("source_image is not null and center is not null")


def split_of(image: Column, val_fraction: float, seed: int = 42) -> Column:
    """train or val by a hash of the image; 0 puts all into train."""
    return F.when(F.pmod(F.xxhash64(image, F.lit(seed)), F.lit(10_000)) < int(val_fraction * 10_000), "val").otherwise("train")


def label_lines(mapped: DataFrame, classes: DataFrame) -> DataFrame:
    """(source_image, n_boxes, lines): for each image its label lines in order, one a crop: crops with one box give equal lines."""
    rows = mapped.join(classes, "label").withColumn("line", format_label_line(F.col("class_id"), F.col("center")))
    return rows.groupBy("source_image").agg(F.count("*").alias("n_boxes"), F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("lines"))


def map_summary(mapped: DataFrame) -> DataFrame:
    return mapped.agg(F.count("*").alias("boxes"), F.count_distinct("source_image").alias("images"), F.count_distinct("label").alias("classes"))


def line_errors(lines: DataFrame, n_classes: int) -> DataFrame:
    """One row for each fault of label lines (split, stem, line_no, line): count, number, class, or the coordinate's name.

    Empty lines are no fault; coordinates that are not a number are out of range.
    """
    p = lines.where("trim(line) <> ''").withColumn("p", parse_label_line(F.col("line")))
    bad_count = F.col("p.n") != 5
    bad_number = F.col("p.class_id").isNull() | F.col("p.cx").isNull() | F.col("p.cy").isNull() | F.col("p.w").isNull() | F.col("p.h").isNull()
    bad_class = (F.col("p.class_id") < 0) | (F.col("p.class_id") >= max(n_classes, 1))
    outside = [F.when((F.col(f"p.{c}") < 0) | (F.col(f"p.{c}") > 1) | F.isnan(f"p.{c}"), c) for c in ("cx", "cy", "w", "h")]
    faults = F.when(bad_count, F.array(F.lit("count"))).when(bad_number, F.array(F.lit("number"))).otherwise(F.array_compact(F.array(F.when(bad_class, "class"), *outside)))
    return p.select("split", "stem", "line_no", F.explode(faults).alias("fault"))


def descriptor_errors(descriptor: DataFrame) -> DataFrame:
    """Faults of a descriptor (train, val, nc, names): missing keys, nc that is not the number of names."""
    faults = F.array_compact(
        F.array(*[F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in ("train", "val", "nc", "names")], F.when(F.col("nc") != F.size("names"), "nc is not the number of names"))
    )
    return descriptor.select(F.explode(faults).alias("fault"))


def orphans(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(split, stem, kind): images without labels and labels without images."""
    a = images.select("split", "stem").distinct()
    b = labels.select("split", "stem").distinct()
    return a.join(b, ["split", "stem"], "left_anti").withColumn("kind", F.lit("image")).union(b.join(a, ["split", "stem"], "left_anti").withColumn("kind", F.lit("label")))


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def validation_summary(lines: DataFrame, errors: DataFrame) -> DataFrame:
    """Per split: lines, faults, and whether it is valid."""
    counts = lines.groupBy("split").agg(F.count("*").alias("n_lines"))
    faults = errors.groupBy("split").agg(F.count("*").alias("n_errors"))
    return counts.join(faults, "split", "left").select("split", "n_lines", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.col("n_errors").isNull().alias("valid"))
