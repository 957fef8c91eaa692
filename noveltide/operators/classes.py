"""The set of known classes as an append-only table of events (name, source, at)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_classes(known: DataFrame, names: DataFrame) -> DataFrame:
    """The given class_names that are not known, once each."""
    return names.where("class_name is not null").select("class_name").distinct().join(known.select("class_name"), "class_name", "left_anti")


def register_classes(events: DataFrame, names: DataFrame, source: str, at: Column) -> DataFrame:
    """events with one row for each truly new name; the same rows if there are none."""
    fresh = new_classes(events, names)
    return events.unionByName(fresh.select("class_name", F.lit(source).alias("source"), at.alias("at")))


def register_from_model(events: DataFrame, names: DataFrame, at: Column, source: str = "model") -> DataFrame:
    """events with the classes of a deployed model (class_name); a model without names adds nothing."""
    return register_classes(events, names, source, at)


def register_from_class_list(events: DataFrame, descriptors: DataFrame, at: Column, source: str = "dashboard_naming") -> DataFrame:
    """events with the classes of a descriptor, whose names are a list or a map from index to name."""
    return register_classes(events, read_class_list(descriptors).select("class_name"), source, at)


def class_registry(events: DataFrame) -> DataFrame:
    """One row: sorted classes, version (batches that added something), time of the last; empty is version 0."""
    return events.agg(F.sort_array(F.collect_set("class_name")).alias("classes"), F.count_distinct("source", "at").alias("version"), F.max("at").alias("last_updated"))


def class_history(events: DataFrame) -> DataFrame:
    """Batches with the names that each was the first to add."""
    first = events.groupBy("class_name").agg(F.min(F.struct("at", "source")).alias("f"))
    return first.groupBy(F.col("f.at").alias("at"), F.col("f.source").alias("source")).agg(F.sort_array(F.collect_list("class_name")).alias("added"))


def sync_classes(baseline: Column, model_classes: Column) -> Column:
    """The list that replaces the known classes: both, sorted."""
    return F.array_sort(F.array_union(baseline, model_classes))


def with_baseline(classes: Column, baseline: Column) -> Column:
    """Given order kept, missing baseline names at the end."""
    return F.concat(classes, F.array_except(baseline, classes))


def added_classes(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def read_class_list(descriptors: DataFrame) -> DataFrame:
    """(pos, class_name) from a descriptor with names as a list, or as a map from index to name."""
    columns = set(descriptors.columns)
    parts = []
    if "names" in columns:
        parts.append(descriptors.select(F.posexplode("names").alias("pos", "class_name")))
    if "names_map" in columns:
        parts.append(descriptors.select(F.explode("names_map").alias("k", "class_name")).select(F.col("k").cast("int").alias("pos"), "class_name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def read_class_registry(raw: DataFrame) -> DataFrame:
    """Registry JSON (value) with defaults for what is missing; unreadable text is the empty registry."""
    schema = "defect_classes array<string>, version int, last_updated string, history array<struct<added array<string>, source string, timestamp string>>"
    r = F.from_json("value", schema)
    none = F.from_json(F.lit('{"defect_classes": [], "history": []}'), schema)
    return raw.select(
        F.coalesce(r["defect_classes"], none["defect_classes"]).alias("defect_classes"), F.coalesce(r["version"], F.lit(0)).alias("version"), r["last_updated"].alias("last_updated"), F.coalesce(r["history"], none["history"]).alias("history")
    )


def distinct_labels(index: DataFrame) -> DataFrame:
    return index.agg(F.sort_array(F.collect_set("label")).alias("labels"))


def allowed_classes(rows: DataFrame, allowed: list[str] | None) -> DataFrame:
    """Rows of the allowed classes in any case; no list allows all."""
    return rows if allowed is None else rows.where(F.lower("label").isin([x.lower() for x in allowed]))


def class_order(events: DataFrame) -> DataFrame:
    """Classes with the number of their registration (one row a class)."""
    first = events.groupBy("class_name").agg(F.min("at").alias("at"))
    return first.withColumn("nth", F.row_number().over(Window.orderBy("at", "class_name")))
