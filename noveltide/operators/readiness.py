"""Is there enough to train: class statistics, the readiness rule, the retraining decision, and gates between steps."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: least crops in the smallest class.
MIN_PER_CLASS = 10
#: Fixed values of the tiers: crops below, then batch, freeze, patience, lr0, mosaic, mixup (the last tier is open).
TIERS = [(100, 8, 10, 10, 0.005, 1.0, 0.2), (500, 16, 5, 15, 0.01, 1.0, 0.1), (None, 16, None, 20, 0.01, 1.0, 0.05)]
TIER_NAMES = ["batch", "freeze", "patience", "lr0", "mosaic", "mixup"]
TIER_TYPES = ["int", "int", "int", "double", "double", "double"]


def class_counts(manifest: DataFrame) -> DataFrame:
    """(class_name, crops): clusters of one name add up; with no name at all the clusters themselves, without noise."""
    named = manifest.where("defect_name is not null and defect_name <> ''").groupBy(F.col("defect_name").alias("class_name")).agg(F.count("*").alias("crops"))
    folders = manifest.where("cluster_name <> 'noise'").groupBy(F.col("cluster_name").alias("class_name")).agg(F.count("*").alias("crops"))
    none = named.limit(1).agg(F.count("*").alias("_n")).where("_n = 0").drop("_n").withColumn("_none", F.lit(1))
    return named.union(folders.join(F.broadcast(none), F.lit(True)).drop("_none"))


def class_stats(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count("*").alias("num_classes"),
        F.coalesce(F.sum("crops"), F.lit(0)).alias("total_crops"),
        F.coalesce(F.min("crops"), F.lit(0)).alias("min_crops"),
        F.coalesce(F.max("crops"), F.lit(0)).alias("max_crops"),
        F.coalesce(F.round(F.avg("crops"), 1), F.lit(0.0)).alias("avg_crops"),
    )


def readiness(stats: DataFrame, least: int = MIN_PER_CLASS) -> DataFrame:
    """stats with should_train, reason, and the parameters of the size's tier."""
    ok = (F.col("min_crops") >= least) & (F.col("num_classes") >= 1)
    reason = (
        F.when(F.col("num_classes") == 0, "no cluster has a name yet")
        .when(~ok, F.format_string(f"the smallest class has %d crops of the {least} that it needs", "min_crops"))
        .otherwise(F.format_string("%d crops in %d classes, %d or more in each: enough to train on", "total_crops", "num_classes", "min_crops"))
    )
    out = stats.withColumn("should_train", ok).withColumn("reason", reason)
    for i, (name, kind) in enumerate(zip(TIER_NAMES, TIER_TYPES, strict=True), 1):
        value = F.when(F.col("total_crops") < TIERS[0][0], F.lit(TIERS[0][i])).when(F.col("total_crops") < TIERS[1][0], F.lit(TIERS[1][i])).otherwise(F.lit(TIERS[2][i]))
        out = out.withColumn(name, value.cast(kind))
    return out


def training_preview(manifest: DataFrame) -> DataFrame:
    return readiness(class_stats(class_counts(manifest)))


def retrain_decision(manifest: DataFrame, model_classes: DataFrame, since: Column, least: int = 5) -> DataFrame:
    """(class_name, crops): named classes that the model lacks, with enough crops of which some came after `since`."""
    named = manifest.where("defect_name is not null and defect_name <> ''").withColumn("_new", since)
    counts = named.groupBy(F.col("defect_name").alias("class_name")).agg(F.count("*").alias("crops"), F.bool_or("_new").alias("_any"))
    return counts.join(model_classes.select("class_name"), "class_name", "left_anti").where((F.col("crops") >= least) & F.col("_any")).drop("_any")


def gates(runs: DataFrame) -> DataFrame:
    """runs (valid, trained, deployed_ok, exported) with what may follow: nothing was exported, nothing goes on."""
    go = F.col("exported") > 0
    return runs.withColumn("may_version", go & F.col("valid")).withColumn("may_deploy", go & F.col("valid") & F.col("trained")).withColumn(
        "may_sync", go & (F.col("trained") | F.col("deployed_ok"))
    )


def counts_row(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, t in tables.items():
        n = t.agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, F.lit(True))
    return out
