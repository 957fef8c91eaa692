"""Model versions and their deployments: two append-only tables per line of models; the rest is derived."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import size_mb, version_id
from .classes import sync_classes, with_baseline

#: The version that an empty registry starts with.
BASELINE_ID = "v1_initial"
BASELINE_CLASSES = ["inclusion", "oil_spot", "punching_hole", "silk_spot", "water_spot", "welding_line"]
BASELINE_METRICS = {"map50": 0.95, "precision": 0.92, "recall": 0.94}


def version_numbers(versions: DataFrame) -> DataFrame:
    """versions (line, created_at, model) with version_num by time of registration, and version_id."""
    w = Window.partitionBy("line").orderBy("created_at", "model")
    out = versions.withColumn("version_num", F.row_number().over(w))
    return out.withColumn("version_id", version_id(F.col("version_num"), F.col("created_at")))


def register_version(versions: DataFrame, new: DataFrame, stats: DataFrame | None = None, baseline: list[str] | None = None) -> DataFrame:
    """versions and the new rows (line, model, created_at, classes, bytes) that have a model path, filled in.

    A new row gets the next number of its line (in order of created_at, then model), its id, its size in MB, its classes
    with the baseline's at the end, the statistics of its training set (stats: one row a line) and the status
    `registered`. A model that its line has already is left out.
    """
    have = versions.groupBy("line").agg(F.max("version_num").alias("_last"))
    fresh = new.where("model is not null").join(versions.select("line", "model"), ["line", "model"], "left_anti").join(have, "line", "left")
    w = Window.partitionBy("line").orderBy("created_at", "model")
    fresh = fresh.withColumn("version_num", (F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("_last")
    fresh = fresh.withColumn("version_id", version_id(F.col("version_num"), F.col("created_at"))).withColumn("size_mb", size_mb(F.col("bytes"))).drop("bytes")
    names = F.array(*map(F.lit, BASELINE_CLASSES if baseline is None else baseline))
    fresh = fresh.withColumn("classes", with_baseline(F.col("classes"), names)).withColumn("status", F.lit("registered"))
    if stats is not None:
        fresh = fresh.join(stats, "line", "left")
    return versions.unionByName(fresh, allowMissingColumns=True)


def init_baseline(versions: DataFrame) -> DataFrame:
    """A deployed first version for every empty registry: versions is returned as it is if it has a row."""
    spark = versions.sparkSession
    row = spark.range(1).select(
        F.lit(BASELINE_ID).alias("version_id"),
        F.lit(1).alias("version_num"),
        F.array(*map(F.lit, BASELINE_CLASSES)).alias("classes"),
        F.create_map(*[F.lit(x) for kv in BASELINE_METRICS.items() for x in kv]).alias("metrics"),
        F.lit("deployed").alias("status"),
    )
    empty = versions.limit(1).agg(F.count("*").alias("_n")).where("_n = 0")
    return versions.unionByName(row.join(F.broadcast(empty), F.lit(True)).drop("_n"), allowMissingColumns=True)


def deployment_history(deployments: DataFrame) -> DataFrame:
    """Each deployment with the version that it replaced, newest first."""
    w = Window.partitionBy("line").orderBy("deployed_at", "model")
    return deployments.withColumn("previous", F.lag("model").over(w)).orderBy(F.desc("deployed_at"), F.desc("model"))


def version_status(versions: DataFrame, deployments: DataFrame) -> DataFrame:
    """registered, deployed (the last one of its line) or retired."""
    last = deployments.groupBy("line").agg(F.max_by("model", F.struct("deployed_at", "model")).alias("current"))
    ever = deployments.select("line", "model").distinct().withColumn("_ever", F.lit(1))
    out = versions.join(last, "line", "left").join(ever, ["line", "model"], "left")
    status = F.when(F.col("model") == F.col("current"), "deployed").when(F.col("_ever").isNotNull(), "retired").otherwise("registered")
    return out.withColumn("status", status).drop("current", "_ever")


def current_version(versions: DataFrame, deployments: DataFrame) -> DataFrame:
    return version_status(versions, deployments).where("status = 'deployed'")


def list_versions(versions: DataFrame) -> DataFrame:
    return version_numbers(versions).orderBy(F.desc("created_at"), F.desc("model"))


def deploy_version(versions: DataFrame, deployments: DataFrame, requests: DataFrame, action: str = "deploy") -> tuple[DataFrame, DataFrame]:
    """(deployments with the requests (line, model, deployed_at) that exist, results with ok for every request)."""
    have = versions.select("line", "model").distinct()
    good = requests.join(have, ["line", "model"], "left_semi").withColumn("action", F.lit(action))
    results = requests.join(have.withColumn("_ok", F.lit(True)), ["line", "model"], "left").select("line", "model", F.coalesce("_ok", F.lit(False)).alias("ok"))
    return deployments.unionByName(good, allowMissingColumns=True), results


def set_current(versions: DataFrame, deployments: DataFrame, requests: DataFrame, action: str = "deploy") -> tuple[DataFrame, DataFrame, DataFrame]:
    """deploy_version with what follows from it: (deployments, results, known classes by line).

    requests (line, model, deployed_at); versions have classes. The known classes of a line become those of its deployed
    version and the baseline's, sorted. Rolling back is a deployment of an older version with the action `rollback`.
    """
    after, results = deploy_version(versions, deployments, requests, action)
    current = current_version(versions, after)
    base = F.array(*map(F.lit, BASELINE_CLASSES))
    return after, results, current.select("line", "model", sync_classes(base, F.col("classes")).alias("classes"))


def index_of_version(index: DataFrame, classes: Column | list[str]) -> DataFrame:
    """The known vectors of a version's classes, in any case."""
    names = F.array(*map(F.lit, classes)) if isinstance(classes, list) else classes
    return index.where(F.array_contains(F.transform(names, F.lower), F.lower("label")))
