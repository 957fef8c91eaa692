"""Step metrics of runs and the event log."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import node_state, run_state, source_to_node


def step_metrics(events: DataFrame) -> DataFrame:
    """Per run and step: last status, seconds from first to last event, items and failures of the last."""
    order = F.struct("ts", "seq")
    return events.groupBy("run", "step").agg(
        F.max_by("status", order).alias("status"),
        F.round((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6, 3).alias("latency"),
        F.max_by("items", order).alias("items"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.max_by("error", order).alias("error"),
    )


def run_summary(metrics: DataFrame) -> DataFrame:
    """Per run its steps in order and their states."""
    pairs = F.sort_array(F.collect_list(F.struct("step", "status")))
    return metrics.groupBy("run").agg(pairs.alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"))


def run_states(metrics: DataFrame) -> DataFrame:
    """Per run a map from step to state."""
    return metrics.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("step", "status"))).alias("states"))


def recent_runs(metrics: DataFrame, n: int = 50) -> DataFrame:
    return metrics.select("run").distinct().orderBy(F.desc("run")).limit(n)


def load_run(metrics: DataFrame, run) -> DataFrame:
    return metrics.where(F.col("run") == run)


def events_since(log: DataFrame, ts, seq: int, limit: int = 200) -> DataFrame:
    """The newest `limit` events after the cursor (ts, seq), oldest first."""
    after = log.where(F.struct("ts", "seq") > F.struct(F.lit(ts).cast("timestamp").alias("ts"), F.lit(seq).cast("long").alias("seq")))
    return after.orderBy(F.desc("ts"), F.desc("seq")).limit(limit).orderBy("ts", "seq")


def tail_events(log: DataFrame, n: int = 100) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq")


def retained(log: DataFrame, n: int = 2000) -> DataFrame:
    """The newest n events."""
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def latest_node_state(log: DataFrame) -> DataFrame:
    """(node, state): the last state of each node since the last start of a run; none before its first event."""
    order = F.struct("ts", "seq")
    start = log.where(run_state(F.col("message")) == "running").agg(F.max(order).alias("_start"))
    events = log.select("ts", "seq", source_to_node(F.col("source")).alias("node"), node_state(F.col("level"), F.col("source"), F.col("message")).alias("state"))
    events = events.where("state is not null").join(F.broadcast(start), F.lit(True)).where(F.col("_start").isNull() | (order > F.col("_start")))
    return events.groupBy("node").agg(F.max_by("state", order).alias("state"))


def quota_sample(images: DataFrame, first: int = 16, total: int = 20, seed: int = 0, key: str | None = None) -> DataFrame:
    """images (image_path, kind): up to `first` unknown ones in hashed order, filled with known ones up to `total`."""
    order = F.col(key) if key else F.xxhash64("image_path", F.lit(seed))
    ranked = images.withColumn("_k", order)
    unknown = ranked.where("kind = 'unknown'").orderBy("_k", "image_path").limit(first)
    fill = ranked.where("kind = 'known'").orderBy("_k", "image_path").limit(total)
    w = Window.orderBy("part", "_k", "image_path")  # at most first + total rows
    both = unknown.withColumn("part", F.lit(0)).union(fill.withColumn("part", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= total).drop("_n", "_k", "part")
