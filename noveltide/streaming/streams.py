"""Streams of new images, log events and step states, and the orchestrating tick."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.events import node_state, source_to_node
from ..functions.paths import parent_name, path_stem
from ..operators import labels, manifest, readiness
from ..plans.storage import scratch, stored
from ..sources.tables import Tables, upsert

LOG = "ts timestamp, seq long, level string, source string, message string, data string"


def stream_new_images(spark: SparkSession, directory: str) -> DataFrame:
    """Each file once, with the name of its directory as cluster; the query's checkpoint is the set of files seen."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(directory)
    return files.select(F.col("path").alias("image_path"), parent_name(F.col("path")).alias("cluster_name"), "length", F.col("modificationTime").alias("modified"))


def first_seen(images: DataFrame, delay: str = "1 day", time: str = "modified") -> DataFrame:
    """Each image_path of a stream once. The set of paths seen is kept for `delay` of event time, so that it has a bound.

    A path that comes again within `delay` is left out; one that comes more than `delay` late counts as new. A null path is a path.
    """
    return images.withWatermark(time, delay).dropDuplicatesWithinWatermark(["image_path"])


def new_images(images: DataFrame, seen: DataFrame) -> DataFrame:
    """The batch form: rows of images whose image_path is not in seen, one a path (the smallest by its columns)."""
    rest = [c for c in images.columns if c != "image_path"]
    one = images.groupBy("image_path").agg(F.min(F.struct(*rest)).alias("r")).select(*[F.col(c) if c == "image_path" else F.col(f"r.{c}").alias(c) for c in images.columns])
    known = seen.select(F.col("image_path").alias("_seen")).distinct()
    return one.join(known, F.col("image_path").eqNullSafe(F.col("_seen")), "left_anti")


def stream_log(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(LOG).json(directory)


def append_log(log: DataFrame, path: str, checkpoint: str):
    """Appends events by date; batches are written exactly once."""
    return log.withColumn("date", F.to_date("ts")).writeStream.format("parquet").partitionBy("date").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def retain_newest(log: DataFrame, root: str, checkpoint: str, n: int = 2000, name: str = "log", order: tuple = ("ts", "seq")):
    """Keeps the newest n events in a versioned table; runs over what is there and ends.

    A batch's result and its number are committed together, so that a batch that comes again after a failure changes nothing.
    """

    def keep(batch: DataFrame, number: int) -> None:
        tables = Tables(batch.sparkSession, root)
        version, entry = tables.current()
        if entry.get("batch", -1) >= number:
            return
        held = tables.read(name, schema=batch.schema).select(batch.columns)
        tables.commit({name: held.unionByName(batch).orderBy(*[F.desc(c) for c in order]).limit(n)}, base=version, batch=number)
        tables.vacuum()

    return log.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(rows: DataFrame, path: str, key: list[str], newest: list[str], checkpoint: str):
    """Rows of an update-mode stream into a table with one row a key, the last by `newest`; a batch that comes again changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):  # read twice, and a plan of its own beside the stream's
            upsert(stored(batch), path, key, newest)

    return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STEP_ROW = "run string, step string, status string, started timestamp, last timestamp, failures long"


def stream_steps_with_limit(events: DataFrame, seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Last status of each run and step (update mode), where steps that do not end fail by a timer.

    events: (run, step, status, ts, seq). A step that has not ended (success or failed) `seconds` after its last event, in event
    time as far as the watermark has come, is failed. The state of a step that has ended stays until the watermark has passed its
    last event, for events that come late, and then goes.
    """
    marked = events.select(F.col("run").cast("string").alias("run"), "step", "status", F.col("ts").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq")).withWatermark("at", delay)

    def fold(key, parts, state):
        held = state.getOption
        status, first, last, seq, failures = held if held is not None else (None, 2**62, -1, -1, 0)
        if state.hasTimedOut:
            state.remove()
            if status in ("success", "failed"):
                return
            status, failures = "failed", failures + 1
        else:
            for pdf in parts:
                micros = pdf["at"].to_numpy().astype("datetime64[us]").astype("int64")
                for s, t, n in zip(pdf["status"], micros, pdf["seq"], strict=True):
                    first, failures = min(first, int(t)), failures + (s == "failed")
                    if (int(t), int(n)) >= (last, seq):
                        status, last, seq = s, int(t), int(n)
            state.update((status, first, last, seq, failures))
            ended = status in ("success", "failed")
            state.setTimeoutTimestamp(max(last // 1000 + (1 if ended else seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run": [key[0]], "step": [key[1]], "status": [status], "started": [pd.Timestamp(first, unit="us")], "last": [pd.Timestamp(last, unit="us")], "failures": [failures]})

    return marked.groupBy("run", "step").applyInPandasWithState(fold, STEP_ROW, "status string, first long, last long, seq long, failures long", "update", "EventTimeTimeout")


def stream_step_state(events: DataFrame) -> DataFrame:
    """Last status of each run and step, seconds from first to last event, and failures (update mode); state is one row for each."""
    order = F.struct("ts", "seq")
    first, last = F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))
    found = events.groupBy("run", "step").agg(F.max_by("status", order).alias("status"), first.alias("started"), last.alias("last"), F.count_if(F.col("status") == "failed").alias("failures"))
    return found.withColumn("latency", F.round((F.unix_micros("last") - F.unix_micros("started")) / 1e6, 3))


def stream_node_state(log: DataFrame) -> DataFrame:
    """Last state of each node (update mode)."""
    rows = log.select("ts", "seq", source_to_node(F.col("source")).alias("node"), node_state(F.col("level"), F.col("source"), F.col("message")).alias("state")).where("state is not null")
    return rows.groupBy("node").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"))


def orchestrate(images: DataFrame, tick: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, seconds: int = 30):
    """tick(new images, number) for each batch: every 30 seconds, or for what is there now."""
    trigger = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return images.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def decision_chain(root: str, clusters: Callable[[], DataFrame], sources: Callable[[], DataFrame], known: Callable[[], DataFrame], act: Callable[[DataFrame, int], None], since: Column | None = None, least: int = 5) -> Callable[[DataFrame, int], None]:
    """A tick for orchestrate: named clusters, labels on their source images, the decision to retrain, and what follows from it.

    clusters: the flat manifest; sources: (stem, source_image, center); known: (label, pos), the model's classes. Each step of
    a batch ends in one commit of its tables (new_images; label_lines and classes; decided; last the action), with the batch's and
    the step's number. A batch that is run again after a failure goes on behind its last commit: nothing is done twice, but an
    action that had no commit yet, and gets the batch's number to tell. act(decided, number) is called only if some class is to
    be trained, and something was mapped.
    """

    def tick(images: DataFrame, number: int) -> None:
        spark = images.sparkSession
        tables = Tables(spark, root)

        def step(k: int, make: Callable[[], dict]) -> None:
            version, entry = tables.current()
            if (entry.get("batch", -1), entry.get("step", -1)) < (number, k):
                tables.commit(make(), base=version, batch=number, step=k)

        named = manifest.named_clusters(clusters())

        def mapped() -> dict:
            rows = named.select(path_stem(F.col("crop_path")).alias("stem"), F.col("defect_name").alias("label"), F.col("cluster_name").alias("seq"))
            first = rows.groupBy("label").agg(F.min("seq").alias("cluster"))
            place = first.select("label", F.row_number().over(Window.orderBy("cluster", "label")).alias("seq"))  # one row a class
            ids = labels.encode_classes(place, known())
            return {"classes": ids, "label_lines": labels.label_lines(labels.crops_to_sources(rows.select("stem", "label"), sources()), ids)}

        def decided() -> dict:
            classes = known().select(F.col("label").alias("class_name"))
            chosen = readiness.retrain_decision(named, classes, F.lit(True) if since is None else since, least)
            any_line = tables.read("label_lines").limit(1).select(F.lit(1).alias("_any"))
            return {"decided": chosen.join(any_line, F.lit(True)).drop("_any")}

        def acted() -> dict:
            rows = tables.read("decided")
            if not rows.isEmpty():
                act(rows, number)
            return {}

        step(0, lambda: {"new_images": images})
        step(1, mapped)
        step(2, decided)
        step(3, acted)

    return tick
