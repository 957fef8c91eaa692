"""Registered queries that write a table with a sink, mostly twice, and read it back: what comes back is held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import flows
from ..functions import boxes as bx
from ..functions import events as ev
from ..operators import classes, labels, manifest, models, registry, routing, runs
from ..sources import files, sinks
from ..sources.tables import Tables
from ..streaming import streams
from .queries import _CLASSIFIED, _COUNTS, _STATUS, _mapped, _with_metadata, query
from .storage import new_folder, stored
from .views import table, views


@query("SELECT printf('img_%06d.jpg', l_orderkey) AS image_path, count(*)::INT AS findings, max(l_partkey)::INT AS prompt_tokens FROM lineitem GROUP BY l_orderkey")
def sr4_sk7_annotations(spark, d):
    (b,) = views(spark, d, "boxes")
    finding = F.struct(F.col("box").alias("box_2d"), F.lit("t").alias("physical_traits"))
    rows = b.groupBy("image_path").agg(F.collect_list(finding).alias("findings"), F.max("l_partkey").cast("int").alias("prompt_tokens"))
    rows = rows.withColumn("anomalies_found", F.lit(True)).withColumn("image_name", F.col("image_path"))
    path = new_folder(spark)
    sinks.write_annotations(rows, path)
    sinks.write_annotations(rows.withColumn("prompt_tokens", F.lit(-1)), path)  # images that are there keep what they have
    found, counts = files.read_annotations(spark, path, multi_line=False)
    return found.where(F.lit(counts)).select("image_path", F.size("findings").alias("findings"), "prompt_tokens")


@query(
    """SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || CAST(l_quantity AS INT) AS stem, image_path AS source_image, count(*) AS n, round(min((box[2] + box[4]) / 2000), 6) AS cx
    FROM boxes WHERE len(box) = 4 GROUP BY ALL""",
    "boxes",
)
def sr6_sk4_crop_sources(spark, d):
    (b,) = views(spark, d, "boxes")
    stem = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    rows = b.where("size(box) = 4").select(stem.alias("stem"), F.col("image_path").alias("source_image"), bx.box_to_center(F.col("box")).alias("center"))
    path = new_folder(spark)
    for _ in range(2):
        sinks.write_crop_sources(rows, path)
    found = files.read_crop_sources(spark.read.text(path))
    return found.groupBy("stem", "source_image").agg(F.count("*").alias("n"), F.round(F.min(F.col("center")[0]), 6).alias("cx"))


@query("SELECT (row_number() OVER (ORDER BY p_type) - 1)::INT AS pos, p_type AS class_name FROM (SELECT DISTINCT p_type FROM part)")
def sr7_sk5_class_descriptor(spark, d):
    types = table(spark, d, "part").select(F.col("p_type").alias("label")).distinct()
    ids = labels.encode_classes(types.select("label", F.lit(0).alias("seq")), spark.createDataFrame([], "label string, pos int"))
    path = new_folder(spark)
    for _ in range(2):
        sinks.write_class_descriptor(ids, path)
    return classes.read_class_list(spark.read.json(path)).select("pos", "class_name")


@query('SELECT list_sort(list(DISTINCT class_name)) AS defect_classes, count(DISTINCT (source, "at"))::INT AS version, count(DISTINCT (source, "at"))::INT AS batches FROM class_events', "class_events")
def sr9_read_class_registry(spark, d):
    (e,) = views(spark, d, "class_events")
    batch = F.struct("added", "source", F.col("at").cast("string").alias("timestamp"))
    past = classes.class_history(e).agg(F.collect_list(batch).alias("history"))
    one = classes.class_registry(e).select(F.col("classes").alias("defect_classes"), F.col("version").cast("int").alias("version")).join(past, F.lit(True))
    path = new_folder(spark)
    one.select(F.to_json(F.struct("defect_classes", "version", "history")).alias("value")).write.text(path)
    return classes.read_class_registry(spark.read.text(path)).select("defect_classes", "version", F.size("history").alias("batches"))


@query("SELECT '20240101_' || printf('%06d', run) AS run, step, status, latency, items, failures FROM metrics", "metrics")
def sr10_sk8_step_metrics(spark, d):
    rows = runs.step_metrics(views(spark, d, "steps")[0]).drop("error").withColumn("run", F.format_string("20240101_%06d", "run"))
    path = new_folder(spark)
    sinks.write_step_metrics(rows.union(rows), path)  # every key twice in one batch
    sinks.write_step_metrics(rows.withColumn("status", F.lit("later")), path)  # what is there stays
    return files.read_run_metrics(spark, path).select("run", "step", "status", "latency", "items", "failures")


@query("SELECT id AS ref_id, CAST(label AS VARCHAR) AS label, round(vector[1], 4) AS first FROM vectors WHERE label <= 2", "vectors")
def sr11_sk9_index(spark, d):
    (known,) = views(spark, d, "known")
    path = new_folder(spark)
    sinks.reset_index(spark, path)
    sinks.save_index(known.withColumn("vector", F.col("vector").cast("array<float>")), path)
    return files.load_index(spark, path).select("ref_id", "label", F.round(F.col("vector")[0].cast("double"), 4).alias("first"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n FROM rejected WHERE reason IS NULL GROUP BY ALL""",
    "rejected",
)
def sk1_write_crops(spark, d):
    """The pixels here are the box's numbers: the test tables hold no images."""
    (b,) = views(spark, d, "boxes")
    kept = b.where(bx.reject_reason(F.col("box"), F.col("h"), F.col("w")).isNull())
    path = new_folder(spark)
    for _ in range(2):
        sinks.write_crops(kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "image_path", F.to_json("box").cast("binary").alias("data")), path)
    return spark.read.parquet(path).where("data is not null").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT cluster_name, count(*) AS n, min(crop_path) AS first, max(defect_name) AS defect_name FROM clusters GROUP BY 1", "clusters")
def sk2_write_clusters(spark, d):
    (c,) = views(spark, d, "clusters")
    path = new_folder(spark)
    sinks.write_clusters(c.where("cluster_id > 2"), path)
    sinks.write_clusters(c, path)
    return spark.read.parquet(path).groupBy("cluster_name").agg(F.count("*").alias("n"), F.min("crop_path").alias("first"), F.max("defect_name").alias("defect_name"))


@query("SELECT run, cluster_name, cluster_id, defect_name, crop_path FROM clusters, (SELECT unnest(['r1', 'r2']) AS run)", "clusters")
def sk3_write_manifest(spark, d):
    nested = manifest.build_manifest(_with_metadata(spark, d))
    path = new_folder(spark)
    for run in ("r1", "r2", "r1"):
        sinks.write_manifest(nested, path, run)
    found = spark.read.json(path)
    return found.select("run", "cluster_name", F.col("cluster_id").cast("int").alias("cluster_id"), "defect_name", F.explode("crops").alias("c")).select("run", "cluster_name", "cluster_id", "defect_name", "c.crop_path")


@query(
    """SELECT CASE WHEN CAST(image_path[5:10] AS INT) % 9 = 0 THEN 'val' ELSE 'train' END AS split, image_path AS source_image, count(*) AS n_boxes FROM boxes JOIN part ON l_partkey = p_partkey
    WHERE len(box) = 4 GROUP BY image_path""",
    "boxes",
)
def sk5_write_label_set(spark, d):
    lines = labels.label_lines(*_mapped(spark, d))
    split = F.when(F.substring("source_image", 5, 6).cast("int") % 9 == 0, "val").otherwise("train")
    lines = lines.withColumn("split", split)
    path = new_folder(spark)
    sinks.write_label_set(lines, path)
    sinks.write_label_set(lines.where("split = 'val'"), path)  # the other split stays
    return spark.read.parquet(path).select("split", "source_image", "n_boxes")


@query(f"SELECT image_path FROM ({_CLASSIFIED}) WHERE classified_as = 'unknown'", "images", "known_crops", "detections")
def sk6_write_unknowns(spark, d):
    path = new_folder(spark)
    sinks.write_unknowns(routing.classify_images(*views(spark, d, "images", "detections", "known_names", "known_crops")), path)
    return spark.read.json(path)


@query("SELECT 'v1' AS version, defect_name, count(*) AS n FROM clusters WHERE defect_name IS NOT NULL GROUP BY ALL UNION ALL SELECT 'v2', cluster_name, count(*) FROM clusters GROUP BY ALL", "clusters")
def sk10_write_dataset_version(spark, d):
    (c,) = views(spark, d, "clusters")
    path = new_folder(spark)
    named = c.where("defect_name is not null").select("crop_path", "defect_name")
    for rows, tag in ((named, "v1"), (c.select("crop_path", F.col("cluster_name").alias("defect_name")), "v2"), (named.limit(1), "v1")):
        sinks.write_dataset_version(rows, path, tag)  # the last one changes nothing
    tags = spark.read.parquet(f"{path}/tags").select(F.col("tag").alias("version"))
    return spark.read.parquet(f"{path}/data").join(tags, "version").groupBy("version", "defect_name").agg(F.count("*").alias("n"))


@query("SELECT line, model, action FROM deployments", "deployments")
def sk11_write_deployment(spark, d):
    (x,) = views(spark, d, "deployments")
    path = new_folder(spark)
    for part in ("action = 'deploy'", "true", "true"):
        sinks.write_deployment(x.where(part), path)
    return spark.read.parquet(path).select("line", "model", "action")


@query("SELECT 'clusters' AS name, count(*) AS n FROM clusters UNION ALL SELECT 'crops', 0", "clusters")
def sk12_clean_run(spark, d):
    (c,) = views(spark, d, "clusters")
    path = new_folder(spark)
    for name in ("crops", "clusters"):
        c.write.parquet(f"{path}/{name}")
    sinks.clean_run(spark, path, ["crops", "unknown"])
    left = spark.read.schema(c.schema).option("recursiveFileLookup", "true").parquet(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    counts = left.select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([("crops",), ("clusters",)], "name string")
    return every.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'clusters' AS name, count(*) AS n FROM clusters WHERE cluster_id > 2 UNION ALL SELECT 'index', count(*) FROM embeddings WHERE label <= 2", "clusters")
def dm8_reset_tables(spark, d):
    c, known = views(spark, d, "clusters", "known")
    path, backup = new_folder(spark), new_folder(spark)
    c.where("cluster_id > 2").write.parquet(f"{backup}/clusters")
    for name in ("clusters", "index", "unknown"):
        c.write.parquet(f"{path}/{name}")
    sinks.reset_tables(spark, path, ["clusters", "index", "unknown"], backup, known.withColumn("vector", F.col("vector").cast("array<float>")))
    n = spark.read.parquet(f"{path}/clusters").agg(F.lit("clusters").alias("name"), F.count("*").alias("n"))
    return n.union(files.load_index(spark, f"{path}/index").agg(F.lit("index"), F.count("*")))


@query(
    """SELECT o_custkey AS line, o_orderkey AS model, num::INT AS version_num, 'v' || num || '_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS version_id, round(o_totalprice * 1000 / 1048576, 2) AS size_mb,
    status, n_classes::INT AS n_classes, crops FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderdate, o_orderkey) AS num,
        CASE WHEN o_orderstatus = 'F' THEN 'old' ELSE 'registered' END AS status, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 7 END AS n_classes, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS crops FROM orders)"""
)
def dm5_register_version(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(
        F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("model"), F.col("o_orderdate").alias("created_at"), F.array(F.lit("crack")).alias("classes"), (F.col("o_totalprice") * 1000).alias("bytes"), "o_orderstatus"
    )
    old = registry.version_numbers(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"))
    old = old.withColumn("size_mb", F.round(F.col("bytes") / 1048576, 2)).drop("bytes").withColumn("status", F.lit("old"))
    stats = o.select(F.col("o_custkey").alias("line")).distinct().withColumn("crops", F.col("line"))
    out = registry.register_version(old, rows.drop("o_orderstatus"), stats)  # the old ones are there already
    return out.select("line", "model", "version_num", "version_id", "size_mb", "status", F.size("classes").alias("n_classes"), "crops")


@query(
    f"SELECT line, model, list_sort(list_distinct(['crack_' || model % 3] || {registry.BASELINE_CLASSES})) AS classes FROM ({_STATUS}) WHERE status = 'deployed'",
    "versions",
    "deployments",
)
def dm6_set_current(spark, d):
    v, dep = views(spark, d, "versions", "deployments")
    v = v.withColumn("classes", F.array(F.concat(F.lit("crack_"), (F.col("model") % 3).cast("string"))))
    first, last = dep.where("action = 'deploy'"), dep.where("action = 'rollback'")
    return registry.set_current(v, first, last.drop("action"), "rollback")[2]


@query("SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM vectors GROUP BY 1", "vectors")
def dm10_rebuild_index(spark, d):
    (v,) = views(spark, d, "vectors")
    rows = v.select(F.format_string("crop_%06d.jpg", "id").alias("crop_path"), F.col("label").cast("string").alias("label"), "vector")
    events = spark.createDataFrame([("0", "before", 0)], "class_name string, source string, at long")
    index, after = models.rebuild_index(rows, events, "index", F.lit(1).cast("long"))
    return index.join(after.select(F.col("class_name").alias("label")), "label").groupBy("label").agg(F.count_distinct("ref_id").alias("n"))


@query("SELECT crop_path FROM clusters ORDER BY cluster_name, crop_path LIMIT 30", "clusters")
def wn5_first_n(spark, d):
    return labels.first_n(views(spark, d, "clusters")[0], 30, "cluster_name", "crop_path").select("crop_path")


@query("SELECT n_regionkey, array_to_string(['NATION_1', 'scratch'] || list_filter(list(n_name ORDER BY n_name), lambda x: x <> 'NATION_1'), ',') AS added FROM nation GROUP BY 1")
def st4_added_classes(spark, d):
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("c"))
    first = F.array(F.lit("NATION_1"), F.lit("scratch"))
    return g.select("n_regionkey", F.concat_ws(",", classes.added_classes(first, F.col("c"))).alias("added"))


@query(f"SELECT class_name AS label, crops FROM ({_COUNTS}) WHERE lower(class_name) IN ('nation_1', 'nation_3')", "clusters")
def fl10_allowed_classes(spark, d):
    named = views(spark, d, "clusters")[0].where("defect_name is not null")
    return classes.allowed_classes(named.groupBy(F.col("defect_name").alias("label")).agg(F.count("*").alias("crops")), ["Nation_1", "NATION_3"])


# Streams over files that hold the tables; each takes what is there and ends


def _settled(spark, stream):
    """What a stream of aggregates has when all its input is taken."""
    path = new_folder(spark)
    last = stream.writeStream.outputMode("complete").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(path))
    last.option("checkpointLocation", new_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("SELECT seq, level, source, message FROM log", "log")
def sm2_stream_log(spark, d):
    (log,) = views(spark, d, "log")
    source, path = new_folder(spark), new_folder(spark)
    log.select(F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "level", "source", "message", F.lit(None).cast("string").alias("data")).write.json(source)
    checkpoint = new_folder(spark)
    for _ in range(2):  # the second finds nothing new
        streams.append_log(streams.stream_log(spark, source), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("seq", "level", "source", "message")


@query("SELECT run, step, status, latency, failures FROM metrics", "metrics")
def sm3_stream_step_state(spark, d):
    (steps,) = views(spark, d, "steps")
    source = new_folder(spark)
    steps.write.parquet(source)
    found = _settled(spark, streams.stream_step_state(spark.readStream.schema(steps.schema).parquet(source)))
    return found.select("run", "step", "status", "latency", "failures")


@query("SELECT node, max_by(state, row(ts, seq)) AS state FROM states WHERE state IS NOT NULL GROUP BY node", "states")
def sm5_stream_node_state(spark, d):
    (log,) = views(spark, d, "log")
    source = new_folder(spark)
    log.write.parquet(source)
    return _settled(spark, streams.stream_node_state(spark.readStream.schema(log.schema).parquet(source))).select("node", "state")


@query("SELECT seq, level, source, message FROM log ORDER BY ts DESC, seq DESC LIMIT 2000", "log")
def sm2_retained_stream(spark, d):
    """The newest events, kept by the stream itself over two arrivals, the second of older events."""
    (log,) = views(spark, d, "log")
    source, root, checkpoint = (new_folder(spark) for _ in range(3))
    rows = log.select(F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"), "level", "source", "message", F.lit(None).cast("string").alias("data"))
    for part in (F.col("seq") % 3 > 0, F.col("seq") % 3 == 0):
        rows.where(part).write.mode("append").json(source)
        streams.retain_newest(streams.stream_log(spark, source), root, checkpoint).awaitTermination()
    return Tables(spark, root).read("log").select("seq", "level", "source", "message")


@query("SELECT run, step, status, latency, failures FROM metrics", "metrics")
def sm3_step_state_upserts(spark, d):
    """Step states by an update-mode stream into a table with one row a step, taken twice."""
    (steps,) = views(spark, d, "steps")
    source, path = new_folder(spark), new_folder(spark)
    steps.write.parquet(source)
    for _ in range(2):  # another checkpoint: all batches come again and change nothing
        found = streams.stream_step_state(spark.readStream.schema(steps.schema).parquet(source))
        streams.upsert_stream(found, path, ["run", "step"], ["last", "failures"], new_folder(spark)).awaitTermination()
    return spark.read.parquet(path).select("run", "step", "status", "latency", "failures")


@query("SELECT printf('img_%06d.jpg', o_orderkey) AS image_path, o_custkey AS cluster FROM orders WHERE o_orderkey % 3 <> 0")
def st1_new_images(spark, d):
    o = table(spark, d, "orders").select(F.format_string("img_%06d.jpg", "o_orderkey").alias("image_path"), F.col("o_custkey").alias("cluster"), "o_orderkey")
    seen = o.where("o_orderkey % 3 = 0").select("image_path")
    rows = o.select("image_path", "cluster")
    return streams.new_images(rows.union(rows), seen)


@query("SELECT 'clusters' AS name, count(*) AS n, count(defect_name) AS named FROM clusters UNION ALL SELECT 'index', count(*), 0 FROM embeddings WHERE label <= 2", "clusters")
def dm8_versions(spark, d):
    """Tables changed together, then put back together."""
    c, known = views(spark, d, "clusters", "known")
    tables = Tables(spark, new_folder(spark))
    first = tables.commit({"clusters": c, "index": known.select("ref_id", "label")})
    tables.commit({"clusters": manifest.without_noise(c).withColumn("defect_name", F.lit("other")), "index": None})
    tables.restore(first)
    one = tables.read("clusters").agg(F.lit("clusters").alias("name"), F.count("*").alias("n"), F.count("defect_name").alias("named"))
    return one.union(tables.read("index").agg(F.lit("index"), F.count("*"), F.lit(0).cast("long")))


@query(
    """SELECT cluster_name, page::INT AS page, count(*) AS crops, min(crop_path) AS first, max(crop_path) AS last FROM (
    SELECT *, (row_number() OVER (PARTITION BY cluster_name ORDER BY crop_path) - 1) // 20 AS page FROM clusters) GROUP BY ALL""",
    "clusters",
)
def ag5_cluster_pages(spark, d):
    (c,) = views(spark, d, "clusters")
    pages = manifest.cluster_pages(c, stored, 20)
    return pages.select("cluster_name", "page", F.size("crop_paths").cast("long").alias("crops"), F.array_min("crop_paths").alias("first"), F.array_max("crop_paths").alias("last"))


@query(
    """SELECT o_orderkey, o_orderkey % 2 = 0 AS should_train, CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_orderkey ELSE 'No recommendation available' END AS reason,
    CASE WHEN o_orderkey % 5 = 0 THEN o_custkey::VARCHAR ELSE '0.01' END AS lr0, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 7)::VARCHAR ELSE '1' END AS epochs, '8' AS batch, 23 AS parameters FROM orders"""
)
def sc15_sc16_advice(spark, d):
    k = F.col("o_orderkey")
    config = F.when(k % 5 == 0, F.struct(F.col("o_custkey").alias("lr0")))
    reply = F.to_json(F.struct(F.when(k % 2 == 0, True).alias("should_train"), F.when(k % 3 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("reason"), config.alias("config")))
    rows = table(spark, d, "orders").select("o_orderkey", ev.merge_advice(reply).alias("a"), F.create_map(F.lit("epochs"), (k % 7).cast("string")).alias("user"))
    rows = rows.select("o_orderkey", "a.should_train", "a.reason", ev.training_params(F.col("user"), F.col("a.config")).alias("p"))
    return rows.select("o_orderkey", "should_train", "reason", F.col("p")["lr0"].alias("lr0"), F.col("p")["epochs"].alias("epochs"), F.col("p")["batch"].alias("batch"), F.size("p").alias("parameters"))


@query(
    """SELECT 'train' AS split, image_path AS source_image, count(*) AS n_boxes, true AS valid FROM boxes
    JOIN clusters ON CAST(image_path[5:10] AS BIGINT) = vec_id WHERE len(box) = 4 AND defect_name IS NOT NULL GROUP BY image_path""",
    "boxes",
    "clusters",
)
def e2_prepare_training_set(spark, d):
    """Named crops, one a box of the image with the crop's number, to a checked label set."""
    b, c = views(spark, d, "boxes", "clusters")
    good = b.where("size(box) = 4").withColumn("crop_path", F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.monotonically_increasing_id()))
    good = stored(good.select("crop_path", "image_path", "box"))
    flat = good.join(c.drop("crop_path"), F.substring("image_path", 5, 6).cast("long") == F.col("vec_id")).select("crop_path", "cluster_id", "cluster_name", "defect_name")
    sources = good.select(F.col("crop_path").alias("stem"), F.col("image_path").alias("source_image"), bx.box_to_center(F.col("box")).alias("center"))
    known = spark.createDataFrame([("NATION_1", 0)], "label string, pos int")
    out = flows.prepare_training_set(flat, sources, known, new_folder(spark))
    # boxes that reach out of the image are faults of the set, as is right; the lines are all there
    outside = out["faults"].where("not endswith(fault, 'cx') and not endswith(fault, 'cy') and not endswith(fault, 'w') and not endswith(fault, 'h')")
    return out["lines"].select("split", "source_image", "n_boxes", F.lit(outside.isEmpty()).alias("valid"))
