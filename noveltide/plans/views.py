"""The library's tables as views over the general test tables, in Spark; VIEWS has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: at this squared distance the test vectors fall on both sides.
NOVEL = 1.35

_IMG = "format_string('img_%06d.jpg', l_orderkey)"  # lpad would cut keys of more digits
_BOXES = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {img} AS image_path,
  CAST(240 + (l_orderkey % 5) * 120 AS INT) AS h, CAST(320 + (l_orderkey % 7) * 80 AS INT) AS w,
  CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE CASE WHEN l_quantity > 44 THEN 0 ELSE 1 END END AS z,
  CAST(((l_partkey * 7) % 701 - 20) AS DOUBLE) AS a, CAST((l_suppkey * 13) % 701 AS DOUBLE) AS b,
  CAST((l_partkey * 7) % 701 AS DOUBLE) AS c, CAST(l_quantity * 20 AS DOUBLE) AS q, CAST(((l_orderkey * 17) % 50 + 1) * 20 AS DOUBLE) AS e
FROM lineitem
"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def views(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [globals()[f"_{n}"](spark, d) for n in names]


def _vectors(spark, d):
    from ..functions.vectors import l2_normalize

    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", l2_normalize(F.col("embedding")).alias("vector"))


def _known(spark, d):
    return _vectors(spark, d).where("label <= 2").select(F.col("id").alias("ref_id"), F.col("label").cast("string").alias("label"), "vector")


def _asked(spark, d):
    return _vectors(spark, d).where("label > 2").select(F.col("id").alias("query_id"), F.col("label").alias("own_label"), "vector")


def _detections(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.format_string("img_%06d.jpg", "l_orderkey").alias("image_path"), F.col("l_linenumber").alias("class_id"), F.col("p_type").alias("class_name"), F.round(F.col("l_discount") * 10, 4).alias("confidence")
    )


def _known_names(spark, d):
    return spark.createDataFrame([("medium",), ("promo",)], "class_name string")


def _images(spark, d):
    return table(spark, d, "orders").select(F.format_string("img_%06d.jpg", "o_orderkey").alias("image_path"), "o_orderkey")


def _known_crops(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 50 = 0")
    return o.select(F.concat(F.lit("class_"), (F.col("o_orderkey") % 3).cast("string")).alias("class_name"), F.format_string("img_%06d_crop_%04d.jpg", F.col("o_orderkey"), F.lit(0)).alias("crop_name"))


def _boxes(spark, d):
    line = table(spark, d, "lineitem")
    line.createOrReplaceTempView("_boxes_lines")
    b = spark.sql(_BOXES.format(img=_IMG).replace("FROM lineitem", "FROM _boxes_lines"))
    big = F.array(F.col("a") * F.col("z"), F.col("b") * F.col("z"), F.col("c") * F.col("z") + F.col("q"), F.when(F.col("z") == 0, F.lit(950.0)).otherwise(F.col("b") * F.col("z") + F.col("e")))
    box = F.when(F.col("z").isNull(), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(big)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "image_path", "h", "w", box.alias("box"))


def _replies(spark, d):
    b = _boxes(spark, d)
    reply = (
        F.when(F.col("l_orderkey") % 17 == 0, "not json")
        .when(F.col("l_orderkey") % 19 == 0, "{}")
        .otherwise(
            F.concat(
                F.when(F.col("l_orderkey") % 23 == 0, '{"anomalies_found": false, ').otherwise('{"anomalies_found": true, '),
                F.lit('"findings": [{"box_2d": '), F.to_json("box"), F.when(F.col("l_linenumber") % 2 == 0, '}]}').otherwise(', "physical_traits": "t"}]}'),
            )
        )
    )
    return b.select("image_path", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", reply.alias("reply"))


def _label_lines(spark, d):
    k, line = F.col("l_orderkey") % 13, table(spark, d, "lineitem")
    text = (
        F.when(k == 0, "1 0.5 0.5 0.5").when(k == 1, "x 0.5 0.5 0.5 0.5").when(k == 2, "99 0.5 0.5 0.5 0.5").when(k == 3, "1 1.5 0.5 0.5 0.5")
        .when(k == 4, "1 nan 0.5 0.5 0.5").when(k == 5, "").when(k == 6, "1.0 0.5 0.5 0.5 0.5").otherwise("  2 0.25 0.5  0.125 1 ")
    )
    return line.select(F.when(F.col("l_orderkey") % 9 == 0, "val").otherwise("train").alias("split"), F.format_string("img_%06d", "l_orderkey").alias("stem"), F.col("l_linenumber").alias("line_no"), text.alias("line"))


def _clusters(spark, d):
    """A flat manifest: label - 1 is the cluster; clusters above 5 have no name."""
    from ..operators.manifest import cluster_name

    e, n = table(spark, d, "embeddings"), table(spark, d, "nation")
    c = e.select(F.format_string("crop_%06d.jpg", "vec_id").alias("crop_path"), (F.col("label") - 1).alias("cluster_id"), F.col("vec_id"), F.col("label"))
    c = c.join(n.select(F.col("n_nationkey").alias("label"), "n_name"), "label", "left")
    return c.select("crop_path", "cluster_id", cluster_name(F.col("cluster_id")).alias("cluster_name"), F.when(F.col("label") < 6, F.col("n_name")).alias("defect_name"), "vec_id")


def _versions(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("model"), F.col("o_orderdate").alias("created_at"))


def _deployments(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return o.select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("model"), F.col("o_orderdate").alias("deployed_at"), F.when(F.col("o_orderstatus") == "O", "rollback").otherwise("deploy").alias("action"))


def _log(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 11
    names = ["yolo_inference", "vlm_annotation", "crop_extraction", "faiss_search", "label_studio_sync", "train_yolo", "system"]
    source = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 7 + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, ["step", "info", "error", "progress", "warning"])), (F.col("event_id") % 5 + 1).cast("int"))
    message = (
        F.when(F.col("event_id") % 1000 == 0, "Discovery pipeline started").when(F.col("event_id") % 1000 == 900, "pipeline complete")
        .when(k < 4, F.concat(F.lit("Epoch "), (F.col("event_id") % 30).cast("string"), F.lit("/30 completed. Loss: 0."), (F.col("event_id") % 97).cast("string")))
        .when(k < 6, "Starting work").when(k < 9, "work complete").otherwise("FAILED")
    )
    return e.select("ts", F.col("event_id").alias("seq"), level.alias("level"), source.alias("source"), message.alias("message"))


def _steps(spark, d):
    status = F.element_at(F.array(*map(F.lit, ["pending", "running", "success", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    items = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("step"), "ts", F.col("event_id").alias("seq"), status.alias("status"), items.alias("items"), F.when(status == "failed", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error")
    )


def _class_events(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_name").alias("class_name"), F.concat(F.lit("batch_"), F.col("n_regionkey").cast("string")).alias("source"), F.col("n_regionkey").cast("long").alias("at"))


#: The same views for DuckDB.
VIEWS = {
    "vectors": """SELECT id, label, list_transform(x, lambda e: e / CASE WHEN s = 0 THEN 1 ELSE s END) AS vector FROM (
      SELECT vec_id AS id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x,
        sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))) AS s FROM embeddings)""",
    "nearest": """SELECT query_id, own_label, unnest(m) FROM (SELECT q.id AS query_id, q.label AS own_label,
      min(struct_pack(distance := list_sum(list_transform(list_zip(q.vector, r.vector), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), ref_id := r.id, label := CAST(r.label AS VARCHAR))) AS m
      FROM vectors q, vectors r WHERE q.label > 2 AND r.label <= 2 GROUP BY 1, 2)""",
    "detections": """SELECT printf('img_%06d.jpg', l_orderkey) AS image_path, l_linenumber AS class_id, p_type AS class_name, round(l_discount * 10, 4) AS confidence
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "images": "SELECT printf('img_%06d.jpg', o_orderkey) AS image_path, o_orderkey FROM orders",
    "known_crops": "SELECT 'class_' || (o_orderkey % 3) AS class_name, printf('img_%06d_crop_0000.jpg', o_orderkey) AS crop_name FROM orders WHERE o_orderkey % 50 = 0",
    "raw_boxes": _BOXES.format(img="printf('img_%06d.jpg', l_orderkey)"),
    "boxes": """SELECT *, CASE WHEN z IS NULL THEN [1.0, 2.0, 3.0] ELSE [a * z, b * z, c * z + q, CASE WHEN z = 0 THEN 950.0 ELSE b * z + e END] END AS box FROM raw_boxes""",
    "pixels": """SELECT *, CASE WHEN len(box) = 4 THEN [greatest(CAST(trunc(box[1] * h / 1000) AS INT), 0), greatest(CAST(trunc(box[2] * w / 1000) AS INT), 0),
      least(CAST(trunc(box[3] * h / 1000) AS INT), h), least(CAST(trunc(box[4] * w / 1000) AS INT), w)] END AS px FROM boxes""",
    "rejected": """SELECT *, CASE WHEN len(box) <> 4 THEN 'box' WHEN px[4] - px[2] < 30 OR px[3] - px[1] < 30 OR (px[4] - px[2]) * (px[3] - px[1]) < 900 THEN 'size'
      WHEN px[4] - px[2] > 0.85 * w AND px[3] - px[1] > 0.85 * h THEN 'zoom' END AS reason FROM pixels""",
    "label_lines": """SELECT CASE WHEN l_orderkey % 9 = 0 THEN 'val' ELSE 'train' END AS split, printf('img_%06d', l_orderkey) AS stem, l_linenumber AS line_no,
      CASE l_orderkey % 13 WHEN 0 THEN '1 0.5 0.5 0.5' WHEN 1 THEN 'x 0.5 0.5 0.5 0.5' WHEN 2 THEN '99 0.5 0.5 0.5 0.5' WHEN 3 THEN '1 1.5 0.5 0.5 0.5'
      WHEN 4 THEN '1 nan 0.5 0.5 0.5' WHEN 5 THEN '' WHEN 6 THEN '1.0 0.5 0.5 0.5 0.5' ELSE '  2 0.25 0.5  0.125 1 ' END AS line FROM lineitem""",
    "clusters": """SELECT printf('crop_%06d.jpg', vec_id) AS crop_path, label - 1 AS cluster_id, CASE WHEN label = 0 THEN 'noise' ELSE printf('cluster_%03d', label - 1) END AS cluster_name,
      CASE WHEN label < 6 THEN n_name END AS defect_name, vec_id FROM embeddings LEFT JOIN nation ON n_nationkey = label""",
    "versions": "SELECT o_custkey AS line, o_orderkey AS model, o_orderdate AS created_at FROM orders",
    "deployments": "SELECT o_custkey AS line, o_orderkey AS model, o_orderdate AS deployed_at, CASE WHEN o_orderstatus = 'O' THEN 'rollback' ELSE 'deploy' END AS action FROM orders WHERE o_orderstatus <> 'P'",
    "log": """SELECT ts, event_id AS seq, ['step', 'info', 'error', 'progress', 'warning'][event_id % 5 + 1] AS level,
      ['yolo_inference', 'vlm_annotation', 'crop_extraction', 'faiss_search', 'label_studio_sync', 'train_yolo', 'system'][event_id % 7 + 1] AS source,
      CASE WHEN event_id % 1000 = 0 THEN 'Discovery pipeline started' WHEN event_id % 1000 = 900 THEN 'pipeline complete'
        WHEN event_id % 11 < 4 THEN 'Epoch ' || (event_id % 30) || '/30 completed. Loss: 0.' || (event_id % 97) WHEN event_id % 11 < 6 THEN 'Starting work'
        WHEN event_id % 11 < 9 THEN 'work complete' ELSE 'FAILED' END AS message FROM events""",
    "node_log": """SELECT *, CASE source WHEN 'system' THEN NULL WHEN 'label_studio_sync' THEN 'save_manifest' ELSE source END AS node FROM log""",
    "states": """SELECT *, CASE WHEN node IS NULL THEN NULL WHEN level = 'step' AND (contains(message, 'Starting') OR contains(message, 'running') OR contains(message, 'Triggering')) THEN 'active'
      WHEN level = 'info' AND (contains(message, 'complete') OR contains(message, 'saved') OR contains(message, 'finished') OR contains(message, 'deployed')) THEN 'done'
      WHEN level = 'error' THEN 'fail' END AS state,
      CASE WHEN contains(message, 'pipeline finished') OR contains(message, 'pipeline complete') THEN 'complete' WHEN contains(message, 'pipeline started') THEN 'running' END AS run FROM node_log""",
    "steps": """SELECT user_id AS run, event_type AS step, ts, event_id AS seq, ['pending', 'running', 'success', 'failed'][event_id % 4 + 1] AS status,
      CAST(json_extract(props, '$.k') AS BIGINT) AS items, CASE WHEN event_id % 4 = 3 THEN 'e' || event_id END AS error FROM events""",
    "metrics": """SELECT run, step, max_by(status, row(ts, seq)) AS status, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS latency, max_by(items, row(ts, seq)) AS items,
      count_if(status = 'failed') AS failures FROM steps GROUP BY run, step""",
    "class_events": """SELECT n_name AS class_name, 'batch_' || n_regionkey AS source, CAST(n_regionkey AS BIGINT) AS "at" FROM nation""",
}
_NEEDS = {"nearest": ["vectors"], "boxes": ["raw_boxes"], "pixels": ["raw_boxes", "boxes"], "rejected": ["raw_boxes", "boxes", "pixels"], "node_log": ["log"], "states": ["log", "node_log"], "metrics": ["steps"]}


def with_views(query: str, *names: str, recursive: bool = False) -> str:
    """A DuckDB query over the named views."""
    order: list[str] = []
    for n in names:
        for v in [*_NEEDS.get(n, []), n]:
            if v not in order:
                order.append(v)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + query
