"""The two flows that users start with, composed of the operators: discovery of new groups, and a training set from their names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boxes as bx
from .functions import events as ev
from .functions.paths import path_name, path_stem
from .operators import clustering, labels, manifest, models, nearest, readiness, routing
from .operators.indexing import running_index
from .plans.storage import stored
from .sources import files, sinks

DETECTIONS = "image_path string, class_id int, class_name string, confidence double, bbox_xyxy array<double>"
FINDINGS = "image_path string, finding_index int, box array<double>, traits string"
CROPS = "crop_path string, image_path string, height int, width int, channels int, data binary, variance double, finding_index int, traits string, center array<double>"
VECTORS = "crop_path string, id long, vector array<float>"


def discover(
    spark: SparkSession,
    directory: str,
    root: str,
    run: str,
    known: DataFrame,
    index: DataFrame,
    detector: Callable,
    annotator: Callable,
    embedder: Callable,
    known_crops: DataFrame | None = None,
    use_cache: bool = False,
    threshold: float = nearest.NOVEL,
    write: Callable[[DataFrame], DataFrame] = stored,
    **annotating,
) -> dict[str, DataFrame]:
    """From a folder of images to a manifest of clusters of what is new, written under root.

    Images are scored and routed; unknown ones are annotated; boxes are filtered and cut; crops embedded; those far from the
    index clustered; the manifest has each crop with its cluster. detector, annotator and embedder make the caller's functions
    (see models); annotating has the tries and pauses of annotate_images. With use_cache, crops and annotations of the run before are taken again, if some annotation has findings; else
    they go first. A step that fails gives an empty table, and its error in `metrics`; the steps after it run on that.
    Returns every step's table by name, stored.
    """
    out, records = {}, []
    names = known.select(F.col("class_name"))

    def step(name: str, make: Callable[[], DataFrame], schema: str) -> DataFrame:
        out[name], record = models.run_step(name, make, write, spark.createDataFrame([], schema))
        records.append(record)
        return out[name]

    kept, counts = files.read_annotations(spark, f"{root}/annotations", multi_line=False) if use_cache else (None, False)
    if not counts:
        sinks.clean_run(spark, root, ["annotations", "crops", "clusters", "manifest"])
    images = step("images", lambda: files.scan_images(spark, directory, recursive=True).select("image_path"), "image_path string")
    step("detections", lambda: models.score_images(images, detector), DETECTIONS)
    classified = step("classified", lambda: routing.classify_images(images, out["detections"], names, known_crops), "image_path string, n_detections long, classified_as string")
    unknown = classified.where("classified_as = 'unknown'").select("image_path")
    sinks.write_unknowns(classified, f"{root}/unknown")

    def annotate() -> DataFrame:
        if counts:
            cached = kept.join(unknown, "image_path", "left_semi").select("image_path", F.posexplode("findings").alias("finding_index", "f"))
            return cached.select("image_path", "finding_index", F.col("f.box_2d").alias("box"), F.coalesce("f.physical_traits", F.lit("")).alias("traits"))
        replies = write(models.annotate_images(unknown, annotator, **annotating))
        parsed = replies.select("image_path", "error", ev.parse_findings(F.col("reply")).alias("p"))
        rows = parsed.select("image_path", path_name(F.col("image_path")).alias("image_name"), (F.size("p.findings") > 0).alias("anomalies_found"), F.col("p.findings").alias("findings"), F.lit(0).alias("prompt_tokens"), "error")
        sinks.write_annotations(rows, f"{root}/annotations")
        return parsed.select("image_path", F.posexplode("p.findings").alias("finding_index", "f")).select("image_path", "finding_index", F.col("f.box_2d").alias("box"), F.col("f.physical_traits").alias("traits"))

    found = step("findings", annotate, FINDINGS)

    def cut() -> DataFrame:
        pixels = files.decode_images(spark, directory).join(unknown, "image_path", "left_semi")
        sized = found.join(pixels.select("image_path", "height", "width"), "image_path")
        keep = sized.where(bx.reject_reason(F.col("box"), F.col("height"), F.col("width")).isNull())
        rows = running_index(keep, write, "image_path", "finding_index").withColumn("crop_path", F.concat(F.lit(f"{root}/crops/"), F.format_string("crop_%06d.jpg", "index")))
        rows = write(rows.select("crop_path", "image_path", "finding_index", "traits", "box", bx.box_to_pixels(F.col("box"), F.col("height"), F.col("width")).alias("px")))
        crops = files.crop_pixels(pixels, rows).where(F.col("variance") >= bx.MIN_VARIANCE)
        return crops.join(rows.select("crop_path", "finding_index", "traits", bx.box_to_center(F.col("box")).alias("center")), "crop_path")

    crops = step("crops", cut, CROPS)
    sinks.write_crops(crops, f"{root}/crops")
    sinks.write_crop_sources(crops.select(path_stem(F.col("crop_path")).alias("stem"), F.col("image_path").alias("source_image"), "center"), f"{root}/crop_sources")

    def embed() -> DataFrame:
        tensors = write(files.preprocess_images(crops.select(F.col("crop_path").alias("image_path"), "height", "width", "channels", "data")).select(F.col("image_path").alias("crop_path"), "tensor"))
        return models.embed_images(tensors, embedder).select("crop_path", F.xxhash64("crop_path").alias("id"), "vector")

    vectors = step("vectors", embed, VECTORS)
    far = step("nearest", lambda: nearest.nearest_known(vectors.select(F.col("id").alias("query_id"), "vector"), index), nearest.OUT)
    novel = nearest.novel(far, threshold).select(F.col("query_id").alias("id"))
    step("clusters", lambda: clustering.cluster_novel(vectors.join(novel, "id").select("id", "vector"), write), "id long, cluster_id int")

    def publish() -> DataFrame:
        rows = out["clusters"].join(vectors.select("id", "crop_path"), "id").select("crop_path", "cluster_id", manifest.cluster_name(F.col("cluster_id")).alias("cluster_name"), F.lit(None).cast("string").alias("defect_name"))
        meta = crops.select("crop_path", F.col("image_path").alias("source_image"), F.col("traits").alias("physical_traits"), "finding_index", F.lit(0).alias("seq"))
        return manifest.attach_crop_metadata(rows, meta)

    flat = step("manifest", publish, "crop_path string, cluster_id int, cluster_name string, defect_name string, source_image string, physical_traits string, finding_index int")
    sinks.write_clusters(flat, f"{root}/clusters")
    sinks.write_manifest(manifest.build_manifest(flat), f"{root}/manifest", run)
    rows = [(run, r["step"], r["status"], float(r["latency"]), int(r["items"]), int(r["status"] == "failed"), r["error"]) for r in records]
    out["metrics"] = spark.createDataFrame(rows, "run string, step string, status string, latency double, items long, failures long, error string")
    sinks.write_step_metrics(out["metrics"].drop("error"), f"{root}/metrics")
    return out


def prepare_training_set(
    flat: DataFrame,
    sources: DataFrame,
    known: DataFrame,
    path: str,
    advice: DataFrame | None = None,
    user: dict[str, str] | None = None,
    val_fraction: float = 0.0,
    write: Callable[[DataFrame], DataFrame] = stored,
) -> dict[str, DataFrame]:
    """From a named manifest to a checked label set at path, and whether and how to train on it.

    flat: the manifest's crops; sources: (stem, source_image, center); known: (label, pos), whose numbers stay. advice, if given,
    has one row with a reply (JSON text); user has what the user sets. Returns lines, classes, faults, stats (with the rule of
    readiness), decision (should_train, reason, params) and gates.
    """
    spark = flat.sparkSession
    named = manifest.named_clusters(flat)
    rows = named.select(path_stem(F.col("crop_path")).alias("stem"), F.col("defect_name").alias("label"), F.col("cluster_id").alias("seq"))
    classes = write(labels.encode_classes(rows.select("label", "seq"), known))
    lines = labels.label_lines(labels.crops_to_sources(rows.select("stem", "label"), sources), classes)
    lines = write(lines.withColumn("split", labels.split_of(F.col("source_image"), val_fraction)))
    sinks.write_label_set(lines, f"{path}/labels")
    sinks.write_class_descriptor(classes, f"{path}/descriptor")
    each = lines.select("split", path_stem(F.col("source_image")).alias("stem"), F.posexplode(F.split("lines", "\n")).alias("n", "line")).select("split", "stem", (F.col("n") + 1).alias("line_no"), "line")
    n = classes.count()
    faults = labels.line_errors(each, n).select(F.concat_ws(" ", "split", "stem", "line_no", "fault").alias("fault"))
    faults = write(faults.union(labels.descriptor_errors(spark.read.json(f"{path}/descriptor"))))
    stats = write(readiness.training_preview(flat))
    reply = advice.select("reply").limit(1) if advice is not None else spark.createDataFrame([(None,)], "reply string")
    told = reply.select("reply", ev.merge_advice(F.col("reply")).alias("a"))
    given = F.create_map(*[F.lit(str(x)) for pair in (user or {}).items() for x in pair]) if user else F.lit(None).cast("map<string,string>")
    unset = F.col("reply").isNull()  # without advice the rule of readiness decides, and parameters have their defaults
    params = ev.training_params(given, F.when(~unset, F.col("a.config")))
    decision = stats.join(told, F.lit(True)).select(
        F.when(unset, F.col("should_train")).otherwise(F.col("a.should_train")).alias("should_train"), F.when(unset, F.col("reason")).otherwise(F.col("a.reason")).alias("reason"), params.alias("params")
    )
    exported, valid = lines.agg(F.sum("n_boxes")).first()[0] or 0, faults.isEmpty()
    state = decision.select(F.lit(exported).alias("exported"), F.lit(valid).alias("valid"), F.col("should_train").alias("trained"), F.lit(False).alias("deployed_ok"))
    return {"lines": lines, "classes": classes, "faults": faults, "stats": stats, "decision": write(decision), "gates": write(readiness.gates(state))}
