"""Expressions over log events, replies, parameters and metrics."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The processing node that a log source belongs to, and the sources of the training channel.
NODE_OF_SOURCE = {
    "yolo_inference": "yolo_inference",
    "vlm_annotation": "vlm_annotation",
    "crop_extraction": "crop_extraction",
    "feature_extraction": "feature_extraction",
    "faiss_search": "faiss_search",
    "hdbscan_cluster": "hdbscan_cluster",
    "label_studio_sync": "save_manifest",
    "manifest_save": "save_manifest",
    "llm_advisor": "llm_advisor",
    "yolo_train": "train_yolo",
    "train_yolo": "train_yolo",
}
TRAIN_SOURCES = ["yolo_train", "train_yolo", "model_registry", "system", "llm_advisor"]
#: Words in a message that mark a state, by level.
STARTED = ["Starting", "running", "Triggering"]
FINISHED = ["complete", "saved", "finished", "deployed", "Ready for review"]
FINDINGS = "anomalies_found boolean, findings array<struct<box_2d array<double>, physical_traits string>>"


def _any(message: Column, words: list[str]) -> Column:
    out = F.contains(message, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(message, F.lit(w))
    return out


def source_to_node(source: Column) -> Column:
    pairs = [F.lit(x) for pair in NODE_OF_SOURCE.items() for x in pair]
    return F.get(F.array(F.try_element_at(F.create_map(*pairs), source)), F.lit(0))


def log_channel(level: Column, source: Column) -> Column:
    """Where an event is shown: node detail, train, or pipeline."""
    return F.when((level == "progress") & source_to_node(source).isNotNull(), "node").when(source.isin(TRAIN_SOURCES), "train").otherwise("pipeline")


def node_state(level: Column, source: Column, message: Column) -> Column:
    """active, done or fail for events of nodes, else null."""
    known = source_to_node(source).isNotNull()
    return (
        F.when(known & (level == "step") & _any(message, STARTED), "active")
        .when(known & (level == "info") & _any(message, FINISHED), "done")
        .when(known & (level == "error"), "fail")
    )


def run_state(message: Column) -> Column:
    """running, complete or failed for messages about the whole run; the last that applies."""
    return (
        F.when(F.contains(message, F.lit("pipeline failed")), "failed")
        .when(_any(message, ["pipeline finished", "pipeline complete"]), "complete")
        .when(_any(message, ["pipeline triggered", "pipeline started"]), "running")
    )


def extract_progress(message: Column) -> Column:
    """struct(epoch, epochs, loss) as text; null where absent."""
    of = lambda pattern, i: F.nullif(F.regexp_extract(message, pattern, i), F.lit(""))
    both = r"(?i)epoch\s+(\d+)/(\d+)"
    return F.struct(F.coalesce(of(both, 1), of(r"Epoch\s+(\d+)", 1)).alias("epoch"), of(both, 2).alias("epochs"), of(r"(?i)loss:\s*([0-9.]+)", 1).alias("loss"))


def parse_findings(reply: Column) -> Column:
    """struct(valid, findings): boxes of four numbers, traits never null; none unless anomalies were found."""
    parsed = F.from_json(reply, FINDINGS)
    good = F.filter(F.coalesce(parsed["findings"], F.array()), lambda f: F.size(f["box_2d"]) == 4)
    found = F.transform(good, lambda f: F.struct(f["box_2d"].alias("box_2d"), F.coalesce(f["physical_traits"], F.lit("")).alias("physical_traits")))
    valid = F.try_parse_json(reply).isNotNull()
    return F.struct(valid.alias("valid"), F.when(valid & F.coalesce(parsed["anomalies_found"], F.lit(False)), found).otherwise(F.slice(found, 1, 0)).alias("findings"))


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def version_id(number: Column, ts: Column) -> Column:
    return F.concat(F.lit("v"), number.cast("string"), F.lit("_"), run_id(ts))


def size_mb(n_bytes: Column) -> Column:
    return F.round(n_bytes / 1048576, 2)


def merge_defaults(given: Column, defaults: Column) -> Column:
    """defaults overlaid by given, for maps; null is an empty map."""
    rest = F.map_filter(defaults, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.when(given.isNull(), defaults).otherwise(F.map_concat(rest, given))


#: What an advice has where it says nothing.
ADVICE = {"should_train": False, "reason": "No recommendation available", "augmentation_notes": ""}
ADVICE_CONFIG = {
    "epochs": "1", "batch": "8", "imgsz": "640", "lr0": "0.01", "lrf": "0.01", "momentum": "0.937", "weight_decay": "0.0005", "warmup_epochs": "3.0", "patience": "15", "optimizer": "AdamW", "cos_lr": "true", "freeze": "10",
    "augment": "true", "mosaic": "1.0", "mixup": "0.1", "degrees": "15.0", "translate": "0.2", "scale": "0.5", "flipud": "0.5", "fliplr": "0.5", "hsv_h": "0.015", "hsv_s": "0.7", "hsv_v": "0.4",
}
#: The parameters of a training run that the user may give, with the advice's name for each and the default.
GIVEN = [("epochs", "epochs", 1), ("imgsz", "imgsz", 640), ("batch_size", "batch", 16)]


def merge_advice(reply: Column) -> Column:
    """struct(should_train, reason, augmentation_notes, config) of an advice (JSON text), with defaults at both levels.

    A key of config that the reply has stands, others have their default; a config that is no object is as if absent. Values of
    config are texts. A reply that is no JSON object is the default advice.
    """
    text = lambda path: F.get_json_object(reply, path)
    given = F.from_json(F.when(F.startswith(F.trim(text("$.config")), F.lit("{")), text("$.config")), "map<string, string>")
    defaults = F.create_map(*[F.lit(x) for pair in ADVICE_CONFIG.items() for x in pair])
    return F.struct(
        F.coalesce(text("$.should_train").try_cast("boolean"), F.lit(ADVICE["should_train"])).alias("should_train"),
        F.coalesce(text("$.reason"), F.lit(ADVICE["reason"])).alias("reason"),
        F.coalesce(text("$.augmentation_notes"), F.lit(ADVICE["augmentation_notes"])).alias("augmentation_notes"),
        merge_defaults(given, defaults).alias("config"),
    )


def training_params(user: Column, advice: Column) -> Column:
    """Map from every parameter of a training run to its value, as text: the user's, else the advised one, else the default.

    user and advice are maps of texts; a user's 0 or empty text counts as not given. Only epochs, image size and batch size can be
    given by the user; the others are as advised, and missing where the advice has none.
    """
    of = lambda m, k: F.try_element_at(F.coalesce(m, F.create_map().cast("map<string,string>")), F.lit(k))
    own = lambda k: F.when(~of(user, k).isin("0", "", "0.0"), of(user, k))
    first = F.create_map(*[x for name, advised, default in GIVEN for x in (F.lit(advised), F.coalesce(own(name), of(advice, advised), F.lit(str(default))))])
    others = [k for k in ADVICE_CONFIG if k not in {a for _, a, _ in GIVEN}]
    rest = F.map_filter(F.coalesce(advice, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(others))
    return F.map_concat(first, rest)


def first_given(user: Column, advice: Column, default, zero_is_missing: bool = False) -> Column:
    """The user's value, else the advised one, else the default."""
    if zero_is_missing:
        user, advice = F.nullif(user, F.lit(0)), F.nullif(advice, F.lit(0))
    return F.coalesce(user, advice, F.lit(default))


def strip_private(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~F.startswith(k, F.lit("_")))


def numeric_metrics(m: Column) -> Column:
    """Entries of a map of texts that are numbers, as doubles."""
    return F.transform_values(F.map_filter(m, lambda k, v: v.try_cast("double").isNotNull()), lambda k, v: v.try_cast("double"))


def normalize_metrics(m: Column, keys: tuple = ("map50", "map50_95", "precision", "recall")) -> list[Column]:
    """The named metrics of a map with keys in any case; missing is 0."""
    lower = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    return [F.coalesce(F.try_element_at(lower, F.lit(k)), F.lit(0.0)).alias(k) for k in keys]


def items_processed(*outputs: Column) -> Column:
    """Size of the first output that is there."""
    return F.coalesce(*[F.when(x.isNotNull(), F.size(x)) for x in outputs], F.lit(0))
