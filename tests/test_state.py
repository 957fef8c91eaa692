"""Tables that change safely, streams with state, and the flows, with failures and restarts between their steps."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import png

from noveltide import flows
from noveltide.functions import events as ev
from noveltide.operators import classes, labels, manifest, models
from noveltide.plans.storage import stored
from noveltide.sources import files, sinks
from noveltide.sources.tables import Tables, upsert
from noveltide.streaming import streams


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_versions_of_several_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    assert tables.current() == (0, {"tables": {}}) and tables.read("a", schema="x long").count() == 0
    assert tables.commit({"a": spark.range(3), "b": spark.range(5)}, note="first") == 1
    pinned = tables.read("a", 1)

    def fails(batch):
        raise ValueError("a task fails")
        yield batch

    broken = spark.range(10).mapInPandas(fails, "id long")
    with pytest.raises(Exception, match="a task fails"):
        tables.commit({"a": spark.range(9), "b": broken})  # a is written, b fails: neither changes
    assert tables.current()[0] == 1 and tables.read("a").count() == 3 and tables.read("b").count() == 5
    assert tables.commit({"a": spark.range(7), "b": None}) == 2
    assert tables.read("a").count() == 7 and pinned.count() == 3
    with pytest.raises(KeyError):
        tables.read("b")
    with pytest.raises(RuntimeError):
        tables.commit({"a": spark.range(1)}, base=1)
    assert tables.restore(1, note="back") == 3 and tables.read("b").count() == 5
    (tmp_path / "t" / "versions" / "000000004").write_text('{"tables": ')  # a writer died
    assert tables.current()[0] == 3 and tables.read("a").count() == 3
    assert tables.commit({"c": spark.range(1)}) == 5 and [n for n, _ in tables.history()] == [1, 2, 3, 5]
    tables.vacuum(1)
    assert tables.read("a").count() == 3 and tables.read("c").count() == 1


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_upsert_has_one_row_a_key(spark, tmp_path, kind):
    path = str(tmp_path / "u")
    make = lambda *x: spark.createDataFrame(x, "k long, s string, at long, v string")
    upsert(make((1, "a", 5, "x"), (1, "a", 3, "y"), (2, "a", 1, "z"), (None, "a", 1, "n")), path, ["k", "s"], kind=kind)
    read = lambda: sorted((r["k"] or -1, r["s"], r["at"], r["v"]) for r in spark.read.format(kind).schema("k long, s string, at long, v string").load(path).collect())
    assert read() == [(-1, "a", 1, "n"), (1, "a", 3, "y"), (2, "a", 1, "z")]
    for _ in range(2):
        upsert(make((1, "a", 0, "w"), (3, "b", 2, "q")), path, ["k", "s"], kind=kind)  # what is there stays
    assert read() == [(-1, "a", 1, "n"), (1, "a", 3, "y"), (2, "a", 1, "z"), (3, "b", 2, "q")]
    for _ in range(2):
        upsert(make((1, "a", 9, "w"), (2, "a", 0, "old"), (1, "a", 8, "v")), path, ["k", "s"], newest=["at"], kind=kind)
    assert read() == [(-1, "a", 1, "n"), (1, "a", 9, "w"), (2, "a", 1, "z"), (3, "b", 2, "q")]


def test_run_metrics_take_run_ids_as_text(spark, tmp_path):
    path = str(tmp_path / "m")
    make = lambda run, s: spark.createDataFrame([(run, "scan", s, 1.0, 2, 0)], "run string, step string, status string, latency double, items long, failures long")
    sinks.write_step_metrics(make("20240101_120000", "success").union(make("20240101_120000", "failed")), path)
    sinks.write_step_metrics(make("20240101_120001", "running"), path)
    assert rows(files.read_run_metrics(spark, path), "run", "status") == [("20240101_120000", "failed"), ("20240101_120001", "running")]


def test_label_lines_and_reader(spark, tmp_path):
    mapped = spark.createDataFrame([("a.jpg", "x", [0.5, 0.5, 0.1, 0.1])] * 2 + [("a.jpg", "y", [0.1, 0.2, 0.3, 0.4])], "source_image string, label string, center array<double>")
    got = labels.label_lines(mapped, spark.createDataFrame([("x", 0), ("y", 3)], "label string, class_id int")).first()
    assert got["n_boxes"] == 3 and got["lines"].split("\n") == ["0 0.500000 0.500000 0.100000 0.100000"] * 2 + ["3 0.100000 0.200000 0.300000 0.400000"]
    for split in ("train", "val"):
        (tmp_path / "labels" / split).mkdir(parents=True)
    (tmp_path / "labels" / "train" / "a.txt").write_text(got["lines"] + "\n")
    (tmp_path / "labels" / "val" / "b.c.txt").write_text("1 2\n\n0 .5 .5 .5 .5\n")
    read = files.read_label_lines(spark, str(tmp_path / "labels"))
    assert rows(read.where("trim(line) <> ''"), "split", "stem", "line_no") == [("train", "a", 1), ("train", "a", 2), ("train", "a", 3), ("val", "b.c", 1), ("val", "b.c", 3)]
    assert rows(labels.line_errors(read, 4), "stem", "line_no", "fault") == [("b.c", 1, "count")]
    assert rows(files.missing_directories(spark, str(tmp_path)), "fault") == [("missing directory images/train",), ("missing directory images/val",)]


def test_broken_images_are_zeros_and_others_are_resized(spark, tmp_path):
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 255, (40, 30, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(pixels))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "same.png").write_bytes(png(pixels[:8, :8]))
    got = {r["image_path"][-8:].split("/")[-1]: r for r in files.preprocess_images(files.decode_images(spark, str(tmp_path), keep_broken=True), 8).collect()}
    assert len(got) == 3 and set(got["b.png"]["tensor"]) == {0.0} and got["b.png"]["error"] and not got["a.png"]["error"]
    normal = lambda x: ((np.rint(x) / 255 - files.MEAN) / files.STD).transpose(2, 0, 1)
    assert np.allclose(np.reshape(got["same.png"]["tensor"], (3, 8, 8)), normal(pixels[:8, :8].astype(float)), atol=1e-5)
    want = np.zeros((8, 8, 3))
    for i in range(8):  # a triangle over each cell, pixel by pixel
        for j in range(8):
            wy = np.array([max(0, 1 - abs(y + 0.5 - (i + 0.5) * 5) / 5) for y in range(40)])
            wx = np.array([max(0, 1 - abs(x + 0.5 - (j + 0.5) * 3.75) / 3.75) for x in range(30)])
            w = np.outer(wy / wy.sum(), wx / wx.sum())
            want[i, j] = (pixels * w[..., None]).sum((0, 1))
    assert np.allclose(np.reshape(got["a.png"]["tensor"], (3, 8, 8)), normal(want), atol=0.02)
    assert np.allclose(files.resize_weights(4, 8).sum(1), 1) and files.resize_weights(1, 8).tolist() == [[1.0]] * 8


def log_rows(n, start=0):
    return [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, "info", "s", f"m{i}", None) for i in range(start, start + n)]


def test_log_keeps_the_newest_over_restarts(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "log", "cp"))
    write = lambda x: spark.createDataFrame(x, streams.LOG).coalesce(1).write.mode("append").json(source)
    write(log_rows(70, 30))
    run = lambda: streams.retain_newest(streams.stream_log(spark, source), root, checkpoint, n=50).awaitTermination()
    run()
    write(log_rows(30))  # late and older than all that is kept
    run()
    run()
    kept = lambda: rows(Tables(spark, root).read("log"), "seq")
    assert kept() == [(i,) for i in range(50, 100)]
    versions = Tables(spark, root).history()
    # the last batch comes again, as if its commit in the checkpoint had been lost
    last = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (tmp_path / "cp" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert kept() == [(i,) for i in range(50, 100)] and Tables(spark, root).history()[-1] == versions[-1]
    write(log_rows(5, 100))
    run()
    assert kept() == [(i,) for i in range(55, 105)]


def test_steps_without_an_end_fail_by_a_timer(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "steps", "cp"))
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "run string, step string, status string, ts timestamp, seq long"
    write = lambda *x: spark.createDataFrame(list(x), schema).coalesce(1).write.mode("append").parquet(source)

    def run(cp=checkpoint):
        events = spark.readStream.schema(schema).parquet(source)
        found = streams.stream_steps_with_limit(events, seconds=100, delay="10 seconds")
        streams.upsert_stream(found, path, ["run", "step"], ["last", "failures"], cp).awaitTermination()
        return {(r["run"], r["step"]): (r["status"], r["failures"], (r["last"] - r["started"]).total_seconds()) for r in spark.read.parquet(path).collect()}

    write(("r", "a", "running", at(0), 1), ("r", "a", "success", at(9), 2), ("r", "b", "running", at(5), 3), ("r", "c", "running", at(6), 4))
    assert run() == {("r", "a"): ("success", 0, 9.0), ("r", "b"): ("running", 0, 0.0), ("r", "c"): ("running", 0, 0.0)}
    write(("r", "c", "running", at(90), 5), ("r", "d", "running", at(130), 6))
    run()
    write(("r", "d", "failed", at(131), 7))
    got = run()
    assert got == {("r", "a"): ("success", 0, 9.0), ("r", "b"): ("failed", 1, 0.0), ("r", "c"): ("running", 0, 84.0), ("r", "d"): ("failed", 1, 1.0)}
    again = run(str(tmp_path / "other"))  # all batches again, in one: the end of each key is the same
    assert {k: v for k, v in again.items() if k != ("r", "b")} == {k: v for k, v in got.items() if k != ("r", "b")} and again["r", "b"][0] == "failed"


def test_new_images_by_batch_and_by_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "image_path string, cluster_name string, modified timestamp"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    days = [[("a", "c1", at(1)), ("b", "c1", at(2)), ("a", "c1", at(1))], [("b", "c1", at(2)), ("c", "c2", at(3)), (None, "c2", at(3))], [("a", "c9", at(4)), ("d", "c2", at(5)), (None, "c3", at(3))]]
    seen, by_batch, by_stream = spark.createDataFrame([], "image_path string"), [], []

    def keep(batch, number):
        by_stream.extend(tuple(r) for r in batch.collect())

    for day in days:
        new = streams.new_images(spark.createDataFrame(day, schema), seen)
        by_batch += [r["image_path"] for r in new.collect()]
        seen = stored(seen.union(new.select("image_path")))
        spark.createDataFrame(day, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.first_seen(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    key = lambda x: x or ""
    assert sorted(by_batch, key=key) == [None, "a", "b", "c", "d"] == sorted((r[0] for r in by_stream), key=key)


def test_decision_chain_goes_on_where_it_failed(spark, tmp_path):
    src = tmp_path / "in" / "cluster_000"
    src.mkdir(parents=True)
    (src / "1.png").write_bytes(b"1")
    flat = spark.createDataFrame([(f"/c/crop_{i}.jpg", i // 6, f"cluster_{i // 6:03d}", "rust" if i < 6 else None) for i in range(12)], "crop_path string, cluster_id int, cluster_name string, defect_name string")
    sources = spark.createDataFrame([(f"crop_{i}", f"img_{i // 2}.jpg", [0.5, 0.5, 0.1, 0.1]) for i in range(12)], "stem string, source_image string, center array<double>")
    known = spark.createDataFrame([("crack", 0)], "label string, pos int")
    calls, fail = [], {"sources", "act"}

    def read_sources():
        if "sources" in fail:
            fail.discard("sources")
            raise ValueError("down")
        return sources

    def act(decided, number):
        if "act" in fail:
            fail.discard("act")
            raise ValueError("the action is down")
        calls.append((number, rows(decided, "class_name", "crops")))

    def run():
        tick = streams.decision_chain(str(tmp_path / "root"), lambda: flat, read_sources, lambda: known, act)
        streams.orchestrate(streams.stream_new_images(spark, str(tmp_path / "in")), tick, str(tmp_path / "cp")).awaitTermination()

    tables = Tables(spark, str(tmp_path / "root"))
    for step in (0, 2):
        with pytest.raises(Exception, match="down"):
            run()
        assert tables.current()[1]["step"] == step
    run()
    run()  # nothing new
    assert calls == [(0, [("rust", 6)])] and [e["step"] for _, e in tables.history()] == [0, 1, 2, 3]
    assert tables.read("new_images").count() == 1 and rows(tables.read("classes"), "class_id", "label") == [(0, "crack"), (1, "rust")]
    assert rows(tables.read("label_lines"), "source_image", "n_boxes") == [("img_0.jpg", 2), ("img_1.jpg", 2), ("img_2.jpg", 2)]


def test_advice_and_parameters(spark):
    replies = [None, "no json", "{}", json.dumps({"should_train": True, "reason": "r", "config": {"epochs": 7, "own": "x", "cos_lr": False}}), json.dumps({"config": "text", "augmentation_notes": "n"})]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string").select("i", ev.merge_advice(F.col("reply")).alias("a"))
    got = {r["i"]: r["a"] for r in df.collect()}
    for i in (0, 1, 2, 4):
        assert got[i]["should_train"] is False and got[i]["reason"] == "No recommendation available" and got[i]["config"] == ev.ADVICE_CONFIG
    assert got[4]["augmentation_notes"] == "n"
    assert got[3]["should_train"] is True and got[3]["config"] == ev.ADVICE_CONFIG | {"epochs": "7", "own": "x", "cos_lr": "false"}
    users = [None, {"epochs": "0", "imgsz": "320"}, {"epochs": "5", "batch_size": ""}]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(users)], "i int, u map<string,string>")
    advice = F.create_map(*map(F.lit, ("epochs", "9", "lr0", "0.5", "unknown", "1")))
    given = {r["i"]: r["p"] for r in df.select("i", ev.training_params(F.col("u"), advice).alias("p")).collect()}
    assert given[0] == {"epochs": "9", "imgsz": "640", "batch": "16", "lr0": "0.5"}
    assert given[1]["imgsz"] == "320" and given[1]["epochs"] == "9" and given[2]["epochs"] == "5" and given[2]["batch"] == "16"
    none = df.select(ev.training_params(F.col("u"), F.lit(None).cast("map<string,string>")).alias("p")).first()["p"]
    assert none == {"epochs": "1", "imgsz": "640", "batch": "16"}


def test_classes_come_from_models_and_lists(spark):
    events = spark.createDataFrame([("crack", "first", 0)], "class_name string, source string, at long")
    names = spark.createDataFrame([("crack",), ("rust",), ("rust",), (None,)], "class_name string")
    after = classes.register_from_model(events, names, F.lit(1).cast("long"))
    descriptor = spark.createDataFrame([(["rust", "dent"],)], "names array<string>")
    after = classes.register_from_class_list(after, descriptor, F.lit(2).cast("long"))
    assert rows(after, "class_name", "source", "at") == [("crack", "first", 0), ("dent", "dashboard_naming", 2), ("rust", "model", 1)]
    assert classes.register_from_model(events, names.limit(0), F.lit(1).cast("long")).count() == 1


def test_clusters_in_pages(spark):
    flat = spark.createDataFrame([(f"c{i % 3}", f"p{i:03d}") for i in range(100)], "cluster_name string, crop_path string")
    pages = {(r["cluster_name"], r["page"]): r["crop_paths"] for r in manifest.cluster_pages(flat, stored, 15).collect()}
    assert {k: len(v) for k, v in pages.items()} == {(f"c{c}", p): 15 if p < 2 else 4 if c == 0 else 3 for c in range(3) for p in range(3)}
    assert [x for p in range(3) for x in pages["c1", p]] == sorted(f"p{i:03d}" for i in range(100) if i % 3 == 1)


def test_an_instrumented_step_records_failures(spark):
    empty = spark.createDataFrame([], "id long")
    out, record = models.run_step("good", lambda: spark.range(3), stored, empty)
    assert out.count() == 3 and (record["status"], record["items"], record["error"]) == ("success", 3, None)
    out, record = models.run_step("bad", lambda: spark.range(3).select("nothing"), stored, empty)
    assert out.count() == 0 and record["status"] == "failed" and "nothing" in record["error"]


def test_discovery_and_training_set(spark, tmp_path):
    """Two kinds of spots on images: discovery finds two groups; their names become a label set."""
    rng = np.random.default_rng(5)
    folder = tmp_path / "images of a+b"
    folder.mkdir()
    kinds = [np.kron(np.indices((8, 8)).sum(0) % 2, np.ones((8, 8))), np.tile(np.linspace(0, 1, 64) > 0.5, (64, 1))]
    for i in range(16):
        pixels = np.full((128, 128, 3), 40, dtype=np.uint8)
        pixels[32:96, 32:96] = (kinds[i % 2] * 180 + rng.integers(0, 9, (64, 64)))[..., None].astype(np.uint8)
        (folder / f"img_{i:02d}.png").write_bytes(png(pixels))
    (folder / "broken.png").write_bytes(b"x")

    def detector():
        return lambda rows: [{"image_path": r["image_path"], "class_id": 0, "class_name": "crack", "confidence": 0.9 if "img_00" in r["image_path"] else 0.1, "bbox_xyxy": [0.0] * 4} for r in rows]

    asked = tmp_path / "asked"
    asked.mkdir()

    def annotator():
        def call(path):
            if "broken" in path:
                raise ValueError("no image")
            (asked / f"{path.split('/')[-1]}-{rng.integers(1 << 60)}").write_text("")
            return json.dumps({"anomalies_found": True, "findings": [{"box_2d": [250, 250, 750, 750], "physical_traits": "spot"}, {"box_2d": [0, 0, 10, 10]}]})

        return call

    known = spark.createDataFrame([("crack",)], "class_name string")
    index = spark.createDataFrame([], "ref_id long, label string, vector array<double>")
    root = str(tmp_path / "run")

    def run(name, cache):
        return flows.discover(spark, str(folder), root, name, known, index, detector, annotator, models.random_projection(16), use_cache=cache, pause=0, sleep=lambda s: None)

    out = run("20240101_000000", False)
    status = {r["step"]: (r["status"], r["items"]) for r in out["metrics"].collect()}
    assert {s for s, _ in status.values()} == {"success"}, out["metrics"].where("error is not null").collect()
    assert status["images"][1] == 17 and status["findings"][1] == 30 and status["crops"][1] == 15
    flat = out["manifest"].orderBy("source_image").collect()
    assert len(flat) == 15 and {r["physical_traits"] for r in flat} == {"spot"}
    group = {int(r["source_image"][-6:-4]) % 2: r["cluster_name"] for r in flat}
    assert all(r["cluster_name"] == group[int(r["source_image"][-6:-4]) % 2] for r in flat) and group[0] != group[1]
    assert files.read_run_metrics(spark, f"{root}/metrics").count() == len(status)
    # named groups become a checked label set
    names = F.when(F.col("cluster_name") == group[0], "checks").otherwise("halves")
    named = out["manifest"].withColumn("defect_name", names)
    sources = files.read_crop_sources(spark.read.text(f"{root}/crop_sources"))
    ready = flows.prepare_training_set(named, sources, spark.createDataFrame([("crack", 0)], "label string, pos int"), str(tmp_path / "set"), user={"epochs": "3"})
    assert rows(ready["classes"], "class_id", "label")[0] == (0, "crack") and ready["classes"].count() == 3 and ready["faults"].count() == 0
    assert ready["lines"].agg(F.sum("n_boxes")).first()[0] == 15
    decision, gates = ready["decision"].first(), ready["gates"].first()
    assert decision["params"] == {"epochs": "3", "imgsz": "640", "batch": "16"} and decision["should_train"] is False  # seven crops in the smallest class
    assert gates["may_version"] and not gates["may_deploy"]
    advice = spark.createDataFrame([(json.dumps({"should_train": True, "config": {"lr0": 0.2}}),)], "reply string")
    told = flows.prepare_training_set(named, sources, spark.createDataFrame([("crack", 0)], "label string, pos int"), str(tmp_path / "set"), advice)
    assert told["decision"].first()["should_train"] and told["decision"].first()["params"]["lr0"] == "0.2" and told["gates"].first()["may_deploy"]
