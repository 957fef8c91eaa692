"""Operators without a DuckDB twin, boundaries, and repeated runs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noveltide.functions import boxes as bx
from noveltide.functions import events as ev
from noveltide.operators import clustering, labels, models, nearest
from noveltide.plans.storage import stored
from noveltide.sources import files, sinks
from noveltide.streaming import streams


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape[:2]
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def points(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")


@pytest.mark.parametrize(("n", "want"), [(1, (2, 1)), (4, (2, 1)), (5, (3, 1)), (19, (3, 1)), (20, (4, 2)), (59, (4, 2)), (60, (6, 3)), (149, (6, 3)), (150, (12, 6))])
def test_params(n, want, spark):
    assert clustering.params(n) == want
    least, k = clustering.cluster_params(F.lit(n))
    assert tuple(spark.range(1).select(least, k).first()) == want


def test_density_clusters_find_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.02, (12, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 3, 0))] + [rng.uniform(6, 30, (4, 3))])
    got = [r["cluster_id"] for r in clustering.density_cluster(points(spark, x), 4, 2, stored).orderBy("id").collect()]
    assert got[:36] == [0] * 12 + [1] * 12 + [2] * 12
    assert set(got[36:]) == {-1}


def test_average_linkage_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 3, (40, 2))
    groups = {i: [i] for i in range(len(x))}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    while len(groups) > 1:
        v, a, b = min((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in groups for b in groups if a < b)
        if v >= 0.65:
            break
        groups[a] += groups.pop(b)
    want = {i: min(g) for g in groups.values() for i in g}
    rows = {r["id"]: r["cluster_id"] for r in clustering.average_linkage(points(spark, x), 0.65, stored).collect()}
    heads = {c: min(i for i in rows if rows[i] == c) for c in rows.values()}
    assert {i: heads[c] for i, c in rows.items()} == want


def test_nearest_blocks_agree_and_ties_take_smallest(spark):
    rng = np.random.default_rng(2)
    refs = np.concatenate([rng.normal(size=(60, 4)), np.zeros((2, 4))])
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 4)))] + [(99, [0.0] * 4), (98, None)], "query_id long, vector array<double>")
    r = spark.createDataFrame([(i, str(i), v.tolist()) for i, v in enumerate(refs)], "ref_id long, label string, vector array<double>")
    a = sorted(map(tuple, nearest.nearest_known(q, r).collect()))
    assert a == sorted(map(tuple, nearest.nearest_known(q, r, broadcast_rows=5, block=7).collect()))
    assert [x for x in a if x[0] == 99] == [(99, 0.0, 60, "60")]
    none = nearest.nearest_known(q, r.limit(0)).collect()
    assert {(x["distance"], x["label"]) for x in none} == {(float("inf"), "unknown")}


def test_boundaries(spark):
    rows = [([0.0, 0.0, 300.0, 290.0], None), ([0.0, 0.0, 300.0, 300.0], None), ([0.0, 0.0, 860.0, 860.0], None), ([0.0, 0.0, 850.0, 990.0], None), ([1.0], None), (None, None), ([0.0, 0.0, 400.0, 400.0], 24.9), ([0.0, 0.0, 400.0, 400.0], 25.0)]
    df = spark.createDataFrame(rows, "box array<double>, v double")
    got = [r[0] for r in df.select(bx.reject_reason(F.col("box"), F.lit(100), F.lit(100), F.col("v"))).collect()]
    assert got == ["size", None, "zoom", None, "box", "box", "blur", None]
    lines = spark.createDataFrame([("t", "a", 1, "1 nan .5 .5 .5"), ("t", "a", 2, "6 .5 .5 .5 .5"), ("t", "a", 3, "5 0 1 0 1"), ("t", "a", 4, " ")], "split string, stem string, line_no int, line string")
    assert sorted((r["line_no"], r["fault"]) for r in labels.line_errors(lines, 6).collect()) == [(1, "cx"), (2, "class")]


def test_replies_that_are_odd(spark):
    rows = [("not json",), ("{}",), (None,), ('{"anomalies_found": true, "findings": [{"box_2d": [1, 2.5, 3, 4]}, {"box_2d": [1]}]}',)]
    p = ev.parse_findings(F.col("r"))
    got = spark.createDataFrame(rows, "r string").select(p["valid"].alias("v"), F.size(p["findings"]).alias("n")).collect()
    assert [(bool(x["v"]), x["n"]) for x in got] == [(False, 0), (True, 0), (False, 0), (True, 1)]


def test_images_and_crops(spark, tmp_path):
    rng = np.random.default_rng(3)
    folder = tmp_path / "known" / "scratch"
    folder.mkdir(parents=True)
    noise = rng.integers(0, 255, (40, 60, 3), dtype=np.uint8)
    (folder / "a.PNG").write_bytes(png(noise))
    (folder / "b.png").write_bytes(png(np.full((40, 60, 3), 7, dtype=np.uint8)))
    (folder / "c.png").write_bytes(b"broken")
    (folder / "d.txt").write_text("x")
    assert files.scan_images(spark, str(folder)).count() == 3
    assert files.scan_images(spark, str(tmp_path / "none")).count() == 0
    assert {r["label"] for r in files.scan_labeled_images(spark, str(tmp_path / "known"), allowed=["SCRATCH"]).collect()} == {"scratch"}
    images = files.decode_images(spark, str(folder))
    assert images.count() == 2
    cut = images.select("image_path", F.col("image_path").alias("crop_path"), F.array(*map(F.lit, (5, 5, 35, 35))).alias("px"))
    crops = {r["image_path"][-5:]: r for r in files.crop_pixels(images, cut).collect()}
    assert crops["b.png"]["variance"] == 0 and crops["a.PNG"]["variance"] > 25
    assert (np.frombuffer(crops["a.PNG"]["data"], np.uint8).reshape(30, 30, 3)[..., ::-1] == noise[5:35, 5:35]).all()
    tensors = files.preprocess_images(images, 8).withColumnRenamed("image_path", "crop_path")
    vectors = models.embed_images(tensors, models.random_projection(16)).collect()
    assert all(abs(np.linalg.norm(v["vector"]) - 1) < 1e-5 for v in vectors)


def test_stream_sees_each_file_once(spark, tmp_path):
    src = tmp_path / "in" / "cluster_000"
    src.mkdir(parents=True)
    seen = []

    def run():
        streams.orchestrate(streams.stream_new_images(spark, str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()

    (src / "1.png").write_bytes(b"1")
    run()
    (src / "2.png").write_bytes(b"2")
    run()
    run()
    assert sum(seen) == 2


def test_sinks_can_run_again(spark, tmp_path):
    lines = spark.createDataFrame([("train", "a.jpg", "0 .5 .5 1 1")], "split string, source_image string, lines string")
    for _ in range(2):
        sinks.write_label_set(lines, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).count() == 1
    assert files.load_index(spark, str(tmp_path / "no")).count() == 0
    sinks.reset_index(spark, str(tmp_path / "index"))
    assert files.load_index(spark, str(tmp_path / "index")).count() == 0


def test_annotation_retries(spark):
    def make_fn():
        def call(path):
            raise ValueError("down") if path == "bad" else None

        return call

    got = models.annotate_images(spark.createDataFrame([("bad",)], "image_path string"), make_fn, tries=2, pause=0, sleep=lambda s: None).collect()
    assert got[0]["error"] == "down" and got[0]["reply"] is None


def test_average_linkage_of_large_components(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (30, 3)) for c in (0.0, 1.5, 9.0)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    whole = {r["id"]: r["cluster_id"] for r in clustering.average_linkage(points, 1.2, stored).collect()}
    assert 3 < len(set(whole.values())) < 90
    rounds = clustering.average_linkage(points, 1.2, stored, most=10)
    assert {r["id"]: r["cluster_id"] for r in rounds.collect()} == whole
    heads = clustering._linked_in_rounds(points, 1.2, stored, rows=20)  # several blocks
    assert {r["id"]: r["cluster_id"] for r in clustering._number(heads, stored).collect()} == whole


def test_reject_filter_works_boxes_out_once(spark):
    """Pushed below the view of boxes, the filter holds each box once, and not once for each use (F17)."""
    from noveltide.plans.views import views

    (b,) = views(spark, "/root/testdata/sf0.001", "boxes")
    kept = b.where(bx.reject_reason(F.col("box"), F.col("h"), F.col("w")).isNull())
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_suppkey") < 20
