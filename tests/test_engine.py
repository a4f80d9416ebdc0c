"""Operators on small fixtures."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import exprs as X
from gridloom.operators import audits, config_rules, heatmap, labels, pixels, scene, selection, series, splits, tables
from gridloom.plans import datasets, experiments, registry, scenes
from gridloom.session import automatic_workers
from gridloom.sources import annotations, fetch, files, sinks


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_workers():
    assert [automatic_workers(n) for n in (1, 4, 16, 128)] == [1, 2, 8, 8]


def test_scalar_functions(spark):
    row = one(spark.range(1).select(
        X.duration(F.lit(3661.5)).alias("d"), X.duration(F.lit(-5.0), clamp=True).alias("c"), X.eta(F.lit(120.0), F.lit(0.0)).alias("e"), X.eta(F.lit(None).cast("double"), F.lit(1.0)).alias("n"), X.eta(F.lit(5.0), F.lit(9.0)).alias("o"),
        X.slug(F.lit(" Ação 1_b!")).alias("s"), X.number(F.lit(None).cast("double")).alias("z"), X.hue_wrap(F.lit(250), F.lit(5)).alias("h"), X.label_directory(F.lit("/a/images/train")).alias("l"), X.stem(F.lit("/x/a.b.jpg")).alias("t"),
        X.overlay(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m"), X.f1(F.lit(0.0), F.lit(0.0)).alias("f"), X.relative_to(F.lit("/r/x/y"), "/r").alias("r"), X.sample_seed(F.lit("x")).alias("seed"),
    ))
    assert (row.d, row.c, row.e, row.n, row.o) == ("01:01:02", "00:00:00", "~00:02:00", X.NO_HISTORY, X.OVER_HISTORY)
    assert (row.s, row.z, row.h, row.l, row.t, row.m, row.f, row.r) == ("a-o-1_b", "—", -11, "/a/labels/train", "a.b", {"a": 1, "b": 3}, 0.0, "x/y")
    import hashlib

    assert int(row.seed) == int(hashlib.sha256(b"x").hexdigest()[:16], 16)


def test_label_rules(spark):
    texts = {"ok": "0 0.5 0.5 0.25 0.25\n\n0 .1 .1 .1 .1\n", "edge": "\n0 0.99 0.5 0.2 0.1", "class": "1 .5 .5 .1 .1", "fields": "0 1 2", "text": "0 a .5 .1 .1", "d": "0 1d .5 .1 .1", "range": "0 1.5 .5 .1 .1", "nan": "0 .5 .5 nan .1", "empty": "", "null": None, "tall": "0 .5 .01 .1 .1"}
    rows = spark.createDataFrame(list(texts.items()), "source string, text string")
    got = {r.source: (r.boxes, r.error_line, r.error) for r in labels.validate_label_text(rows, "source").collect()}
    assert got == {"ok": (2, None, None), "edge": (None, 2, "horizontal"), "class": (None, 1, "class"), "fields": (None, 1, "fields"), "text": (None, 1, "numeric"), "d": (None, 1, "numeric"), "range": (None, 1, "coordinates"), "nan": (None, 1, "coordinates"), "empty": (0, None, None), "null": (0, None, None), "tall": (None, 1, "vertical")}
    assert one(spark.createDataFrame([("2  .5 .5\t.1 .1\r\n\n7 1 1 1 1",)], "t string").select(labels.collapse_to_class_zero("t").alias("t"))).t == "0 .5 .5 .1 .1\n0 1 1 1 1\n"


def test_box_text(spark):
    row = one(spark.range(1).select(labels.from_pixel_box(*map(F.lit, (5, 4, 10, 8, 40, 20))).alias("a"), labels.from_corners(*map(F.lit, (10, 5, 60, 55, 100, 80)), digits=6).alias("b")))
    assert row.a == "0 0.25000000 0.40000000 0.25000000 0.40000000"
    assert row.b == "0 0.350000 0.375000 0.500000 0.625000"


def test_instance_label(spark):
    box = lambda a, b, c, d: F.struct(F.lit(a).alias("left"), F.lit(b).alias("top"), F.lit(c).alias("right"), F.lit(d).alias("bottom"))
    row = F.struct(F.lit(10).alias("x"), F.lit(20).alias("y"), box(0, 0, 1, 5).alias("visible"), box(0, 0, 10, 20).alias("rect"))
    got = one(spark.range(1).select(row.alias("i")).select(labels.instance_label("i", "rect", (100, 100), 2).alias("r"), labels.instance_label("i", "visible", (100, 100), 2).alias("v")))
    assert (got.r, got.v) == ("0 0.15000000 0.30000000 0.10000000 0.20000000", None)


def test_allocation_and_splits(spark):
    sizes = spark.createDataFrame([("iphone", 82), ("pixel", 48)], "device string, size long")
    assert {r.device: r.allocation for r in splits.largest_remainder(sizes, "device", "size", 26).collect()} == {"iphone": 16, "pixel": 10}
    rows = spark.range(130).select(F.col("id"), F.when(F.col("id") < 82, "iphone").otherwise("pixel").alias("device"))
    got = splits.stratified_split(rows, "device", "id", 26, 42).groupBy("device", "split").count().collect()
    assert {(r.device, r.split): r["count"] for r in got} == {("iphone", "val"): 16, ("iphone", "train"): 66, ("pixel", "val"): 10, ("pixel", "train"): 38}
    for n, want in ((1, 1), (2, 1), (5, 4), (355, 284)):
        assert splits.holdout_split(spark.range(n), "id", 0.8, 42, "x").where("split = 'train'").count() == want
    exact = splits.deterministic_split([f"{k}.jpg" for k in range(10)], 0.8, 42, "x")
    assert len(exact["train"]) == 8 and exact == splits.deterministic_split([f"{9 - k}.jpg" for k in range(10)], 0.8, 42, "x")
    ranked = splits.ranked_by_hash(spark.range(5000).withColumn("k", F.sha2(F.col("id").cast("string"), 256)), "k", "id").orderBy("k", "id").select("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 5001))


def test_nested_sets(spark):
    rows = spark.createDataFrame([("train", f"t{k}") for k in range(4)] + [("val", "v0")], "split string, image string")
    got = {m: {(r.split, r.image) for r in datasets.nested_training_sets(rows, 2, [1, 2]).where(f"multiplier = {m}").collect()} for m in (1, 2)}
    assert got[1] < got[2] and len(got[1]) == 3 and len(got[2]) == 5


def test_selection(spark):
    rows = [("m", "c", "a", 41, 0.4), ("m", "c", "a", 42, 0.6), ("m", "c", "b", 41, 0.5), ("m", "c", "b", 42, 0.5), ("m", "c", "d", 41, 0.9), ("m", "e", "x", 41, 0.5), ("m", "e", "x", 42, 0.5), ("m", "e", "y", 41, 0.5), ("m", "e", "y", 42, 0.5)]
    runs = spark.createDataFrame(rows, "model string, condition string, id string, seed int, metric double")
    means = selection.candidate_means(runs, ["model", "condition", "id"], "metric", "seed", [42, 41])
    best = {r.condition: r.id for r in selection.best_candidates(means, ["model", "condition"], "id").collect()}
    assert best == {"c": "b", "e": "y"}  # lower deviation; greater id


def test_summary_and_delta(spark):
    rows = spark.createDataFrame([("m", "manual-full", 0.5, None), ("m", "manual-full", 0.5, None), ("m", "synthetic-1", 0.7, 0.3), ("n", "synthetic-1", 0.7, None)], "model_name string, condition string, map50_95 double, map75 double")
    out = selection.delta_against(selection.metric_summary(rows, ["model_name", "condition"], ["map50_95", "map75"]), ["model_name"], "condition", "manual-full", "map50_95_mean")
    got = {(r.model_name, r.condition): (r.map50_95_mean, r.map50_95_std, r.map75_mean, r.map75_std, r.delta) for r in out.collect()}
    assert got[("m", "manual-full")] == (0.5, 0.0, None, None, 0.0)
    assert got[("m", "synthetic-1")] == (0.7, 0.0, 0.3, 0.0, 0.2)
    assert got[("n", "synthetic-1")][4] is None
    assert [r.model_name for r in selection.highlighted(out).collect()] == ["m"]


def test_ap_and_confidence(spark):
    ap = spark.createDataFrame([("r", [0.1 * k for k in range(10)]), ("r", [0.0] * 10), ("s", [1.0])], "run string, ap array<double>")
    got = {r.iou: r.ap for r in selection.ap_by_iou(ap, ["run"], "ap").collect()}
    assert len(got) == 10 and abs(got["0.95"] - 0.45) < 1e-9
    curve = spark.createDataFrame([("r", [0.2, 0.6, 0.6], [0.0, 0.25, 1.0]), ("r", [0.0, 0.4, 0.4], [0.0, 0.25, 1.0])], "run string, f array<double>, px array<double>")
    best = one(selection.best_confidence(curve, ["run"], "f", "px"))
    assert (best.best_f1, best.best_f1_confidence) == (0.5, 0.25)


def test_heat_against_brute_force(spark):
    rng = np.random.default_rng(3)
    grid, rows = 32, []
    for _ in range(80):
        w, h = rng.uniform(0.001, 0.5, 2)
        rows.append((float(rng.uniform(w / 2, 1 - w / 2)), float(rng.uniform(h / 2, 1 - h / 2)), float(w), float(h)))
    rows += [(0.5, 0.5, 1.0, 1.0), (0.0001, 0.0001, 0.0002, 0.0002), (1 - 1e-4, 1 - 1e-4, 2e-4, 2e-4)]
    want = np.zeros((grid, grid), int)
    for x, y, w, h in rows:
        left, top = max(0, int(np.floor((x - w / 2) * grid))), max(0, int(np.floor((y - h / 2) * grid)))
        want[top : min(grid, max(top + 1, int(np.ceil((y + h / 2) * grid)))), left : min(grid, max(left + 1, int(np.ceil((x + w / 2) * grid))))] += 1
    boxes = spark.createDataFrame([("d", *r) for r in rows], "dataset string, center_x double, center_y double, width double, height double")
    got = np.zeros((grid, grid), int)
    for r in heatmap.occupancy(boxes, ["dataset"], grid).collect():
        got[r.y, r.x] = r.boxes
    assert (got == want).all()
    picture = experiments.heat_picture(heatmap.heat(boxes, spark.createDataFrame([("d",), ("d",)], "dataset string"), ["dataset"], grid), "d", grid, 64)
    assert files.image_size(picture) == (64, 64)


def test_curves(spark):
    history = spark.createDataFrame([("m", "c", "41", e, v) for e, v in (("1", ".3"), ("2", ".4"), ("3", ".5"))] + [("m", "c", "42", e, v) for e, v in (("1", ".5"), ("2", ".6"))], "model string, condition string, seed string, epoch string, ` metrics/mAP50-95(B)` string")
    mean, drawn = experiments.curves(history, ["c"])
    assert [(r.epoch, round(r["mean"], 6), r.seeds) for r in mean.collect()] == [(1.0, 0.4, 2), (2.0, 0.5, 2), (3.0, 0.5, 1)]
    assert drawn["m"].count("<polyline") == 1
    with pytest.raises(ValueError):
        experiments.curves(history, ["c", "lost"])
    with pytest.raises(ValueError):
        series.metric_column(["epoch"])


def matrix():
    return {"protocol": {"validation": "v", "class_names": ["x"], "ultralytics_version": "1"}, "seeds": [41, 42], "defaults": {"epochs": 50, "patience": 30}, "conditions": {f"c{k}": {"train": ["t"], "manifests": ["m"]} for k in range(7)}, "models": [{"name": n, "checkpoint": f"{n}.pt", "parameters": {"batch": 8}} for n in ("a", "b", "c")]}


def test_matrix_and_selection(spark):
    table = experiments.experiment_table(spark, matrix())
    assert table.count() == 42 and table.select("candidate_id").distinct().count() == 21 and table.select("run_id").distinct().count() == 42
    results = table.select("run_id", "candidate_id", "condition", "model_name", "seed", (F.lit(0.5) + F.col("seed") / 1000).alias("map50_95"), F.lit(60.0).alias("training_seconds"))
    chosen = experiments.select_by_validation(results, table, [41, 42])
    assert chosen.count() == 21 and chosen.select(F.explode("runs")).count() == 42
    with pytest.raises(ValueError):
        experiments.select_by_validation(results.where("seed = 41 or condition <> 'c0'"), table, [41, 42])
    assert experiments.filter_runs(table, ["c1"], ["b.pt"]).count() == 2


def test_report(spark, tmp_path):
    table = experiments.experiment_table(spark, {**matrix(), "conditions": {c: {"train": ["t"], "manifests": ["m"]} for c in ("manual-full", "synthetic-1x", "synthetic-2x")}})
    gain = F.when(F.col("condition") == "synthetic-1x", 0.1).when(F.col("condition") == "synthetic-2x", -0.1).otherwise(0.0)
    results = table.select("run_id", "candidate_id", "condition", "model_name", "seed", (F.lit(0.5) + gain).alias("map50_95"), F.lit(61.0).alias("training_seconds"))
    chosen = experiments.select_by_validation(results, table, [41, 42])
    evaluated = results.select("run_id", "candidate_id", "condition", "model_name", "seed", "map50_95", *(F.lit(0.5).alias(m) for m in ("precision", "recall", "f1", "map50")), F.lit(None).cast("double").alias("map75"), *(F.lit(1.0).alias(m) for m in ("mae", "rmse", "bias")))
    summary = experiments.evaluation_summary(evaluated)
    text = experiments.markdown_report(summary, chosen, evaluated, ["manual-full", "synthetic-1x", "synthetic-2x"], {"selection": "x"}, tmp_path / "r.md")
    assert text.count("★") == 3 and "**synthetic-2x**" not in text and "00:02:02" in text
    with pytest.raises(KeyError):
        experiments.markdown_report(summary, chosen, evaluated, ["manual-full", "lost"], {}, tmp_path / "r.md")
    names = experiments.analysis_bundle({"result_summary": (summary, ["model_name", "condition"])}, {"a": {"b": [1]}}, {"x": 1}, tmp_path / "b.zip")
    with zipfile.ZipFile(tmp_path / "b.zip") as archive:
        assert sorted(archive.namelist()) == names and archive.read("analysis_csv/protocol.csv") == b"key,value\na.b,[1]\n"


def test_audits(spark):
    images = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "c")], "split string, stem string")
    texts = spark.createDataFrame([("train", "a", "0 .5 .5 .1 .1"), ("val", "c", "9"), ("val", "d", "")], "split string, stem string, text string")
    got = {r.split: (r.images, r.labels, r.boxes, r.without_label, r.without_image, r.bad_labels, r.ok) for r in datasets.audit_tree(images, texts, {"train": 2, "val": 1}).collect()}
    assert got == {"train": (2, 1, 1, 1, 0, 0, False), "val": (1, 2, 0, 0, 1, 1, False)}
    frozen = spark.createDataFrame([("a", "train"), ("a", "val"), ("z", "val")], "id string, split string")
    rules = datasets.audit_split(spark.createDataFrame([("a",), ("b",)], "id string"), frozen)
    assert {r.rule: r.actual for r in rules.collect()} == {"split missing": 1, "split overlapping": 1, "split unknown": 1}
    assert one(audits.ready(rules)).ready is False


def test_depth_pairs(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    best, lost = datasets.depth_pairs(names("a.jpg", "b.jpg", "c.jpg"), names("a_map.png", "a_depth.png", "b.png", "z.png"))
    assert {(r.image, r.depth) for r in best.collect()} == {("a.jpg", "a_depth.png"), ("b.jpg", "b.png")}
    assert {r.depth for r in lost.collect()} == {"a_map.png", "z.png"}
    frozen = datasets.asset_split(best, names(*(f"{k}.png" for k in range(5))), 0.8, 42)
    assert frozen.where("kind = 'cutout' and split = 'train'").count() == 4


def test_controlled(spark):
    photos = spark.createDataFrame([(f"p{k}", "positive") for k in range(4)] + [(f"n{k}", "negative") for k in range(6)], "id string, kind string")
    boxes = spark.createDataFrame([(f"p{k}", [10, 5, 60, 55], [100, 80]) for k in range(4)], "id string, bbox array<int>, image_size array<int>")
    rows = datasets.controlled_set(photos, boxes, 0.8, 42).collect()
    assert {r.text for r in rows if r.kind == "positive"} == {"0 0.350000 0.375000 0.500000 0.625000\n"} and sum(r.text == "" for r in rows) == 6
    with pytest.raises(annotations.Problems):
        datasets.controlled_set(photos, boxes.where("id <> 'p0'"), 0.8, 42)


def picture(width, height, make=""):
    body = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\0" * 9
    text = make.encode() + b"\0"
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 271, 2, len(text), 38) + struct.pack("<HHIHH", 274, 3, 1, 6, 0) + b"\0" * 4 + text
    exif = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return b"\xff\xd8" + exif + body + b"\xff\xd9"


def test_import_label_tree(spark, tmp_path):
    for k, make in enumerate(("Apple", "Google")):
        (tmp_path / "images").mkdir(exist_ok=True)
        (tmp_path / "labels").mkdir(exist_ok=True)
        (tmp_path / f"images/Sample-{k}.jpg").write_bytes(picture(4000 + k, 3000, make))
        (tmp_path / f"labels/sample-{k}.txt").write_text("0 0.5 0.5 0.25 0.25\n")
    (tmp_path / "labels/classes.txt").write_text("x")
    kind, records = datasets.import_records(spark, str(tmp_path), expected_images=2, expected_boxes=2)
    rows = {r.id: r for r in records.collect()}
    assert kind == "yolo" and {i: r.device for i, r in rows.items()} == {"sample-0": "iphone", "sample-1": "pixel"}
    assert rows["sample-0"].device_source == "exif" and rows["sample-0"].raw_size == [4000, 3000] and rows["sample-0"].canonical_size == [3000, 4000]
    assert one(datasets.import_summary(records)).devices == {"iphone": 1, "pixel": 1}
    (tmp_path / "devices.csv").write_text("﻿filename,device\nx/sample-0.jpg,Pixel 8\n")
    _, records = datasets.import_records(spark, str(tmp_path), metadata_path=str(tmp_path / "devices.csv"))
    assert {r.id: (r.device, r.device_source) for r in records.collect()}["sample-0"] == ("pixel", "metadata")
    with pytest.raises(annotations.Problems, match="expected 3"):
        datasets.import_records(spark, str(tmp_path), expected_images=3)
    (tmp_path / "images/copy.jpg").write_bytes(picture(4000, 3000, "Apple"))
    with pytest.raises(annotations.Problems, match="without label"):
        datasets.import_records(spark, str(tmp_path))
    (tmp_path / "labels/copy.txt").write_text("")
    with pytest.raises(annotations.Problems, match="copies"):
        datasets.import_records(spark, str(tmp_path))


def test_coco_in_nested_archive(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "d/a.png", "width": 40, "height": 20}, {"id": 2, "file_name": "b.png", "width": 4, "height": 4}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2, "bbox": [5, 4, 10, 8]}], "categories": [{"id": 2, "name": "x"}]}
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("test/a.png", sinks.png(np.zeros((20, 40, 3), np.uint8)))
        z.writestr("test/ann.json", json.dumps(coco))
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("test.zip", inner.getvalue())
        z.writestr("lights/x.txt", "x")
    members = files.read_archives(files.binary(spark, str(tmp_path / "outer.zip")), excluded_roots=("lights",))
    assert [r.member for r in members.collect()] == ["test.zip"]
    inside = {r.member: bytes(r.content) for r in files.nested_archive(members, "test.zip").collect()}
    assert files.image_size(inside["test/a.png"]) == (40, 20)
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "a.png").write_bytes(inside["test/a.png"])
    (folder / "b.png").write_bytes(sinks.png(np.ones((4, 4), np.uint8)))
    (folder / "ann.json").write_bytes(inside["test/ann.json"])
    (folder / "0.json").write_text("{}")
    kind, rows = annotations.read_annotations(spark, str(folder))
    assert kind == "coco" and {r.name: r.text for r in rows.collect()} == {"a.png": "0 0.25000000 0.40000000 0.25000000 0.40000000\n", "b.png": ""}
    done = datasets.import_external(rows, expected_images=2, expected_boxes=1)
    assert done.count() == 2
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", "x")
    with pytest.raises(Exception, match="unsafe"):
        files.read_archives(files.binary(spark, str(tmp_path / "bad.zip"))).collect()


def test_cvat(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(sinks.png(np.zeros((10, 20), np.uint8)))
    (tmp_path / "b.png").write_bytes(sinks.png(np.zeros((10, 20), np.uint8)))
    (tmp_path / "ann.xml").write_text('<annotations><image id="0" name="x/a.png" width="20" height="10"><box label="o" xtl="5" ytl="0" xbr="15" ybr="5"/><polygon label="o" points="1,1"/></image><image id="1" name="b.png" width="20" height="10"></image></annotations>')
    kind, rows = annotations.read_annotations(spark, str(tmp_path))
    assert kind == "cvat" and {r.name: r.text for r in rows.collect()} == {"a.png": "0 0.50000000 0.25000000 0.50000000 0.50000000\n", "b.png": ""}
    with pytest.raises(FileNotFoundError):
        annotations.read_annotations(spark, str(tmp_path), "coco")


def test_history_and_sinks(spark, tmp_path):
    (tmp_path / "h.csv").write_text("﻿ epoch , metrics/mAP50-95(B)\n 1 , .3 \n")
    row = one(files.training_history(spark, str(tmp_path / "h.csv")))
    assert row.asDict() == {"epoch": "1", "metrics/mAP50-95(B)": ".3"}
    sinks.write_json(tmp_path / "x.json", {"b": 1, "a": "é"})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    assert tables.flatten_dict({"a": {"b": 1, "c": [1, "é"]}, "d": None}) == {"a.b": 1, "a.c": '[1, "é"]', "d": None}
    with pytest.raises(FileExistsError):
        sinks.refuse_filled(tmp_path, False)
    assert files.list_images(spark, str(tmp_path / "nowhere")).count() == 0


def test_fetch(tmp_path):
    import hashlib

    class Answer(io.BytesIO):
        headers, status = {"Content-Type": "application/zip"}, 206

    data = b"0123456789"
    source = fetch.Source("s", "http://x", "a.bin", 10, hashlib.sha256(data).hexdigest())
    (tmp_path / "a.bin.part").write_bytes(data[:4])
    seen = []
    done = fetch.fetch(source, tmp_path, opener=lambda r: seen.append(r.headers) or Answer(data[4:]))
    assert done.read_bytes() == data and seen == [{"Range": "bytes=4-"}]
    assert fetch.fetch(source, tmp_path, opener=None) == done  # reused without network
    with pytest.raises(ValueError):
        fetch.fetch(source, tmp_path, force=True, opener=lambda r: Answer(b"x" * 10))


def test_config_rules():
    config_rules.validate(scenes.SMALL)
    for key, value in (("canvas", [0, 5]), ("placement.min_visibility", 2), ("placement.z_method", "x"), ("objects.min", 9), ("occlusion.cast_shadow.shapes", []), ("appearance.light_power", 1), ("occlusion.mask_threshold", 1.0), ("annotation.mode", "x")):
        changed = json.loads(json.dumps(scenes.SMALL))
        at = changed
        *path, last = key.split(".")
        for part in path:
            at = at[part]
        at[last] = value
        with pytest.raises(ValueError):
            config_rules.validate(changed)
    assert config_rules.violations({}) == [("", "required keys are missing")]


def test_kernels():
    assert pixels.bounds(np.zeros((3, 3))) is None and pixels.trim(np.zeros((4, 4, 4), np.uint8)).shape == (1, 1, 4)
    flat = np.full((9, 9, 4), 200, np.uint8)
    assert (pixels.resize(flat, 5, 7) == 200).all() and (pixels.blur(flat, 1.5) == 200).all()
    colours = np.random.default_rng(0).integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert np.abs(pixels.rgb(pixels.hsv(colours)).astype(int) - colours).max() <= 6
    fruit = np.dstack([np.full((8, 8, 3), (200, 120, 40), np.uint8), np.full((8, 8), 255, np.uint8)])
    cast = {"enabled": True, "hue_power": 0.1, "saturation_power": 0.1, "value_power": 0.4}
    value = lambda region, **more: scene.appearance(fruit, np.full((8, 8, 3), region, np.uint8), {"hsv_cast": {**cast, **more}}, None)[..., :3].max(-1).astype(float)
    assert value(250, bright_flatten_strength=1.0).mean() > value(250).mean()
    assert (value(5, value_power=1.0, min_value_ratio=0.6) >= 0.6 * 200 - 1).all()
    depth = np.full((9, 9), 30, np.uint8)
    depth[:, 5:] = 180
    depth[4, 4] = 100
    z, _ = scene.z_value(depth, np.ones((9, 9), bool), {"z_method": "center_patch", "z_patch_fraction": 0.1}, (4, 4), None)
    assert z == 100.0
    assert pixels.depth_bytes(np.array([[np.nan, 1.0], [2.0, 3.0]])).tolist()[0][0] == 0


def test_scenes_do_not_depend_on_partitions(spark):
    assets = scenes.drawn_assets()
    first = {r.id: r for r in scenes.generate(spark, scenes.SMALL, assets, "f").collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    second = {r.id: r for r in scenes.generate(spark, scenes.SMALL, assets, "f").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == second and len(first) == 6
    assert all(r.annotations == len(r.label_text.splitlines()) for r in first.values()) and sum(r.annotations for r in first.values()) > 0
    checked = labels.validate_label_text(spark.createDataFrame([(r.id, r.label_text) for r in first.values()], "id string, text string"), "id")
    assert checked.where("error is not null").count() == 0
    direct = scene.render(int(first["train_000000"].seed), assets["train"]["backgrounds"], assets["train"]["cutouts"], scenes.SMALL)
    assert direct["label"] == first["train_000000"].label_text


def test_stream_state(spark, tmp_path):
    from gridloom.streaming import progress

    spark.createDataFrame([("a", 30.0, True), ("b", 5.0, False)], "title string, seconds double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema("title string, seconds double, ok boolean").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = progress.stage_progress(stream).writeStream.outputMode("update").format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([("a", 90.0, True)], "title string, seconds double, ok boolean").write.parquet(str(tmp_path / "in/2"))
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.table("stages").collect()
    assert {(r.title, r.estimate, r.runs, r.failures) for r in rows} == {("a", 30.0, 1, 0), ("b", None, 0, 1), ("a", 90.0, 2, 0)}
    assert progress.up_to_date("x", "x", True) and not progress.up_to_date("x", "y", True)


def test_scene_query(spark):
    rows = registry.QUERIES["q_scene_manifest"](spark, "/root/testdata/sf0.001")
    assert rows.count() == 30


def test_tree_with_empty_labels(spark, tmp_path):
    for split, name, text in (("train", "a", "0 .5 .5 .1 .1"), ("val", "b", "")):
        for kind, ending, content in (("images", "png", sinks.png(np.zeros((2, 2), np.uint8))), ("labels", "txt", text.encode())):
            (tmp_path / kind / split).mkdir(parents=True, exist_ok=True)
            (tmp_path / kind / split / f"{name}.{ending}").write_bytes(content)
    images, texts = datasets.tree(spark, str(tmp_path))
    assert {(r.split, r.boxes, r.ok) for r in datasets.audit_tree(images, texts).collect()} == {("train", 1, True), ("val", 0, True)}
    assert [r.image for r in datasets.annotations(texts, "d").collect()] == ["a"]
