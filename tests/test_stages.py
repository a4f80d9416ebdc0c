"""Stage registry, downloads, assets and the rules that repeated or odd rows must not break."""

import hashlib
import io
import json
import subprocess
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import exprs
from gridloom.operators import audits, labels, series, splits
from gridloom.plans import assets, experiments
from gridloom.sources import fetch, sinks
from gridloom.streaming import stages


def test_run_stage_beats_and_records(tmp_path):
    said, path = [], tmp_path / "state.json"
    stages.run_stage("S", [sys.executable, "-c", "import time; time.sleep(0.3)"], tmp_path, path, 0.05, said.append)
    state = json.loads(path.read_text())
    assert said[0].startswith("[início] S") and exprs.NO_HISTORY in said[0] and said[-1].startswith("[concluída] S")
    assert any(x.startswith("[em andamento] S") and "ETA aproximado" in x for x in said)
    assert "current" not in state and state["stages"]["S"]["last_duration_seconds"] > 0
    with pytest.raises(subprocess.CalledProcessError):
        stages.run_stage("S", [sys.executable, "-c", "raise SystemExit(3)"], tmp_path, path, 1, said.append)
    after = json.loads(path.read_text())["stages"]["S"]
    assert after["failures"] == 1 and after["last_failure"]["exit_code"] == 3 and after["estimated_duration_seconds"] == state["stages"]["S"]["estimated_duration_seconds"]


def test_run_stage_knows_earlier_runs(tmp_path):
    said, path = [], tmp_path / "state.json"
    path.write_text(json.dumps({"stages": {"known": {"estimated_duration_seconds": 120.0}}}))
    stages.run_stage("known", [sys.executable, "-c", "pass"], tmp_path, path, 1, said.append)
    assert "ETA aproximado: ~00:02:00" in said[0]
    assert json.loads(path.read_text())["stages"]["known"]["estimated_duration_seconds"] == 120.0  # too short a run to replace it
    path.write_text("no json")
    assert stages.load_state(path) == {"stages": {}}


class Answer(io.BytesIO):
    def __init__(self, data, kind="application/zip", status=200):
        super().__init__(data)
        self.headers, self.status = {"Content-Type": kind}, status


def test_obtain_confirms_unpacks_and_verifies(tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        out.writestr("images/a.jpg", b"x")
        out.writestr("images/b.png", b"y")
    page = b'<form action="http://h/get?id=1&amp;k=2"><input name="confirm" value="t"></form>'
    asked = []

    def opener(request):
        asked.append(request.full_url)
        return Answer(page, "text/html") if len(asked) == 1 else Answer(data.getvalue())

    source = fetch.Source("s", "http://h/ask", "a.zip", len(data.getvalue()), hashlib.sha256(data.getvalue()).hexdigest(), confirm=True)
    done = fetch.obtain(source, tmp_path / "archives", tmp_path / "out", {"images": 2}, ["images"], opener=opener)
    assert asked == ["http://h/ask", "http://h/get?id=1&k=2&confirm=t"] and (done / "images/a.jpg").read_bytes() == b"x"
    assert fetch.obtain(source, tmp_path / "archives", tmp_path / "out", {"images": 2}, opener=None) == done
    with pytest.raises(ValueError, match="not whole"):
        fetch.verify_extracted(done, {"images": 3}, ["labels"])
    with pytest.raises(ValueError, match="page"):
        fetch.fetch(fetch.Source("s", "http://h", "b.zip"), tmp_path, opener=lambda r: Answer(page, "text/html"))
    known = {"a": source, "b": source}
    assert fetch.selected_sources(known, {"raw": ["b", "a"]}, "raw") == [source, source] and fetch.target_for(source, {"s": tmp_path}) == tmp_path
    with pytest.raises(ValueError):
        fetch.selected_sources(known, {"raw": ["a"]}, "all")


def test_upright_turns_all_orientations():
    image = np.arange(6, dtype=np.uint8).reshape(2, 3)
    want = {1: image, 2: image[:, ::-1], 3: np.rot90(image, 2), 4: image[::-1], 5: image.T, 6: np.rot90(image, -1), 7: np.rot90(image, 2).T, 8: np.rot90(image)}
    assert all(np.array_equal(assets.upright(image, k), w) for k, w in want.items())


def test_backgrounds_and_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pixels = np.random.default_rng(0).integers(0, 255, (4, 6, 4), dtype=np.uint8)
    (tmp_path / "in/one.png").write_bytes(sinks.png(pixels[..., :3]))
    (tmp_path / "in/two.png").write_bytes(sinks.png(pixels[..., 0]))
    found = assets.normalise_backgrounds(spark, str(tmp_path / "in"))
    rows = {r.name: r for r in found.collect()}
    assert rows["one.png"].content == sinks.png(pixels[..., :3]) and (rows["two.png"].width, rows["two.png"].height) == (6, 4)
    depths = assets.depth_maps(spark.createDataFrame([("one.png", 2, 1, [1.0, 9.0])], "name string, width int, height int, values array<double>"))
    manifest = assets.preprocess_assets(found.select("name"), None, depths.select("name")).collect()
    assert [(r.stage, r.inputs, r.outputs, r.missing, r.complete) for r in manifest] == [("backgrounds", 2, 2, 0, True), ("masks", 0, 0, 0, False), ("depths", 2, 1, 1, False)]


def test_repeated_rows_and_refusals(spark):
    rows = spark.createDataFrame([("a", "0 .5 .5 .1 .1"), ("a", "0 .5 .5 .1 .1"), ("b", None), ("c", "\n0 .5 .5 .1 .1\n\n1 .5 .5 .1 .1\nx")], "id string, text string")
    got = sorted((r.id, r.boxes, r.error_line, r.error) for r in labels.validate_label_text(rows, "id").collect())
    assert got == [("a", 1, None, None), ("a", 1, None, None), ("b", 0, None, None), ("c", None, 4, "class")]
    assert "Exchange" not in labels.validate_label_text(rows, "id")._jdf.queryExecution().executedPlan().toString()
    sizes = spark.createDataFrame([("x", 3), ("y", 2)], "g string, n long")
    with pytest.raises(Exception, match="cannot allocate 10 out of 5"):
        splits.largest_remainder(sizes, "g", "n", 10).collect()
    assert {r.g: r.allocation for r in splits.largest_remainder(sizes, "g", "n", 5).collect()} == {"x": 3, "y": 2}
    pairs = audits.pair_parity(spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (3,), (None,)], "k long"), "k").first()
    assert (pairs.both, pairs.left_only, pairs.right_only) == (1, 2, 2)
    page = spark.createDataFrame([('<input name="a" value="1"><input name="b" value="2"><input name="a" value="3">',)], "p string")
    assert page.select(exprs.form_fields("p").alias("m")).first().m == {"a": "3", "b": "2"}


def test_prioritised_match_with_several_keys_a_row(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z")], "id long, k string")
    found = audits.prioritised_match(rows, spark.createDataFrame([("a", 2, "x"), ("a", 3, "w"), ("b", 1, "y")], "k string, p int, v string"), ["k"], ["id"], "p")
    assert sorted((r.id, r.p, r.v) for r in found.collect()) == [(1, 1, "y"), (2, 2, "x")]


def test_running_seconds_by_cuts(spark):
    rows = spark.createDataFrame([(k % 3 or None, k // 7, k, float(k)) for k in range(60)], "u int, d int, t int, s double")
    one = series.running_seconds(rows, ["u"], ["t"], "s")
    two = series.running_seconds(rows, ["u"], ["t"], "s", F.col("d"))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.select(*one.columns).collect()))


def test_count_pairs_refuse_a_missing_label(spark, tmp_path):
    guesses = spark.createDataFrame([("a", 2), ("b", 1)], "id string, predicted int")
    texts = spark.createDataFrame([("a", "0 .1 .1 .1 .1\n \n0 .2 .2 .1 .1"), ("b", ""), ("c", "0")], "id string, text string")
    assert sorted(map(tuple, experiments.count_pairs(guesses, texts).collect())) == [("a", 2, 2), ("b", 0, 1)]
    with pytest.raises(Exception, match="no label for b"):
        experiments.count_pairs(guesses, texts.where("id = 'a'")).collect()
    summary = spark.createDataFrame([("m", "c", 0.5, 0.1, 0.0, 3)], "model_name string, condition string, map50_95_mean double, map50_95_std double, delta_vs_manual_full double, runs long")
    paths = experiments.write_comparisons(summary, tmp_path)
    assert [p.name for p in paths] == ["test_comparison_all.csv", "test_comparison_m.csv"] and "map50_95_mean" in paths[1].read_text()


def test_locality_order_keeps_assets_together(spark):
    rows = spark.createDataFrame([(k, f"bg{k % 3}") for k in range(60)], "i int, asset string")
    parts = splits.locality_order(rows, "asset", ["i"]).withColumn("p", F.spark_partition_id()).collect()
    for p in {r.p for r in parts}:
        mine = [r.asset for r in parts if r.p == p]
        assert mine == sorted(mine)
    assert sorted(r.i for r in parts) == list(range(60))
