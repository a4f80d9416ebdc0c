"""Operators that work in pieces give what they give at once."""

import csv
import hashlib
import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from gridloom.operators import series, tables
from gridloom.plans import experiments
from gridloom.sources import files


def test_estimates_by_cuts(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), at, float(draw.randint(1, 120)) if draw.random() > 0.1 else None, draw.random() > 0.4) for at in range(400)]
    frame = spark.createDataFrame(rows, "user string, at long, seconds double, ok boolean")
    whole = series.estimates(frame, ["user"], ["at"], "seconds", "ok")
    cut = series.estimates(frame, ["user"], ["at"], "seconds", "ok", F.floor(F.col("at") / 7))
    assert whole.columns == cut.columns
    assert sorted(whole.collect(), key=lambda r: r.at) == sorted(cut.collect(), key=lambda r: r.at)
    held = {}  # the rule, one run after the other
    for user, at, seconds, ok in rows:
        got = whole.columns and held.get(user, (False, None))
        rows[at] = (at, got[1])
        if ok:
            long = seconds is not None and seconds >= series.LEAST_SECONDS
            first = not got[0]
            held[user] = (True, seconds if (long or first) and seconds is not None else got[1])
    assert {r.at: r.estimate for r in cut.collect()} == dict(rows)


def test_ordered_hash_streams(spark):
    rows = [(k % 3 if k % 7 else None, k // 2, f'n"{k}') for k in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = tables.ordered_hash(spark.createDataFrame(rows, "g int, k long, name string").repartition(5), ["g"], ["k"], ["k", "name"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for g, k, name in rows:
        groups.setdefault(g, []).append((k, json.dumps([str(k), name], separators=(",", ":"))))
    assert {r.g: (r.sha256, r.records) for r in got} == {g: (hashlib.sha256(f"[{','.join(line for _, line in sorted(v))}]".encode()).hexdigest(), len(v)) for g, v in groups.items()}
    assert tables.ordered_hash(spark.createDataFrame([], "g int, k long, name string"), ["g"], ["k"], ["name"]).collect() == []


def test_archives_are_dealt_by_member(spark, tmp_path):
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"some {n}%.zip", "w") as out:
            for k in range(40):
                out.writestr(f"in/{k}.txt", str(k) * k)
            out.writestr("skip/x.txt", "x")
    zipfile.ZipFile(tmp_path / "empty.zip", "w").close()
    scan = files.binary(spark, str(tmp_path))
    members = files.read_archives(scan, ("skip",))
    rows = members.collect()
    assert sorted((r.archive.rpartition("/")[2], r.member, r.size, bytes(r.content).decode()) for r in rows) == sorted((f"some {n}%.zip", f"in/{k}.txt", len(str(k) * k), str(k) * k) for n in range(2) for k in range(40))
    assert members.select(F.spark_partition_id()).distinct().count() > 1


def test_bundle_of_many_rows(spark, tmp_path):
    frame = spark.range(3000).select("id", F.struct((F.col("id") * 2).alias("v")).alias("s"))
    experiments.analysis_bundle({"rows": (frame, ["id"]), "none": (frame.where("id < 0"), ["lost", "id"])}, {}, {}, tmp_path / "b.zip")
    with zipfile.ZipFile(tmp_path / "b.zip") as archive:
        found = list(csv.DictReader(io.StringIO(archive.read("analysis_csv/rows.csv").decode())))
        assert archive.read("analysis_csv/none.csv") == b"id,s.v\n"
    assert [(int(r["id"]), int(r["s.v"])) for r in found] == [(k, 2 * k) for k in range(3000)]
