"""Synthetic scenes on Spark: one row a scene, assets broadcast, pixels in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import sample_seed
from gridloom.operators import scene
from gridloom.operators.config_rules import validate
from gridloom.plans.experiments import stable_hash
from gridloom.sources.sinks import png

RECORD = "id string, split string, seed decimal(20,0), background string, depth string, requested_objects int, inserted_objects int, annotations int, cutouts array<string>, rejected map<string,int>, label_text string, image binary"
#: Decoded assets that may be broadcast; a larger pool has to be cut into several runs, each over a part of it.
ASSET_BYTES = 1 << 30


def tasks(spark: SparkSession, config: dict, fingerprint: str) -> DataFrame:
    """(split, index, seed): the seed is an unsigned 64-bit number from the configuration, the assets and the place."""
    images = config["images"]
    rows = spark.range(int(images["train"])).select(F.lit("train").alias("split"), F.col("id").alias("index")).unionByName(spark.range(int(images["val"])).select(F.lit("val").alias("split"), F.col("id").alias("index")))
    head = json.dumps([int(config["seed"]), stable_hash(config, 24), fingerprint], ensure_ascii=False, separators=(",", ":"))[:-1]
    return rows.withColumn("seed", sample_seed(F.concat(F.lit(head + ',"'), "split", F.lit('",'), F.col("index").cast("string"), F.lit("]"))))


def generate(spark: SparkSession, config: dict, assets: dict[str, dict[str, list]], fingerprint: str, debug: bool = False) -> DataFrame:
    """Scene records with label text and PNG; ``assets[split]`` holds ``backgrounds`` and ``cutouts`` as ``scene.render`` takes them.

    The same configuration and assets give the same rows however they are partitioned, with or without debug panels.
    """
    validate(config)
    size = sum(a.nbytes for part in assets.values() for items in part.values() for item in items for a in item if isinstance(a, np.ndarray))
    if size > ASSET_BYTES:
        raise ValueError(f"{size} bytes of assets are more than one run may broadcast ({ASSET_BYTES})")
    shared = spark.sparkContext.broadcast((config, assets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        config, assets = shared.value
        for batch in batches:
            for split, index, seed in batch.itertuples(index=False):
                made = scene.render(int(seed), assets[split]["backgrounds"], assets[split]["cutouts"], config)
                picture = scene.debug_panel(made) if debug else made["picture"]
                row = (f"{split}_{index:06d}", split, seed, made["background"], made["depth"], made["requested_objects"], made["inserted_objects"], made["annotations"], made["cutouts"], made["rejected"], made["label"], png(picture))
                yield pd.DataFrame([row], columns=[c.split()[0] for c in RECORD.split(", ")])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tasks(spark, config, fingerprint).repartition(parts, "split", "index").mapInPandas(run, RECORD)


def summary(records: DataFrame) -> DataFrame:
    """Per split: images, boxes, negatives, and what was rejected and why."""
    reasons = records.select("split", F.explode("rejected").alias("reason", "n")).groupBy("split", "reason").agg(F.sum("n").alias("n"))
    reasons = reasons.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejected"))  # three reasons
    counts = records.groupBy("split").agg(F.count("*").alias("images"), F.sum("annotations").alias("boxes"), F.count_if(F.col("annotations") == 0).alias("negatives"))
    return counts.join(reasons, "split", "left")


def manifest(records: DataFrame) -> DataFrame:
    return records.drop("image", "label_text").orderBy("split", "id")


def drawn_assets(seed: int = 0, backgrounds: int = 3, cutouts: int = 3, size: int = 64) -> dict[str, dict[str, list]]:
    """Small invented assets: gradient backgrounds with a depth step, and round cutouts."""
    rng = np.random.default_rng(seed)
    out: dict[str, dict[str, list]] = {}
    ys, xs = np.mgrid[0:size, 0:size]
    disc = (np.hypot(xs - size / 2, ys - size / 2) < size / 3).astype(np.uint8) * 255
    for split in ("train", "val"):
        grounds = [(f"{split}-{k}.jpg", np.clip(xs[..., None] + rng.integers(0, 120, 3), 0, 255).astype(np.uint8), f"{split}-{k}_depth.png", np.where(xs < size * 0.6, 60, 180).astype(np.uint8)) for k in range(backgrounds)]
        cut = [(f"{split}-cut-{k}.png", np.dstack([np.full((size, size, 3), rng.integers(60, 250, 3), np.uint8), disc])) for k in range(cutouts)]
        out[split] = {"backgrounds": grounds, "cutouts": cut}
    return out


#: A small configuration in the shape of the large ones.
SMALL = {
    "name": "small", "seed": 42, "images": {"train": 4, "val": 2}, "canvas": [64, 64],
    "objects": {"min": 1, "max": 3, "min_scale": 0.2, "max_scale": 0.35, "scale_mode": "canvas", "rotation_degrees": 30},
    "placement": {"min_depth": 10, "min_visibility": 0.2, "max_attempts_per_object": 20, "z_method": "center_patch", "z_offset": 5, "z_offset_jitter": 10, "exclude_bottom_fraction": 0.1},
    "appearance": {"hardlight_power": 0.5, "hsv_cast": {"enabled": True, "hue_power": 0.1, "saturation_power": 0.2, "value_power": 0.4, "value_power_jitter": 0.1, "min_value_ratio": 0.6, "bright_flatten_strength": 0.5, "use_hardlight_target": True}},
    "occlusion": {"edge_blur": 1.0, "mask_threshold": 0.5, "edge_feather_radius": 0.6, "depth_smooth_radius": 0.8, "contact_shadow": {"enabled": True, "strength": 0.4}, "cast_shadow": {"enabled": True, "probability": 0.8}},
    "annotation": {"mode": "visible", "min_box_pixels": 2}, "output": {"jpeg_quality": 95, "scene_grading": {"enabled": True, "contrast": 1.2, "brightness": 0.9, "sharpen_percent": 25}},
}


def q_scene_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene set with as many training images as there are nations, on invented assets."""
    count = spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    config = {**SMALL, "images": {"train": count, "val": 5}}
    return manifest(generate(spark, config, drawn_assets(), "invented")).select("id", "split", "seed", "background", "depth", "requested_objects", "inserted_objects", "annotations", F.array_join("cutouts", ",").alias("cutouts"))


QUERIES = {"q_scene_manifest": q_scene_manifest}
ORACLE_SQL: dict[str, str] = {}
