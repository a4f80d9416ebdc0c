"""Preparing scene assets: upright RGB backgrounds, then masks and depth maps that models outside the engine made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.exprs import base_name, stem
from gridloom.operators import pixels as P
from gridloom.sources.files import binary, rasters, with_camera
from gridloom.sources.sinks import png

#: Stages in order, each with the table that it needs.
STAGES = ("backgrounds", "masks", "depths")


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as the camera saw them, by the EXIF orientation (1 to 8; others are left alone)."""
    if orientation in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return np.ascontiguousarray(image)


def normalise_backgrounds(spark: SparkSession, folder: str) -> DataFrame:
    """Every picture of a folder, turned upright and without alpha: (name, width, height, content), content as PNG.

    Pictures that cannot be decoded are left out; ``preprocess_assets`` counts them.
    """
    turned = with_camera(binary(spark, folder)).select(F.col("path").alias("origin"), "exif.orientation")
    decoded = rasters(spark, folder).select("origin", "height", "width", "nChannels", "data")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                image = np.repeat(image, 3, 2) if r.nChannels == 1 else image[..., 2::-1]  # stored as BGR
                image = upright(image, int(r.orientation or 1))
                rows.append((r.name, image.shape[1], image.shape[0], png(image)))
            yield pd.DataFrame(rows, columns=["name", "width", "height", "content"])

    clean = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = decoded.withColumn("origin", clean("origin")).join(turned.withColumn("origin", clean("origin")), "origin")
    return both.withColumn("name", base_name("origin")).mapInPandas(draw, "name string, width int, height int, content binary")


def depth_maps(predictions: DataFrame, is_distance: bool = True) -> DataFrame:
    """PNG maps (name, width, height, content) from a model's raw depths (name, width, height, values: rows of floats)."""

    @F.pandas_udf("binary")
    def scale(width: pd.Series, height: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([png(P.depth_bytes(np.asarray(v, np.float64).reshape(h, w), is_distance=is_distance)) for w, h, v in zip(width, height, values, strict=True)])

    return predictions.select("name", "width", "height", scale("width", "height", "values").alias("content"))


def preprocess_assets(backgrounds: DataFrame, masks: DataFrame | None = None, depths: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The manifest of a preparation: (stage, inputs, outputs, missing, complete) for each stage, in order.

    ``backgrounds`` and ``depths`` hold name, and ``masks`` name (of cut-outs); ``sources`` (default: the backgrounds) are
    the names that went in. A depth map belongs to the background of its stem. A stage without a table is skipped, and
    so not complete; nothing raises.
    """
    spark = backgrounds.sparkSession
    keys = lambda frame: frame.select(stem("name").alias("k")).where("k is not null").distinct()
    grounds = keys(backgrounds)
    given = {"backgrounds": (keys(sources) if sources is not None else grounds, grounds), "masks": (keys(masks), keys(masks)) if masks is not None else None, "depths": (grounds, keys(depths)) if depths is not None else None}
    rows = []
    for number, stage in enumerate(STAGES):
        if given[stage] is None:
            rows.append(spark.range(1).select(F.lit(number).alias("n"), F.lit(stage).alias("stage"), F.lit(0).cast("long").alias("inputs"), F.lit(0).cast("long").alias("outputs"), F.lit(0).cast("long").alias("missing"), F.lit(False).alias("complete")))
            continue
        inputs, outputs = given[stage]
        both = inputs.withColumn("i", F.lit(1)).join(outputs.withColumn("o", F.lit(1)), "k", "full_outer")
        counted = both.agg(F.count("i").alias("inputs"), F.count_if(F.col("i").isNotNull() & F.col("o").isNotNull()).alias("outputs"))
        rows.append(counted.select(F.lit(number).alias("n"), F.lit(stage).alias("stage"), "inputs", "outputs", (F.col("inputs") - F.col("outputs")).alias("missing"), ((F.col("inputs") > 0) & (F.col("inputs") == F.col("outputs"))).alias("complete")))
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.orderBy("n").drop("n")
