"""Spatial occupancy of boxes by two-dimensional prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRID = 256


def corner_changes(boxes: DataFrame, keys: list[str], grid: int = GRID) -> DataFrame:
    """Four signed corners of every box in grid cells, summed: (keys, y, x, change). A box covers one cell at least."""
    cx, cy, w, h = (F.col(c) for c in ("center_x", "center_y", "width", "height"))
    left, top = (F.greatest(F.lit(0), F.floor((c - s / 2) * grid)).cast("int") for c, s in ((cx, w), (cy, h)))
    cells = boxes.withColumns({"_l": left, "_t": top, "_rr": F.ceil((cx + w / 2) * grid).cast("int"), "_bb": F.ceil((cy + h / 2) * grid).cast("int")})
    cells = cells.withColumns({"_r": F.least(F.lit(grid), F.greatest(F.col("_l") + 1, F.col("_rr"))), "_b": F.least(F.lit(grid), F.greatest(F.col("_t") + 1, F.col("_bb")))})
    corners = cells.selectExpr(*keys, "stack(4, _t, _l, 1, _t, _r, -1, _b, _l, -1, _b, _r, 1) as (y, x, change)")
    return corners.groupBy(*keys, "y", "x").agg(F.sum("change").alias("change"))


def occupancy(boxes: DataFrame, keys: list[str], grid: int = GRID) -> DataFrame:
    """Boxes over each cell of a dense grid: (keys, y, x, boxes). The grid bounds what a window sees: a column of cells."""
    changes = corner_changes(boxes, keys, grid)
    spark = boxes.sparkSession
    cells = spark.range(grid * grid).select((F.col("id") / grid).cast("int").alias("y"), (F.col("id") % grid).cast("int").alias("x"))
    dense = boxes.select(*keys).distinct().crossJoin(F.broadcast(cells)) if keys else cells
    dense = dense.join(changes, [*keys, "y", "x"], "left").withColumn("change", F.coalesce("change", F.lit(0)))
    down = F.sum("change").over(Window.partitionBy(*keys, "x").orderBy("y"))
    across = F.sum("down").over(Window.partitionBy(*keys, "y").orderBy("x"))
    return dense.withColumn("down", down).withColumn("boxes", across).select(*keys, "y", "x", "boxes")


def heat(boxes: DataFrame, files: DataFrame, keys: list[str], grid: int = GRID) -> DataFrame:
    """Occupancy per label file (empty files count) and its share of the maximum over all keys."""
    counts = files.groupBy(*keys).agg(F.count("*").alias("files"))
    cells = occupancy(boxes, keys, grid).join(counts, keys)
    cells = cells.withColumn("value", F.col("boxes") / F.col("files"))
    peak = cells.agg(F.max("value").alias("peak"))
    share = F.when(F.col("peak") > 0, F.least(F.greatest(F.col("value") / F.col("peak"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return cells.crossJoin(F.broadcast(peak)).select(*keys, "y", "x", "boxes", "value", share.alias("share"))  # one row
