"""Selection by validation metrics, summaries over seeds and deltas against a baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_std(value: str | Column, digits: int = 6) -> tuple[Column, Column]:
    """Rounded mean and sample deviation; the deviation of one value is zero."""
    v = F.col(value) if isinstance(value, str) else value
    return F.bround(F.avg(v), digits), F.bround(F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))), digits)


def candidate_means(runs: DataFrame, keys: list[str], metric: str, seed: str = "seed", expected_seeds: list[int] | None = None) -> DataFrame:
    """Mean and deviation of each candidate over its seeds; with ``expected_seeds``, only candidates with exactly those."""
    mean, std = mean_std(metric)
    out = runs.groupBy(*keys).agg(mean.alias("mean"), std.alias("std"), F.count("*").alias("runs"), F.array_sort(F.collect_set(seed)).alias("seeds"))
    if expected_seeds is not None:
        out = out.where(F.col("seeds") == F.array(*(F.lit(s) for s in sorted(expected_seeds))).cast(out.schema["seeds"].dataType))
    return out.drop("seeds")


def best_candidates(candidates: DataFrame, group: list[str], identity: str) -> DataFrame:
    """One candidate a group: the highest mean, then the lowest deviation, then the greatest id.

    A max over a struct, so there is a map-side combine and no window.
    """
    rest = [c for c in candidates.columns if c not in group]
    key = F.struct(F.col("mean"), (-F.col("std")).alias("_std"), F.col(identity))
    best = candidates.groupBy(*group).agg(F.max_by(F.struct(*rest), key).alias("_best"))
    return best.select(*group, "_best.*")


def metric_summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``{metric}_mean`` and ``{metric}_std`` of every metric, nulls skipped (null if all are), and the number of runs."""
    aggregates = [c.alias(f"{m}_{kind}") for m in metrics for c, kind in zip(mean_std(m), ("mean", "std"), strict=True)]
    return rows.groupBy(*keys).agg(*aggregates, F.count("*").alias("runs"))


def delta_against(summary: DataFrame, group: list[str], condition: str, baseline: str, metric: str, name: str = "delta") -> DataFrame:
    """Difference of already rounded means to the group's ``baseline`` condition, rounded again; null without a baseline."""
    base = F.max(F.when(F.col(condition) == baseline, F.col(metric))).over(Window.partitionBy(*group))
    return summary.withColumn(name, F.bround(F.col(metric) - base, 6))


def counting_errors(rows: DataFrame, keys: list[str], target: str, predicted: str) -> DataFrame:
    """Mean absolute error, root mean square error and bias of counts."""
    error = (F.col(predicted) - F.col(target)).cast("double")
    return rows.groupBy(*keys).agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"), F.count("*").alias("images"))


def ap_by_iou(classes: DataFrame, keys: list[str], ap: str) -> DataFrame:
    """Mean over classes of ten average precisions, by IoU threshold .50 to .95; other shapes give no rows."""
    spread = classes.where(F.size(ap) == 10).select(*keys, F.posexplode(ap).alias("k", "ap"))
    return spread.groupBy(*keys, F.format_string("%.2f", 0.5 + F.col("k") * 0.05).alias("iou")).agg(F.avg("ap").alias("ap"))


def best_confidence(curves: DataFrame, keys: list[str], curve: str, confidences: str) -> DataFrame:
    """First maximum of the class-mean F1 curve and the confidence at its place; curves of another length than
    ``confidences`` give no row."""
    spread = curves.where((F.size(curve) == F.size(confidences)) & (F.size(curve) > 0)).select(*keys, F.posexplode(F.arrays_zip(F.col(curve).alias("f1"), F.col(confidences).alias("px"))).alias("k", "v"))
    mean = spread.groupBy(*keys, "k").agg(F.avg("v.f1").alias("f1"), F.first("v.px").alias("px"))
    best = mean.groupBy(*keys).agg(F.min_by(F.struct("f1", "px"), F.struct((-F.col("f1")).alias("f"), F.col("k"))).alias("b"))
    return best.select(*keys, F.bround("b.f1", 6).alias("best_f1"), F.bround("b.px", 6).alias("best_f1_confidence"))


def expand_grid(parts: list[DataFrame]) -> DataFrame:
    """Every combination of a few small configuration tables (conditions, models, seeds)."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def highlighted(summary: DataFrame, condition: str = "condition", delta: str = "delta") -> DataFrame:
    return summary.where(F.col(condition).startswith("synthetic-") & (F.col(delta) > 0))
