"""Experiment matrices, selection, evaluation and reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import heatmap, selection, series, tables
from gridloom.operators.labels import LINE_BREAK
from gridloom.sources.sinks import bundle, csv_lines, csv_text, curve_svg, png, write_text

METRICS = ("precision", "recall", "f1", "map50", "map75", "map50_95")
COUNTING = ("mae", "rmse", "bias")
BASELINE = "manual-full"
#: What a run leaves behind, kept with a selected run where results have it.
RUN_FILES = ("checkpoint", "checkpoint_sha256")


def stable_hash(value: object, length: int = 12) -> str:
    """First digits of the SHA-256 of canonical JSON: sorted keys, no blanks, text unescaped."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:length]


def experiment_rows(config: dict, fingerprints: dict[str, str] | None = None, root: str = "") -> list[dict]:
    """Every condition, model and seed, with the ids that name them; a matrix of dozens of rows, made on the driver."""
    protocol, out = config["protocol"], []
    place = lambda p: f"{root}/{p}" if root and not p.startswith("/") else p
    for condition, own in sorted(config["conditions"].items()):
        manifests = [(p, (fingerprints or {}).get(p, "MISSING")) for p in own["manifests"]]
        for model in config["models"]:
            candidate = {
                "condition": condition, "model": str(model["checkpoint"]), "model_name": str(model["name"]), "parameters": {**config["defaults"], **model["parameters"]},
                "train": [place(p) for p in own["train"]], "validation": place(own.get("validation", protocol["validation"])), "class_names": protocol["class_names"],
                "dataset_fingerprint": stable_hash(manifests, 24), "ultralytics_version": str(protocol["ultralytics_version"]),
            }
            candidate_id = stable_hash(candidate, 16)
            for seed in map(int, config["seeds"]):
                spec = {**candidate, "candidate_id": candidate_id, "seed": seed}
                out.append({**spec, "run_id": f"{condition}__{model['name']}__s{seed}__{stable_hash(spec, 10)}"})
    return out


def experiment_table(spark: SparkSession, config: dict, fingerprints: dict[str, str] | None = None) -> DataFrame:
    """The matrix as a table; parameters are canonical JSON text, as their types differ."""
    rows = [(r["condition"], r["model"], r["model_name"], json.dumps(r["parameters"], sort_keys=True, separators=(",", ":")), r["train"], r["validation"], r["class_names"], r["dataset_fingerprint"], r["candidate_id"], r["seed"], r["run_id"]) for r in experiment_rows(config, fingerprints)]
    return spark.createDataFrame(rows, "condition string, model string, model_name string, parameters string, train array<string>, validation string, class_names array<string>, dataset_fingerprint string, candidate_id string, seed int, run_id string")


def filter_runs(runs: DataFrame, conditions: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    if conditions:
        runs = runs.where(F.col("condition").isin(conditions))
    return runs.where(F.col("model").isin(models) | F.col("model_name").isin(models)) if models else runs


def select_by_validation(results: DataFrame, expected: DataFrame, seeds: list[int]) -> DataFrame:
    """The best candidate of each model and condition among those that ran on exactly the expected seeds, with its runs.

    ``results``: run_id, candidate_id, condition, model_name, seed, map50_95, training_seconds, and where they are known
    checkpoint and checkpoint_sha256, which stay with the run. What ``expected`` says of a candidate (model, parameters,
    dataset_fingerprint) stays with it, so the selection names what to evaluate. A condition without any complete
    candidate is refused.
    """
    known = results.join(expected.select("candidate_id").distinct(), "candidate_id", "left_semi")
    means = selection.candidate_means(known, ["model_name", "condition", "candidate_id"], "map50_95", "seed", seeds)
    best = selection.best_candidates(means, ["model_name", "condition"], "candidate_id")
    missing = expected.select("model_name", "condition").distinct().join(best, ["model_name", "condition"], "left_anti")
    if lost := missing.limit(5).collect():
        raise ValueError(f"no complete candidate for {[tuple(r) for r in lost]}")
    runs = known.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("seed", "run_id", "map50_95", "training_seconds", *(c for c in RUN_FILES if c in known.columns)))).alias("run_list"))  # one struct a seed
    told = [c for c in ("model", "parameters", "dataset_fingerprint") if c in expected.columns]
    named = best.join(expected.select("candidate_id", *told).dropDuplicates(["candidate_id"]), "candidate_id")
    return named.join(runs, "candidate_id").select("model_name", "condition", "candidate_id", *told, "mean", "std", F.col("run_list").alias("runs"))


def count_pairs(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """What counting errors are computed from: (id, target, predicted) of each predicted image.

    ``predictions``: id, predicted; ``labels``: id, text, of which each non-blank line is one object. A prediction
    whose image has no label file is refused when the rows are read; labels without prediction do not count.
    """
    marked = labels.select("id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), LINE_BREAK), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")).cast("long").alias("target"))
    joined = predictions.select("id", F.col("predicted").cast("long").alias("predicted")).join(marked, "id", "left")
    target = F.when(F.col("target").isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col("id").cast("string"))).cast("long")).otherwise(F.col("target"))
    return joined.select("id", target.alias("target"), "predicted")


def write_comparisons(summary: DataFrame, folder: Path) -> list[Path]:
    """``test_comparison_{model}.csv`` for each model and ``test_comparison_all.csv``: a few rows a condition, sorted."""
    rows = [r.asDict() for r in comparison(summary).collect()]
    names = ["model", "condition", "map50_95_mean", "map50_95_std", "delta_vs_manual_full", "runs"]
    parts = {"all": rows} | {str(m): [r for r in rows if r["model"] == m] for m in sorted({r["model"] for r in rows})}
    paths = {folder / f"test_comparison_{name}.csv": part for name, part in parts.items()}
    for path, part in paths.items():
        write_text(path, csv_text(part, names))
    return list(paths)


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    """Means and deviations of test and counting metrics over runs, and the delta against the model's baseline condition."""
    renamed = evaluated.withColumnsRenamed({m: f"count_{m}" for m in COUNTING})
    out = selection.metric_summary(renamed, ["model_name", "condition"], [*METRICS, *(f"count_{m}" for m in COUNTING)])
    return selection.delta_against(out, ["model_name"], "condition", BASELINE, "map50_95_mean", "delta_vs_manual_full")


def comparison(summary: DataFrame) -> DataFrame:
    return summary.select(F.col("model_name").alias("model"), "condition", "map50_95_mean", "map50_95_std", "delta_vs_manual_full", "runs").orderBy("model", "condition")


def annotation_heat(annotations: DataFrame, files: DataFrame, grid: int = heatmap.GRID) -> tuple[DataFrame, DataFrame]:
    """Heat of every dataset on one scale, and its images and boxes per split (empty label files count)."""
    boxes = annotations.groupBy("dataset", "split").agg(F.count("*").alias("boxes"))
    stats = files.groupBy("dataset", "split").agg(F.count("*").alias("images")).join(boxes, ["dataset", "split"], "left").na.fill(0, ["boxes"])
    return heatmap.heat(annotations, files, ["dataset"], grid), stats.orderBy("dataset", "split")


def heat_picture(cells: DataFrame, dataset: str, grid: int = heatmap.GRID, size: int = 512) -> bytes:
    """One dataset's heat as a PNG of ``size`` by ``size``, interpolated between cells; the grid bounds what is collected."""
    import numpy as np

    from gridloom.functions.exprs import PALETTE

    share = np.zeros((grid, grid))
    for r in cells.where(F.col("dataset") == dataset).select("y", "x", "share").collect():
        share[r.y, r.x] = r.share
    stops = np.array([p[0] for p in PALETTE])
    colours = np.stack([np.rint(np.interp(share, stops, [p[k] for p in PALETTE])) for k in (1, 2, 3)], 2)
    at = np.clip((np.arange(size) + 0.5) * grid / size - 0.5, 0, grid - 1)
    low, part = np.floor(at).astype(int), at - np.floor(at)
    high = np.minimum(low + 1, grid - 1)
    rows = colours[low] * (1 - part)[:, None, None] + colours[high] * part[:, None, None]
    return png(np.rint(rows[:, low] * (1 - part)[None, :, None] + rows[:, high] * part[None, :, None]).astype(np.uint8))


def run_rows(selected: DataFrame, evaluated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected runs with their test metrics, and selected runs that were not evaluated."""
    runs = selected.select("model_name", "condition", "candidate_id", F.inline("runs"))
    return runs.join(evaluated.drop("model_name", "condition", "candidate_id", "seed", *(c for c in ("map50_95", "training_seconds") if c in evaluated.columns)), "run_id"), runs.join(evaluated, "run_id", "left_anti")


def counting_rows(evaluated: DataFrame) -> DataFrame:
    """One row an image: model, condition, seed, run_id, id, target, predicted, error, absolute_error."""
    return evaluated.select("model_name", "condition", "seed", "run_id", F.inline("per_image")).orderBy("model_name", "condition", "seed", "id")


def curves(history: DataFrame, conditions: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Seed-mean validation curves and one SVG a model; a condition that a model lacks is refused."""
    metric = series.metric_column(history.columns)
    mean = series.mean_curve(history.withColumn("epoch", F.col("epoch").cast("double")), ["model", "condition"], "epoch", f"`{metric}`").orderBy("model", "condition", "epoch")
    points: dict[str, dict[str, list[tuple[float, float]]]] = {}
    for r in mean.collect():  # epochs of a few dozen curves
        points.setdefault(r.model, {}).setdefault(r.condition, []).append((r.epoch, r["mean"]))
    for model, found in points.items():
        if lost := [c for c in conditions if c not in found]:
            raise ValueError(f"{model} has no history for {lost}")
    return mean, {model: curve_svg(model, {c: found[c] for c in conditions}) for model, found in points.items()}


def analysis_bundle(frames: dict[str, tuple[DataFrame, list[str]]], protocol: dict, provenance: dict[str, object], path: Path) -> list[str]:
    """CSV extracts of report frames plus protocol and provenance, deflated into one archive; the driver holds a partition of a frame at a time."""
    files: dict[str, str | Iterable[str]] = {}
    for name, (frame, preferred) in frames.items():
        flat = frame.select(*tables.flatten(frame))
        first = [c for c in preferred if c in flat.columns]
        files[f"analysis_csv/{name}.csv"] = csv_lines((r.asDict() for r in flat.toLocalIterator()), [*first, *sorted(set(flat.columns) - set(first))])
    for name, rows in (("protocol", sorted(tables.flatten_dict(protocol).items())), ("provenance", [("analysis_schema_version", 1), *provenance.items()])):
        files[f"analysis_csv/{name}.csv"] = csv_text([{"key": k, "value": v} for k, v in rows], ["key", "value"])
    bundle(files, path)
    return sorted(files)


def report_rows(summary: DataFrame, selected: DataFrame, conditions: list[str]) -> DataFrame:
    """The report's table, formatted: conditions in their given order, winners among synthetic ones marked."""
    from gridloom.functions.exprs import duration, number

    order = summary.sparkSession.createDataFrame(list(enumerate(conditions)), "ordinal int, condition string")
    seconds = selected.select("model_name", "condition", F.aggregate("runs", F.lit(0.0), lambda a, r: a + F.coalesce(r["training_seconds"].cast("double"), F.lit(0.0))).alias("seconds"))
    joined = summary.join(F.broadcast(order), "condition").join(seconds, ["model_name", "condition"])  # a few dozen rows
    won = F.col("condition").startswith("synthetic-") & (F.coalesce("delta_vs_manual_full", F.lit(0.0)) > 0)
    shown = F.when(won, F.concat(F.lit("**"), "condition", F.lit("** ★"))).otherwise(F.col("condition"))
    return joined.orderBy("model_name", "ordinal").select("model_name", shown.alias("condition"), *(number(f"{m}_mean").alias(m) for m in METRICS), number("delta_vs_manual_full").alias("delta"), number("count_mae_mean", 2).alias("count_mae"), duration("seconds").alias("time"), won.alias("won"))


def markdown_report(summary: DataFrame, selected: DataFrame, evaluated: DataFrame, conditions: list[str], provenance: dict[str, object], path: Path) -> str:
    """The report over small result frames: summary table, winners by falling delta, single runs, provenance."""
    rows = report_rows(summary, selected, conditions).collect()
    if missing := set(conditions) - {r.condition.strip("*★ ") for r in rows}:
        raise KeyError(f"no summary for {sorted(missing)}")
    head = ["Detector", "Condition", "P", "R", "F1", "mAP@.50", "mAP@.75", "mAP@.50:.95", "Δ vs manual", "Count MAE", "Total time"]
    lines = ["# Confirmatory results", "", "## Summary by family and condition", "", f"| {' | '.join(head)} |", "|---|---|" + "---:|" * (len(head) - 2)]
    lines += ["| " + " | ".join(str(v) for v in r[:-1]) + " |" for r in rows]
    lines += ["", "## Fully synthetic sets above the baseline", ""]
    wins = selection.highlighted(summary, "condition", "delta_vs_manual_full").orderBy(F.desc("delta_vs_manual_full")).collect()
    lines += [f"- `{w.condition}` is above `{BASELINE}` in `{w.model_name}` by {w.delta_vs_manual_full:.4f} mAP@.50:.95." for w in wins] or ["No fully synthetic condition has a mean above the baseline of its family."]
    runs, _ = run_rows(selected, evaluated.withColumnRenamed("map50_95", "test_map50_95"))
    lines += ["", "## Runs", "", "| Detector | Condition | Seed | Val mAP@.50:.95 | Test mAP@.50:.95 |", "|---|---|---:|---:|---:|"]
    lines += [f"| {r.model_name} | {r.condition} | {r.seed} | {r.map50_95:.4f} | {r.test_map50_95:.4f} |" for r in runs.orderBy("model_name", "condition", "seed").collect()]
    lines += ["", "## Provenance", "", *(f"- {k}: `{v}`" for k, v in provenance.items()), ""]
    write_text(path, "\n".join(lines))
    return "\n".join(lines)
