"""Audits: duplicates, parity, leakage, orphans, matches by priority, rule rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_duplicates(rows: DataFrame, content: str | Column, identity: str) -> DataFrame:
    """Contents that stand more than once: (sha256, copies, first id)."""
    digest = F.sha2(F.col(content) if isinstance(content, str) else content, 256)
    return rows.groupBy(digest.alias("sha256")).agg(F.count("*").alias("copies"), F.min(identity).alias("first_id")).where("copies > 1")


def pair_parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, and those that lack their partner: (both, left_only, right_only)."""
    sides = left.select(key, F.lit(True).alias("_a"), F.lit(False).alias("_b")).unionByName(right.select(key, F.lit(False).alias("_a"), F.lit(True).alias("_b")))
    keys = sides.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))  # one shuffle, combined before it
    known = F.col(key).isNotNull()  # a null has no partner
    return keys.agg(F.count_if(known & F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_a") & ~(known & F.col("_b"))).alias("left_only"), F.count_if(F.col("_b") & ~(known & F.col("_a"))).alias("right_only"))


def leakage(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key also stands on the other side."""
    return rows.join(other.select(key), key, "left_semi")


def coverage(universe: DataFrame, splits: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in no split, and keys in several: (missing, overlapping, unknown)."""
    per_key = splits.groupBy(key).agg(F.count_distinct(split).alias("_splits"))
    joined = universe.select(key).distinct().withColumn("_u", F.lit(True)).join(per_key, key, "full_outer")
    return joined.agg(F.count_if(F.col("_splits").isNull()).alias("missing"), F.count_if(F.col("_splits") > 1).alias("overlapping"), F.count_if(F.col("_u").isNull()).alias("unknown"))


def orphans(rows: DataFrame, owners: DataFrame, condition: Column) -> DataFrame:
    return rows.join(owners, condition, "left_anti")


def prioritised_match(rows: DataFrame, candidates: DataFrame, on: list[str], identity: list[str], priority: str) -> DataFrame:
    """For each row the candidate of lowest priority; rows without one are dropped. A min over a struct, no window.

    Candidates are reduced to the best of each key, with a map-side combine, before they meet the rows.
    """
    rest = [c for c in candidates.columns if c not in on]
    least = F.min_by(F.struct(*rest), F.struct(*[priority, *[c for c in rest if c != priority]])).alias("_best")
    best = candidates.groupBy(*on).agg(least)
    joined = rows.select(*dict.fromkeys([*identity, *on])).distinct().join(best, on)
    if not set(on) <= set(identity):  # a row may hold several keys
        joined = joined.select(*identity, "_best.*").groupBy(*identity).agg(least)
    return joined.select(*identity, "_best.*")


def strict_join(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """An inner join, and beside it the left rows that found no partner, which strict readers refuse."""
    return left.join(right, on), left.join(right.select(*on).distinct(), on, "left_anti")


def rule(name: str, frame: DataFrame, actual: Column, expected: Column | int) -> DataFrame:
    """One audit row: (rule, expected, actual, ok)."""
    want = expected if isinstance(expected, Column) else F.lit(expected)
    row = frame.agg(actual.cast("long").alias("actual"), want.cast("long").alias("expected"))
    return row.select(F.lit(name).alias("rule"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))


def report(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def ready(rules: DataFrame) -> DataFrame:
    return rules.agg(F.bool_and("ok").alias("ready"), F.count_if(~F.col("ok")).alias("errors"))
