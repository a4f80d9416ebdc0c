"""Histograms, hashes, overlaps and reshaping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.exprs import json_string

#: Side of the cells by which boxes that may overlap are brought together.
CELL = 64


def histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, key: Column, value: str = "n") -> DataFrame:
    """A small histogram as one map, in key order."""
    entries = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("key"), F.col(value).alias("value"))))
    return counts.agg(F.map_from_entries(entries).alias("histogram"))


def ordered_hash(rows: DataFrame, keys: list[str], order: list[str], text: list[str], name: str = "sha256") -> DataFrame:
    """SHA-256 of a group's canonical JSON list of string lists, in order, and its number of rows.

    Such a digest must see its group in order, so a task does; it streams over sorted rows, which spill, and holds one
    batch of them. Rows that tie come in the order of their text.
    """
    line = F.concat(F.lit("["), F.concat_ws(",", *(json_string(F.col(c).cast("string")) for c in text)), F.lit("]"))
    places = [f"_o{k}" for k in range(len(order))]
    cut = rows.select(*keys, *(F.col(c).alias(p) for c, p in zip(order, places, strict=True)), line.alias("_line"))
    kept = T.StructType([*rows.select(*keys).schema.fields, T.StructField(name, T.StringType()), T.StructField("records", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, count, kinds = None, None, 0, []

        def done() -> pa.RecordBatch:
            digest.update(b"]")
            values = [*(pa.array([v], kind) for v, kind in zip(now, kinds, strict=True)), pa.array([digest.hexdigest()]), pa.array([count], pa.int64())]
            return pa.RecordBatch.from_arrays(values, names=kept.names)

        for batch in batches:
            kinds = [batch.column(k).type for k in range(len(keys))]
            groups = zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True) if keys else repeat((), batch.num_rows)
            for group, value in zip(groups, batch.column(len(keys)).to_pylist(), strict=True):
                if group != now:
                    if digest:
                        yield done()
                    now, digest, count = group, hashlib.sha256(b"["), 0
                digest.update((b"," if count else b"") + value.encode())
                count += 1
        if digest:
            yield done()

    dealt = cut.repartition(*keys) if keys else cut.repartition(1)
    return dealt.sortWithinPartitions(*keys, *places, "_line").select(*keys, "_line").mapInArrow(run, kept)


def manifest_fingerprint(rows: DataFrame, keys: list[str], identity: str, digest: str) -> DataFrame:
    """An order-free fingerprint for manifests of any size: digests are hashed by id range, then the ranges in order."""
    part = rows.groupBy(*keys, F.substring(F.sha2(F.col(identity).cast("string"), 256), 1, 3).alias("_p")).agg(F.array_sort(F.collect_list(F.struct(F.col(identity).cast("string").alias("i"), F.col(digest).alias("d")))).alias("_l"))
    part = part.withColumn("_h", F.sha2(F.array_join(F.transform("_l", lambda x: F.concat_ws("=", x["i"], x["d"])), "\n"), 256))
    return part.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_h"))), lambda x: x["_h"]), "\n"), 256).alias("fingerprint"))


def overlapping_pairs(boxes: DataFrame, group: str, order: str, cell: int = CELL) -> DataFrame:
    """Ordered pairs (earlier, later) of a group's rectangles that share area; touching edges do not count.

    Boxes meet by the grid cells they cover, and a pair is reported in the cell of its intersection's corner only,
    so there is an equi-join and no duplicate.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1e-9) / cell)))
    spread = boxes.where("x1 > x0 and y1 > y0").withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))
    a, b = spread.alias("a"), spread.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")))
    both = F.col(f"a.{order}") < F.col(f"b.{order}")
    left, top = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    right, bottom = F.least("a.x1", "b.x1"), F.least("a.y1", "b.y1")
    own = (F.floor(left / cell) == F.col("a.cx")) & (F.floor(top / cell) == F.col("a.cy"))
    area = (right - left) * (bottom - top)
    return pairs.where(both & (left < right) & (top < bottom) & own).select(F.col(f"a.{group}").alias(group), F.col(f"a.{order}").alias("earlier"), F.col(f"b.{order}").alias("later"), area.alias("area"))


def flatten(frame: DataFrame, prefix: str = "") -> list[Column]:
    """Nested structs as dotted columns; arrays and maps become JSON text."""
    out: list[Column] = []

    def walk(column: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                walk(column[field.name], field.dataType, f"{name}.{field.name}" if name else field.name)
        elif isinstance(kind, T.ArrayType | T.MapType):
            out.append(F.to_json(column).alias(name))
        else:
            out.append(column.alias(name))

    for field in frame.schema.fields:
        walk(F.col(f"`{field.name}`"), field.dataType, f"{prefix}.{field.name}" if prefix else field.name)
    return out


def flatten_dict(value: object, prefix: str = "") -> dict[str, object]:
    """A nested configuration as dotted keys; lists as canonical JSON."""
    import json

    if isinstance(value, dict):
        return {k: v for key, child in value.items() for k, v in flatten_dict(child, f"{prefix}.{key}" if prefix else str(key)).items()}
    return {prefix: json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, list | tuple) else value}


def json_entries(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The top-level entries of a JSON object column as (keys, key, value) rows."""
    return rows.select(*keys, F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))


def union_columns(frames: list[DataFrame], preferred: list[str]) -> DataFrame:
    """All rows; preferred columns first, the others in order; nulls where a frame lacks one."""
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return joined.select(*[c for c in preferred if c in joined.columns], *sorted(c for c in joined.columns if c not in preferred))


def array_statistics(rows: DataFrame, keys: list[str], values: str, quantile: float, threshold: float) -> DataFrame:
    """Order statistics of an array's elements, and the half-open index range of those at the threshold or more."""
    spread = rows.select(*keys, F.posexplode(values).alias("k", "v"))
    over = F.when(F.col("v") >= threshold, F.col("k"))
    v = F.col("v").cast("double")
    return spread.groupBy(*keys).agg(F.percentile(v, quantile).alias("quantile"), F.median(v).alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(over).alias("first"), (F.max(over) + 1).alias("past_last"))
