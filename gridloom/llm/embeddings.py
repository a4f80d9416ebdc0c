"""Embedding near-dedup: one-dimensional random projections, window collisions counted per pair, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW, Scratch, connected_components, forest, partitions, split_hot_groups, table, task_pairs, whole_groups

SEED = 20_240_501
THRESHOLD = 0.9
#: A pair exactly at the threshold shares no cell with at most this probability, and fails the count with at most that.
MISS = 1e-3
COUNT_MISS = 1e-4
#: Projections whose window collisions are counted, and half a window in units of a threshold pair's distance.
COUNTED = 32
HALF_WINDOW = 1.5
#: Steps of half a window, by which places on a projection are rounded to a byte each.
STEPS = 14
#: Rows of a cell that are aimed at, and projections that one part of a cell's name ranks at most.
CELL_ROWS = 256
RANKED = 64
#: Columns of a row that travels to a cell besides its compressed vector: task, node, multiplicity, table, chunk, scale, error.
ROW_BYTES = 8 + 8 + 8 + 4 + 4 + 1 + 4 + 4


def count_needed(projections: int = COUNTED, half_window: float = HALF_WINDOW, miss: float = COUNT_MISS) -> int:
    """Largest count that a threshold pair reaches with probability 1 - miss: its difference along a Gaussian direction is normal."""
    p = math.erf(half_window / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


@cache
def same_extreme(ranked: int, threshold: float, pairs: int = 20_000) -> float:
    """Probability that for a pair at the threshold the same one of ``ranked`` Gaussian projections is the largest in
    absolute value, with the same sign; measured on ``pairs`` draws and lowered by two standard errors."""
    rng = np.random.default_rng([SEED, ranked])
    x = rng.standard_normal((pairs, ranked))
    y = threshold * x + math.sqrt(1 - threshold**2) * rng.standard_normal((pairs, ranked))
    a, b = np.abs(x).argmax(1), np.abs(y).argmax(1)
    at = np.arange(pairs)
    p = float(((a == b) & ((x[at, a] > 0) == (y[at, b] > 0))).mean())
    return p - 2 * math.sqrt(p * (1 - p) / pairs)


def cells_for(rows: int, threshold: float = THRESHOLD, miss: float = MISS, target: int = CELL_ROWS) -> tuple[tuple[int, ...], int]:
    """(projections ranked in each part of a cell's name, tables): cells of about ``target`` rows, and tables enough for
    recall at the threshold. A part of d projections has 2 d values, so log2 of that many bits."""
    bits = max(1, math.ceil(math.log2(max(rows, 1) / target + 1)))
    most = int(math.log2(RANKED)) + 1
    parts = [RANKED] * (bits // most) + ([1 << (bits % most - 1)] if bits % most else [])
    same = math.prod(same_extreme(d, threshold) for d in parts)
    return tuple(parts), math.ceil(math.log(miss) / math.log(1 - same))


def bytes_a_vector(rows: int, dim: int) -> int:
    """What a vector sends to its cells, over all tables."""
    return cells_for(rows)[1] * (ROW_BYTES + dim)


@cache
def directions(dim: int, count: int, stream: int) -> np.ndarray:
    """Gaussian directions in whole numbers, so that products with whole vectors are exact in any order."""
    drawn = np.rint(np.random.default_rng([SEED, dim, stream]).standard_normal((dim, count)) * 64)
    return drawn.astype(np.float32 if dim <= 256 else np.float64)


def cell_names(whole: np.ndarray, parts: tuple[int, ...], tables: int) -> np.ndarray:
    """Names of the cells of compressed vectors, by table: in each part, which projection is the largest in absolute
    value (the extreme of the sorted ones), and its sign."""
    n, dim = whole.shape
    names = np.empty((n, tables), np.int64)
    for t in range(tables):
        found = whole.astype(directions(dim, sum(parts), t + 1).dtype) @ directions(dim, sum(parts), t + 1)
        name, first = np.zeros(n, np.int64), 0
        for d in parts:
            part = found[:, first : first + d]
            at = np.abs(part).argmax(1)
            name = name * (2 * d) + 2 * at + (part[np.arange(n), at] > 0)
            first += d
        names[:, t] = name
    return names


def places(x: np.ndarray, half: float) -> np.ndarray:
    """Places of vectors on the counted projections, a byte each, in steps of a window's half over STEPS. Rounding and the
    ends of a byte only bring places nearer: two within ``half`` of each other are within STEPS steps."""
    found = (x @ directions(x.shape[1], COUNTED, 0).astype(np.float32)) / np.float32(64)
    return np.clip(np.rint(found * np.float32(STEPS / half)) + 128, 0, 255).astype(np.uint8)


def collisions(spots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many windows each pair (i, j) collides."""
    a, b = spots.take(i, 0), spots.take(j, 0)
    near = np.maximum(a, b) - np.minimum(a, b) <= STEPS
    return np.bitwise_count(near.view(np.uint64)).sum(1)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    flat = column.take(pa.array(rows)).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.take(pa.array(rows))
    flat = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def compress(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A byte a component, the scale, and a bound on the length of what is lost."""
    scale = (np.abs(unit).max(1) / 127).astype(np.float32)
    whole = np.clip(np.rint(unit / scale[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    lost = unit - whole * scale[:, None].astype(np.float64)
    error = np.sqrt(np.einsum("ij,ij->i", lost, lost)) * (1 + 1e-6) + 1e-9
    return whole, scale, np.nextafter(error.astype(np.float32), np.float32(np.inf))


def _coded(nodes: DataFrame, parts: tuple[int, ...], tables: int) -> DataFrame:
    """(node, mult, whole, scale, error, cells): compressed vectors and the names of their cells, all found from those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            sizes = pc.list_value_length(whole_batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                every = np.flatnonzero(sizes == dim)
                for k in range(0, len(every), 4096):
                    rows = every[k : k + 4096]
                    whole, scale, error = compress(_matrix(whole_batch.column(1), rows, dim))
                    names = cell_names(whole, parts, tables)
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(names.ravel()))
                    packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * dim).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole))])
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([whole_batch.column(0).take(at), whole_batch.column(2).take(at), packed, pa.array(scale), pa.array(error), cells], ["node", "mult", "whole", "scale", "error", "cells"])

    return nodes.select("node", "vec", "mult").mapInArrow(run, "node long, mult long, whole binary, scale float, error float, cells array<long>")


def _verified(doubtful: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those at the threshold or above, by their vectors in double precision, with both multiplicities."""
    one, two = (nodes.select(F.col("node").alias(k), F.col("vec").alias(f"vec_{k}"), F.col("mult").alias(f"mult_{k}")) for k in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                near = np.einsum("ij,ij->i", _matrix(batch.column(2), rows, dim), _matrix(batch.column(3), rows, dim)) >= threshold
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(rows[near])) for k in (0, 1, 4, 5)], ["a", "b", "mult_a", "mult_b"])

    joined = doubtful.join(one, "a").join(two, "b").select("a", "b", "vec_a", "vec_b", "mult_a", "mult_b")
    return joined.mapInArrow(run, "a long, b long, mult_a long, mult_b long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, chunk: int = 1024) -> DataFrame:
    """Cosine links at ``threshold`` or more between all vectors: (id, n_links, component_id, kept).

    Vectors that are null, empty, all zero or hold null, NaN or infinite components link with nothing; vectors of
    different lengths do not link. Copies are one node with a multiplicity, so a vector that a third of all rows share
    is one row here; each still counts its copies. Every row is returned, repeated ids too; null ids are never a smallest id.

    Counting collisions of single projections over all rows costs n^2 whatever the window. So rows first meet in cells
    named by the extremes of their sorted projections, with tables enough for recall 1 - MISS at the threshold. Only a
    byte a component travels to the cells. There a pair must collide in ``count_needed()`` of COUNTED query-centred
    windows; it is then a link or none by the compressed vectors and a bound on what they lost, and only pairs too near
    the threshold for that are looked up and decided in double precision. A pair counts in the first table that puts
    it in one cell. Cells above ``chunk`` rows are dealt out as chunk pairs. A task returns link counts and a spanning
    forest, not pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    vec = F.col(vec_col)
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("node", F.when(F.col("sound"), F.xxhash64("vec")))
    nodes = scratch.keep(rows.where("sound").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("mult"), F.min("id").alias("low")))
    parts, tables = cells_for(nodes.count(), threshold)
    coded = scratch.keep(_coded(nodes, parts, tables))
    keyed = coded.select("node", "mult", "whole", "scale", "error", F.posexplode("cells").alias("t", "cell")).withColumn("key", F.xxhash64(F.length("whole"), "t", "cell"))
    tasks = split_hot_groups(keyed, "key", "node", chunk, scratch).select("task", "part", "cross", "t", "node", "mult", "whole", "scale", "error")
    need = count_needed()
    half = HALF_WINDOW * math.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "task", 8192):
            sizes = pc.binary_length(group.column("whole")).to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                mine = group.take(pa.array(rows)) if len(rows) < group.num_rows else group
                whole = np.frombuffer(b"".join(mine.column("whole").to_pylist()), np.int8).reshape(-1, dim)
                t, node, mult, scale, error = (mine.column(c).to_numpy() for c in ("t", "node", "mult", "scale", "error"))
                spots = places(whole * scale[:, None], half)
                lost = error.astype(np.float64)
                pairs, doubtful = [], []
                for i, j in task_pairs(*(mine.column(c).to_numpy() for c in ("task", "part", "cross"))):
                    for k in range(0, len(i), 1 << 15):
                        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                        often = collisions(spots, a, b) >= need
                        a, b = a[often], b[often]
                        # In double precision, products of whole numbers are exact; the scales are those stored.
                        dot = np.einsum("ij,ij->i", whole[a].astype(np.float64), whole[b].astype(np.float64)) * scale[a].astype(np.float64) * scale[b]
                        slack = lost[a] + lost[b] + lost[a] * lost[b] + 1e-12
                        other = node[a] != node[b]
                        sure, maybe = other & (dot - slack >= threshold), other & (dot + slack >= threshold) & (dot - slack < threshold)
                        pairs.append((a[sure], b[sure]))
                        doubtful.append((a[maybe], b[maybe]))
                a, b, c, d = (np.concatenate([x[k] for x in some] or [rows[:0]]) for some in (pairs, doubtful) for k in (0, 1))
                linked = np.unique(np.concatenate([a, b, c, d]))
                names, at = np.empty((len(linked), tables), np.int64), np.zeros(len(node), np.int64)
                for k in range(0, len(linked), 4096):
                    names[k : k + 4096] = cell_names(whole[linked[k : k + 4096]], parts, tables)
                at[linked] = np.arange(len(linked))

                def first(a: np.ndarray, b: np.ndarray, names=names, at=at, t=t) -> np.ndarray:
                    return np.concatenate([(names[at[a[k : k + (1 << 16)]]] == names[at[b[k : k + (1 << 16)]]]).argmax(1) == t[a[k : k + (1 << 16)]] for k in range(0, len(a), 1 << 16)] or [np.empty(0, bool)])

                mask = first(a, b)
                a, b = a[mask], b[mask]
                mask = first(c, d)
                c, d = c[mask], d[mask]
                degree = np.bincount(a, mult[b], len(node)) + np.bincount(b, mult[a], len(node))
                counted = np.flatnonzero(degree)
                a, b = forest(a, b, len(node))
                kind = np.repeat(np.array([0, 1, 2], np.int32), [len(counted), len(a), len(c)])
                left, right = np.concatenate([node[counted], node[a], node[c]]), np.concatenate([degree[counted].astype(np.int64), node[b], node[d]])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(left), pa.array(right)], ["kind", "a", "b"])

    found = tasks.repartition(partitions(spark), "task").sortWithinPartitions("task").mapInArrow(run, "kind int, a long, b long")
    found = scratch.keep(found, NARROW)
    sure = scratch.keep(_verified(found.where("kind = 2").select("a", "b"), nodes, threshold), NARROW)
    degrees = found.where("kind = 0").select("a", "b").union(sure.select("a", "mult_b")).union(sure.select("b", "mult_a")).groupBy("a").agg(F.sum("b").alias("degree"))
    roots = connected_components(scratch, found.where("kind = 1").select("a", "b").union(sure.select("a", "b")))
    info = nodes.select("node", "mult", "low").join(roots, "node", "left").join(degrees.withColumnRenamed("a", "node"), "node", "left")
    info = scratch.keep(info.select("node", "low", F.coalesce("root", "node").alias("root"), (F.coalesce("degree", F.lit(0)) + F.col("mult") - 1).alias("n_links")), NARROW)
    lows = info.groupBy("root").agg(F.min("low").alias("component_id"))
    info = info.join(lows, "root").select("node", "n_links", "component_id")
    out = rows.select("id", "node").join(info, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op1_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``embeddings``: vec_id, n_links, component_id, kept, at a cosine of 0.9 or more."""
    return embedding_groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op1_embedding_groups": op1_embedding_groups}
