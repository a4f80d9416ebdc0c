"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW, Scratch, connected_components, forest, partitions, split_hot_groups, table, task_pairs, whole_groups

SEED = 42
#: Random reference fingerprints of the filter; the block pivots come on top.
RANDOM_PIVOTS = 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(line, SEED)], dtype="<u8")
    else:
        spans = zip(starts, ends[width - 1 :], strict=False)
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), "<u8", len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def random_pivots() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**63, RANDOM_PIVOTS, dtype=np.int64).view(np.uint64) * np.uint64(2)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows) to reference fingerprints (columns)."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def signature_masks(distance: int, rows: int) -> list[int]:
    """Bit groups of which two fingerprints within ``distance`` agree on one at least (pigeonhole).

    Unit fingerprints are pivots too: the distance to one, less that to zero, is one bit, so equal distances to the
    unit pivots of a group mean equal bits there. Few rows: distance + 1 groups; many: pairs of smaller groups that
    pin twice the share of the bits, so that a signature's bucket stays small as the input grows.
    """
    blocks, keep = (distance + 1, 1) if rows < 1 << 25 else (distance + 3, 3)
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
    return [sum(c) for c in combinations(parts, keep)]


def near_links(scratch: Scratch, nodes: DataFrame, distance: int = 3, chunk: int = 512) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints ``fp`` at ``distance`` or fewer differing bits.

    No link between two components is lost; inside a task only a spanning star of what is linked there is returned.
    """
    rows = nodes.count()
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [signed(m) for m in signature_masks(distance, rows)]
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("block", "bits"))
    keyed = keyed.select("fp", F.xxhash64("block", "bits").alias("key"))
    tasks = split_hot_groups(keyed, "key", "fp", chunk).select("task", "fp", "part", "cross")
    pivots = random_pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "task", 1 << 16):
            keys, fps = group.column("task").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
            far = pivot_table(fps, pivots)
            left, right, held = [], [], 0
            for i, j in task_pairs(keys, group.column("part").to_numpy(), group.column("cross").to_numpy()):
                near = np.ones(len(i), bool)
                for k in range(0, RANDOM_PIVOTS, 4):  # the triangle inequality: no coordinate may differ by more
                    near &= (np.abs(far[i, k : k + 4] - far[j, k : k + 4]) <= distance).all(1)
                    i, j, near = i[near], j[near], near[near]
                sure = np.bitwise_count(fps[i] ^ fps[j]) <= distance
                left.append(i[sure])
                right.append(j[sure])
                held += int(sure.sum())
                if held > 1 << 20:
                    a, b = forest(np.concatenate(left), np.concatenate(right), len(fps))
                    left, right, held = [a], [b], 0
            if held or left:
                a, b = forest(np.concatenate(left), np.concatenate(right), len(fps))
                own = fps.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], ["a", "b"])

    spark = nodes.sparkSession
    return tasks.repartition(partitions(spark), "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long").where("a <> b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """Near-duplicate classes of texts: (id, fp long, component_id).

    Lower-cases A-Z, takes words between ASCII white space and ``width``-word shingles. Exact copies and equal
    fingerprints are one node; every row is returned, repeated rows and ids included. Null and empty texts have
    fingerprint zero, which links like any other. ``component_id`` is the smallest id that can be reached (null ids
    are never smallest; a class of null ids only has null). An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, id_col, text_col, width))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    links = scratch.keep(near_links(scratch, nodes.select("fp"), distance), NARROW)
    roots = connected_components(scratch, links)
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    nodes = scratch.keep(nodes, NARROW)
    lows = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(nodes.join(lows, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, fingerprint (16 lowercase hex digits), component_id, by 3-word shingles and at most 3 bits."""
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
