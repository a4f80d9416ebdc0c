"""Shared pieces of the training-data operators: scratch tables, grouped Arrow streams, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local
    mode; on a cluster each executor would write to its own disk, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Tasks that write a narrow table at least, as far as there are partitions.
LEAST_WRITERS = 16
#: Spark deletes the shuffle files of an execution when it ends; set while a scratch table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that go to a Python worker at once (Spark's default is 64 MB); set while a scratch table is written. A batch is
#: held by the JVM, with room to grow, and by the worker.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"

#: Whether a write leaves an empty file when it is done. In local file systems the driver starts a command for that, which
#: for an instant counts with the driver's own memory; nothing here asks for the file.
MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor only repeats the step after the last table."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(self._close)

    def _close(self) -> None:
        try:
            drop_path(self.spark, self.root)
        except Exception:  # the session may be gone by then
            pass

    def keep(self, frame: DataFrame, narrow: int = 1) -> DataFrame:
        """Write ``frame`` and read it back. What it shuffled is deleted with the write, not at some later collection.

        ``narrow``: of rows that are a small part of what their step read (links, labels), so many partitions are
        written by one task; that saves files, and each of them starts processes of its own in local file systems.
        """
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false"), self.spark.conf.get(BATCH)
        self.spark.conf.set(CLEANUP, "true")
        self.spark.conf.set(BATCH, BATCH_BYTES)
        try:
            schema = frame.schema
            n = partitions(self.spark)
            frame = frame.coalesce(max(min(n, LEAST_WRITERS), n // narrow)) if narrow > 1 else frame
            frame.write.option("compression", "zstd").option(MARK, "false").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before[0])
            self.spark.conf.set(BATCH, before[1])
        return self.spark.read.schema(schema).parquet(path)

    def free(self, frame: DataFrame) -> None:
        for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            drop_path(self.spark, path)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key`` (long): a group split over batches is held until it ends."""
    held: list[pa.Table] = []
    rows, enough = 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < enough:
            continue
        joined = pa.concat_tables(held)
        keys = joined.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield joined.slice(0, cut)
        held, rows = [joined.slice(cut)], joined.num_rows - cut
        enough = max(least, 2 * rows)
    if rows:
        yield pa.concat_tables(held)


def pairs_in_groups(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j with equal keys, for sorted keys, one distance j - i at a time."""
    at = np.arange(len(keys))
    ahead = 1
    while len(at):
        at = at[at + ahead < len(keys)]
        at = at[keys[at] == keys[at + ahead]]
        if len(at):
            yield at, at + ahead
        ahead += 1


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the links (i, j) over n items."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def split_hot_groups(rows: DataFrame, key: str, identity: str, chunk: int, scratch: Scratch | None = None) -> DataFrame:
    """Deal each group out as chunk pairs: rows get ``task`` (long), ``part`` (their chunk) and ``cross``.

    Two rows of one chunk meet in the chunk's own task (``cross`` false), two rows of different chunks in the task of
    that pair of chunks (``cross`` true), each exactly once. A group of s rows becomes about (s / chunk)^2 / 2 tasks of
    at most about 2 * chunk rows, so no task holds a whole hot group. Sizes come from a count with map-side
    aggregation; only keys above ``chunk`` are joined back. With ``scratch`` those are counted first and kept, so
    that Spark knows how few they are when it plans the join, and wide rows are not shuffled for it.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_size")).where(F.col("_size") > chunk)
    hot = scratch.keep(hot, NARROW) if scratch else hot
    dealt = rows.join(hot, key, "left").withColumn("_n", F.coalesce(F.ceil(F.col("_size") / chunk), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.hash(F.col(identity), F.lit(7)), F.col("_n")))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.withColumn("task", F.xxhash64(key, F.least("part", "_o"), F.greatest("part", "_o")))
    return dealt.withColumn("cross", F.col("part") != F.col("_o")).drop("_size", "_n", "_o")


def task_pairs(keys: np.ndarray, part: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that each task of ``split_hot_groups`` answers for."""
    for i, j in pairs_in_groups(keys):
        mine = ~cross[i] | (part[i] != part[j])
        if mine.any():
            yield i[mine], j[mine]


#: Partitions of a links table that one task writes: a link is two longs, where its documents are whole texts.
NARROW = 8


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Label nodes of ``edges`` (a, b: long) with the smallest node they reach: (node, root).

    Alternating large-star and small-star steps; all state stays in tables, each round is written once to the shared
    folder, and every aggregate is a minimum with map-side combine, so a hub with many links is no hot task.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), NARROW)
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        new = scratch.keep(small.union(low.select("a", F.col("m").alias("b"))).distinct(), NARROW)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        scratch.free(now)
        now = new
        if mark == before or mark[0] == 0:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
