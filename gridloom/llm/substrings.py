"""Exact substring dedup: Rabin-Karp window hashes, first occurrences decided by hash bucket, maximal removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, partitions, table, whole_groups

WINDOW = 20
#: Odd multiplier of the rolling hash modulo 2^64, over 64-bit word hashes.
BASE = 0x9E3779B97F4A7C15
CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 4096
#: Buckets of hashes beyond the number of partitions: about half a million hashes each, up to here.
MOST_BUCKETS = 1 << 16


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` words; spans double, then the powers of two in width are joined."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    out, done, span, size = None, 0, words.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while size <= width:
            if width & size:
                if out is None:
                    out, done = span, size
                else:  # the longer span stands first
                    n = len(words) - size - done + 1
                    out = span[:n] * np.uint64(pow(BASE, done, 1 << 64)) + out[size : size + n]
                    done += size
            if size * 2 <= width:
                n = len(words) - 2 * size + 1
                span = span[:n] * np.uint64(pow(BASE, size, 1 << 64)) + span[size : size + n]
            size *= 2
    return out


def chunk_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after another, and where each text's words begin (one entry more than texts)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end of a text leaves an empty piece
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[split.offsets.to_numpy()]


def in_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places by (first, second), equals as they stand; mostly equal firsts have equal seconds, and one key is enough."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    return np.lexsort((second, first)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


def windows(words: pa.Array, starts: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows inside one text, and where they start; ``seed`` makes hashes that do not depend on each other.
    ``words`` may be encoded as a dictionary already."""
    found = words if pa.types.is_dictionary(words.type) else words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, seed) for w in found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    hashes = window_hashes(each[found.indices.to_numpy()] if len(words) else np.empty(0, np.uint64), width)
    at = np.arange(len(hashes))
    inside = at + width <= np.repeat(starts[1:], np.diff(starts))[: len(hashes)]
    return hashes[inside], at[inside]


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order (times an odd number, so that also few low bits spread over the buckets), their buckets,
    which are ranges of them, each window's place among them, and how often each stands."""
    distinct, place, count = np.unique(hashes * np.uint64(BASE), return_inverse=True, return_counts=True)
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return distinct, bucket.astype(np.int64), place, count


def _bits(answers: list[dict] | None, bucket: np.ndarray) -> np.ndarray:
    """A chunk's answers, bucket by bucket, in the order in which it asked."""
    found = {x["bucket"]: x["bits"] for x in answers or []}
    counts = np.bincount(bucket)
    used = np.flatnonzero(counts)
    return np.concatenate([np.unpackbits(np.frombuffer(found[b], np.uint8), count=n) for b, n in zip(used.tolist(), counts[used].tolist(), strict=True)] or [np.empty(0, np.uint8)]).astype(bool)


class Suspects:
    """A chunk's windows whose first hash stands more than once, in the chunk or elsewhere, as distinct pairs of two hashes.

    Pairs are ordered by bucket, and inside one by value. What two windows are is decided by both hashes."""

    def __init__(self, words: pa.Array, starts: np.ndarray, width: int, mask: int, buckets: int, answers: list[dict] | None):
        words = words.dictionary_encode()
        hashes, at = windows(words, starts, width)
        distinct, bucket, place, count = by_bucket(hashes & np.uint64(mask), buckets)
        again = ((count > 1) | _bits(answers, bucket))[place]
        other, place = windows(words, starts, width, 1)[0][again], place[again]
        self.at = at[again]
        order = in_order(place, other)
        first, second = place[order], other[order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])) if len(order) else np.empty(0, bool)
        self.bucket, self.pairs = bucket[first[new]], np.stack([distinct[first[new]], second[new]], 1)
        self.of, self.is_first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
        self.of[order] = np.cumsum(new) - 1
        self.is_first[order[new]] = True


def _chunks(docs: DataFrame, text_col: str, rows_type: T.DataType) -> DataFrame:
    """Rows packed, in global order, into chunks keyed by ``at`` (partition << 32 | number): (at, rows)."""
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("rows", T.ArrayType(rows_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
            start, held = 0, 0
            for k, size in enumerate([*sizes.tolist(), None]):
                if size is None or k > start and (held + size > CHUNK_BYTES or k - start >= CHUNK_ROWS):
                    if k > start:
                        part_rows = pa.RecordBatch.from_arrays(batch.slice(start, k - start).columns, names=batch.schema.names).to_struct_array()
                        rows = pa.ListArray.from_arrays(pa.array([0, k - start], pa.int32()), part_rows)
                        yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), rows], ["at", "rows"])
                        number += 1
                    start, held = k, 0
                held += size or 0

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, first_bits: int = 64) -> DataFrame:
    """All columns of ``docs`` (clashing ones are replaced) plus ``n_words``, ``n_removed``, ``removed`` (maximal [start, end)
    word intervals) and ``kept`` (kept words joined by one space).

    A word goes if a ``width``-word window over it also starts earlier: in a smaller id, or earlier in the same text.
    Words stand between ASCII white space, unchanged. Null and empty texts have no words, ``kept`` is then empty; texts
    shorter than a window lose nothing. Null ids come before all others; rows with equal ids are ordered by text hash,
    so of repeated rows one keeps its words. Windows are judged on the input.

    Rows are range-partitioned by id once and packed into chunks, written to the shared folder, so a window's place is
    its chunk and no ids travel with hashes. Each chunk sends every distinct window hash once, 8 bytes, to the hash's
    bucket, which counts and answers with one bit each: does another chunk have it? Windows with such a hash, or with
    one that stands twice in their chunk, go a second time with a second, independent hash, 16 bytes, and the bucket
    answers whether an earlier chunk has that very pair. So equality rests on 128 bits of two hashes (``first_bits``
    narrows the first, for tests), and a window that a third of all texts share is one entry a chunk; no group of
    occurrences is gathered. There are more buckets than partitions, and a task holds one bucket at a time; tasks become
    more with the chunks, so that each has a few buckets or chunks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    own = ["n_words", "n_removed", "removed", "kept"]
    base = docs.drop(*own)
    rows_type = T.StructType([T.StructField(f.name, f.dataType, True) for f in base.schema])
    order = base.withColumn("__h", F.xxhash64(text_col))
    order = order.repartitionByRange(partitions(spark), F.col(id_col), F.col("__h")).sortWithinPartitions(id_col, "__h").drop("__h")
    chunks = scratch.keep(_chunks(order, text_col, rows_type))
    buckets = max(partitions(spark), min(chunks.count() // 2, MOST_BUCKETS))
    spread = max(partitions(spark), buckets // 2)
    mask = (1 << first_bits) - 1

    def rows_of(at: int, bucket: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        used, first = np.unique(bucket, return_index=True)
        parts = np.split(values, first[1:]) if len(used) else []
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([at] * len(used), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "at", "hashes"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                distinct, bucket, _, _ = by_bucket(windows(*chunk_words(texts.values), width)[0] & np.uint64(mask), buckets)
                yield rows_of(at, bucket, distinct)

    def ask_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                found = Suspects(*chunk_words(texts.values), width, mask, buckets, answers.as_py())
                yield rows_of(at, found.bucket, found.pairs)

    def decide(columns: int, earlier: bool):
        """Bits for what each chunk of a bucket asked: does an earlier chunk (or any other one) have it, too?"""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in whole_groups(batches, "bucket", 1):
                column = group.column("bucket").to_numpy()
                for b in np.unique(column).tolist():
                    lo, hi = int(np.searchsorted(column, b)), int(np.searchsorted(column, b, "right"))
                    mine = group.slice(lo, hi - lo)
                    raw = mine.column("hashes").to_pylist()
                    sizes = [len(x) // (8 * columns) for x in raw]
                    values = np.frombuffer(b"".join(raw), np.uint64).reshape(-1, columns)
                    order = in_order(values[:, 0], values[:, -1])  # rows come by chunk: equals stand in global order
                    same = (values[order[1:]] == values[order[:-1]]).all(1)
                    known = np.zeros(len(values), bool)
                    known[order[1:]] = same
                    if not earlier:
                        known[order[:-1]] |= same
                    bits = [np.packbits(x).tobytes() for x in np.split(known, np.cumsum(sizes)[:-1])]
                    yield pa.RecordBatch.from_arrays([mine.column("at").combine_chunks().cast(pa.int64()), pa.array([b] * len(bits), pa.int64()), pa.array(bits, pa.binary())], ["at", "bucket", "bits"])

        return run

    texts = chunks.select("at", F.col("rows").getField(text_col).alias("texts"))
    asked = "bucket long, at long, hashes binary"

    def answered(sent: DataFrame, columns: int, earlier: bool) -> DataFrame:
        dealt = sent.repartition(spread, "bucket").sortWithinPartitions("bucket", "at")
        bits = scratch.keep(dealt.mapInArrow(decide(columns, earlier), "at long, bucket long, bits binary"))
        return bits.repartition(spread, "at").groupBy("at").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))

    shared = answered(texts.mapInArrow(ask, asked), 1, False)
    later = answered(texts.repartition(spread, "at").join(shared, "at", "left").select("at", "texts", "answers").mapInArrow(ask_again, asked), 2, True)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = T.StructType([*rows_type.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("kept", T.StringType())])
    names = base.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, answers, verdicts in zip(*batch.columns, strict=True):
                rows = rows.values
                words, starts = chunk_words(rows.field(names.index(text_col)))
                found = Suspects(words, starts, width, mask, buckets, answers.as_py())
                gone = found.at[_bits(verdicts.as_py(), found.bucket)[found.of] | ~found.is_first]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + width, -1)
                covered = np.cumsum(edge)[:-1] > 0
                text_of = np.repeat(np.arange(len(rows)), np.diff(starts))
                removed = np.bincount(text_of, covered, len(rows)).astype(np.int64)
                spans = []
                for a, b, some in zip(starts[:-1].tolist(), starts[1:].tolist(), removed.tolist(), strict=True):
                    turn = np.flatnonzero(np.diff(covered[a:b].astype(np.int8), prepend=0, append=0)).tolist() if some else []
                    spans.append([{"start": x, "end": y} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                left = np.concatenate([[0], np.cumsum(np.diff(starts) - removed)]).astype(np.int32)
                kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(~covered))), " ")
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(np.diff(starts).astype(np.int64)), pa.array(removed), pa.array(spans, pa.list_(span)), kept], [*names, *own])

    both = chunks.repartition(spread, "at").join(shared, "at", "left").join(later.withColumnRenamed("answers", "verdicts"), "at", "left")
    return both.select("rows", "answers", "verdicts").mapInArrow(cut, schema)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_removed, kept_sha256, by 20-word windows that also start earlier."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_substrings": op10_substrings}
