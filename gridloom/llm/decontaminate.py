"""Benchmark decontamination by a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 10
#: Words of benchmark items in one index: arrays of some 30 MB, of which a worker holds one at a time.
BLOCK_WORDS = 1 << 20
#: Characters of documents that are matched at once (a longer text alone), and pairs of a place and a window.
BATCH_CHARS, PAIRS = 8 << 20, 1 << 20
#: Word bytes: digits, letters (A-Z lowered) and everything outside ASCII; the rest becomes a space.
_TO_WORDS = np.array([c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after another, and where each text's words begin (one entry more than texts)."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    first, last = int(offsets[0]), int(offsets[-1])
    data = _TO_WORDS[np.frombuffer(texts.buffers()[2], np.uint8)[first:last]] if last > first else np.empty(0, np.uint8)
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - first)), pa.py_buffer(data)])
    split = pc.ascii_split_whitespace(plain)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end of a text leaves an empty piece
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[split.offsets.to_numpy()]


def numbered(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Places of words in the vocabulary; -1 for others."""
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Index:
    """Windows by prefix token: the rarest word of each in the corpus, which a containing document must have."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, rank: np.ndarray, window: int):
        """``words``: the items' words as numbers one after another, ``ends``: item k's are ends[k] to ends[k + 1];
        ``rank``: the words' order from rare to frequent, ties by the words themselves."""
        length = np.diff(ends)
        many = np.where(length > 0, np.maximum(1, length - window + 1), 0)
        owner = np.repeat(np.arange(len(length)), many)
        start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[:-1], many)
        size = np.minimum(length[owner], window)
        self.stream = np.append(words, np.full(window, -2)).astype(np.int32)  # no word; so that reading on is safe
        block = self.stream[start[:, None] + np.arange(window)]
        block[np.arange(window) >= size[:, None]] = -2
        # Equal windows are one, with all items that hold it.
        order = np.lexsort(block.T[::-1])
        fresh = np.append(True, (block[order][1:] != block[order][:-1]).any(1)) if len(order) else np.empty(0, bool)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        one = order[fresh]
        pairs = np.unique(np.stack([group, owner], 1), axis=0)
        block, self.size = block[one], size[one].astype(np.int32)
        ranks = np.where(block >= 0, rank[block], np.iinfo(np.int64).max)
        self.at = ranks.argmin(1).astype(np.int32) if len(one) else np.empty(0, np.int32)
        token = block[np.arange(len(one)), self.at] if len(one) else np.empty(0, np.int32)
        by_token = np.argsort(token, kind="stable")
        back = np.empty(len(one), np.int64)
        back[by_token] = np.arange(len(one))
        self.start, self.size, self.at = start[one][by_token].astype(np.int32), self.size[by_token], self.at[by_token]
        self.first = np.searchsorted(token[by_token], np.arange(len(rank) + 1)).astype(np.int32)
        pairs[:, 0] = back[pairs[:, 0]]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.owners, self.owners_at = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)).astype(np.int32)

    def hits(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (first word) and windows that stand there, in some order: position and length bounds, then equality.

        ``words``: numbers of the texts' words one after another; ``starts``: where each text begins, and the end."""
        known = np.flatnonzero(words >= 0)
        known = known[self.first[words[known] + 1] > self.first[words[known]]]
        text = np.searchsorted(starts, known, "right") - 1
        low, high = starts[text], starts[text + 1]
        lists = self.first[words[known]], self.first[words[known] + 1]
        total = np.cumsum(lists[1] - lists[0], dtype=np.int64)
        begin = 0
        while begin < len(known):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            for shift in range(0, int((lists[1][begin:end] - lists[0][begin:end]).max()), PAIRS):  # one word may begin very many windows
                counts = np.clip(lists[1][begin:end] - lists[0][begin:end] - shift, 0, PAIRS)
                which = np.repeat(np.arange(begin, end), counts)
                window = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + lists[0][which] + shift
                place = known[which] - self.at[window]
                fits = (place >= low[which]) & (place + self.size[window] <= high[which])
                place, window = place[fits], window[fits]
                for k in range(int(self.size.max())):
                    inside = k < self.size[window]
                    same = ~inside | (words[np.where(inside, place + k, 0)] == self.stream[self.start[window] + k])
                    place, window = place[same], window[same]
                yield place, window
            begin = end


def _blocks(items: DataFrame, words: int) -> Iterator[tuple[list[str], pa.Array]]:
    """The benchmark as names and texts, in runs of at most so many words but for one item, streamed partition by partition."""
    names, texts, held = [], [], 0
    for row in items.toLocalIterator():
        size = len((row[1] or "").split()) + 1
        if names and held + size > words:
            yield names, pa.array(texts, pa.string())
            names, texts, held = [], [], 0
        names.append("" if row[0] is None else str(row[0]))
        texts.append(row[1])
        held += size
    if names:
        yield names, pa.array(texts, pa.string())


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique([0, *np.searchsorted(sizes, np.arange(BATCH_CHARS, sizes[-1] if len(sizes) else 0, BATCH_CHARS)), batch.num_rows])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def _corpus_counts(docs: DataFrame, text_col: str, vocabulary: pa.Array) -> np.ndarray:
    """How often each benchmark word stands in all documents; the result has the benchmark's words at most."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for piece in _pieces(batch, 0):
                total += np.bincount(numbered(words_of(piece.column(0))[0], known) + 1, minlength=len(total))
        at = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1:][at])], ["k", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    for r in docs.select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.k] = r.n
    return counts


def benchmark_blocks(docs: DataFrame, items: DataFrame, text_col: str, window: int, block_words: int) -> tuple[pa.Array, list[Broadcast]]:
    """The benchmark's vocabulary, and an index of each block with its items' names, as broadcasts of a bounded size."""
    spark = docs.sparkSession
    vocabulary = pa.array([], pa.string())
    for _, texts in _blocks(items, block_words):
        vocabulary = pc.unique(pa.concat_arrays([vocabulary, pc.unique(words_of(texts)[0])]))
    vocabulary = vocabulary.take(pc.array_sort_indices(vocabulary))
    if not len(vocabulary):
        return vocabulary, []
    counts = _corpus_counts(docs, text_col, vocabulary)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(vocabulary))
    out = []
    for names, texts in _blocks(items, block_words):
        words, ends = words_of(texts)
        out.append(spark.sparkContext.broadcast((Index(numbered(words, vocabulary), ends, rank, window), names)))
    return vocabulary, out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Where benchmark windows stand in documents: all columns of ``docs`` (or ``carry``) besides clashing ones, plus
    ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items``, ``items`` (ids as strings, sorted as strings),
    ``hit_spans`` (merged [start, end) word spans) and ``contaminated``.

    Null and empty texts have no words and no hits; items without words match nothing; items sharing an id count once;
    items with a null id count under the empty string. Every row of ``docs`` is returned once, repeated rows too.
    The documents are read twice, once for the counts of benchmark words and once to be matched, whatever the size of the
    benchmark: its blocks are broadcast one by one, a worker goes through them for each batch of texts and holds one
    at a time. Nothing is shuffled but counts, and nothing is written.
    """
    spark = docs.sparkSession
    own = ["n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated"]
    base = docs.drop(*own)
    columns = base.columns if carry is None else [c for c in carry if c not in own]
    base = base if carry is None else base.select(*dict.fromkeys([*columns, text_col]))
    vocabulary, blocks = benchmark_blocks(base, items.select(item_col, item_text), text_col, window, block_words)
    shared = spark.sparkContext.broadcast(vocabulary)
    place = base.columns.index(text_col)
    kept = [base.columns.index(c) for c in columns]

    def match(texts: pa.Array) -> list[pa.Array]:
        words, starts = words_of(texts)
        ids = numbered(words, shared.value) if blocks else np.empty(0, np.int64)
        edge = np.zeros(len(words) + 1, np.int64)
        found: list[set[str]] = [set() for _ in range(len(texts))]
        for block in blocks:
            index, names = block.value
            for at, windows in index.hits(ids, starts):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + index.size[windows], -1)
                text = np.searchsorted(starts, at, "right") - 1
                for t, w in np.unique(np.stack([text, windows], 1), axis=0).tolist():
                    found[t].update(names[k] for k in index.owners[index.owners_at[w] : index.owners_at[w + 1]].tolist())
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # read again for the next batch
        covered = np.cumsum(edge)[:-1] > 0
        # A gap after each text keeps a run of hit words from going on into the next text.
        lengths = np.diff(starts)
        text_of = np.repeat(np.arange(len(texts)), lengths)
        spaced = np.zeros(len(covered) + len(texts) + 1, np.int8)
        spaced[np.arange(len(covered)) + text_of + 1] = covered
        turns = np.flatnonzero(np.diff(spaced))
        begins, stops = turns[::2], turns[1::2]
        # Word w of text t stands at w + t + 1 in spaced, and so turns at w + t.
        owner = np.searchsorted(starts[1:] + np.arange(len(texts)), begins, "right") if len(texts) else begins
        shift = starts[:-1][owner] + owner if len(begins) else begins
        spans = pa.StructArray.from_arrays([pa.array((begins - shift).astype(np.int32)), pa.array((stops - shift).astype(np.int32))], ["start", "end"])
        per_text = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
        n_hit = np.bincount(text_of, covered, len(texts)).astype(np.int64)
        listed = [sorted(x) for x in found]
        return [pa.array(lengths.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(per_text), spans), pa.array(n_hit > 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, place):
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in kept), *match(piece.column(place))], [*columns, *own])

    schema = base.select(*columns).selectExpr(*(f"`{c}`" for c in columns), "0L as n_words", "0L as n_hit", "0L as n_items", "cast(array() as array<string>) as items", "cast(array() as array<struct<start:int,end:int>>) as hit_spans", "true as contaminated").schema
    return base.mapInArrow(run, schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, by 10-word windows of ``benchmark``."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op5_decontaminate": op5_decontaminate}
