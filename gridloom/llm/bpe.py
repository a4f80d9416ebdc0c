"""Byte-level BPE encoding and decoding by ranked merges over the bytes of distinct words."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct words a Python worker remembers; more only cost their merges anew, results do not depend on it.
WORDS_KEPT = 300_000
#: Characters of text whose distinct words are folded together.
BATCH_CHARS = 4 << 20
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file: one base64 piece and its rank on a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def merge_pieces(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Fold merges over a word's bytes: the lowest-ranked adjacent pair first, the leftmost of equals."""
    if word in ranks:
        return (ranks[word],)
    if len(word) > 48:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    scores = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(scores):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return tuple(ranks[p] for p in parts)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del scores[at]
        if at:
            scores[at - 1] = get(parts[at - 1] + parts[at])
        if at < len(scores):
            scores[at] = get(parts[at] + parts[at + 1])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same fold with a heap over a linked list, for words whose length would make the plain scan quadratic."""
    n = len(word)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if ends[i] < n:
            stop = ends[ends[i]]
            if (r := ranks.get(word[i:stop])) is not None:
                heapq.heappush(heap, (r, i, stop))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != stop:
            continue
        gone = ends[i]
        alive[gone] = False
        ends[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[word[i : ends[i]]] for i in range(n) if alive[i])


class MergeTable:
    """Ranks of adjacent pairs as an open-addressed table, and the fold over all distinct words of a batch at once."""

    NONE = np.iinfo(np.int32).max
    LONGEST = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = {(ranks[p[:k]] << 32 | ranks[p[k:]]): r for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.mask = (1 << max(4, int(len(pairs) * 4).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, self.NONE, np.int32)
        place = self._slot(keys)
        while len(keys):
            free = self.keys[place] == -1
            _, first = np.unique(place, return_index=True)
            put = first[free[first]]
            self.keys[place[put]], self.values[place[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, place = keys[rest], values[rest], (place[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        place = self._slot(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.values[place], self.NONE)
        far = np.flatnonzero((there != keys) & (there != -1))
        while len(far):
            place[far] = (place[far] + 1) & self.mask
            there = self.keys[place[far]]
            same = there == keys[far]
            out[far[same]] = self.values[place[far[same]]]
            far = far[~same & (there != -1)]
        return out

    def fold(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each word: one merge a round in every unfinished word, the lowest rank first, the leftmost of equals."""
        out: dict[str, tuple[int, ...]] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for word in words:
            raw = word.encode()
            if raw in self.ranks:
                out[word] = (self.ranks[raw],)
            elif len(raw) > self.LONGEST:
                out[word] = _merge_long(raw, self.ranks)
            else:
                by_length[len(raw)].append((word, raw))
        for width, some in by_length.items():
            ids = self.of_byte[np.frombuffer(b"".join(raw for _, raw in some), np.uint8).reshape(-1, width)]
            names = np.arange(len(some))
            scores = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
            while len(names):
                at = scores.argmin(1) if scores.shape[1] else np.zeros(len(names), np.int64)
                best = np.take_along_axis(scores, at[:, None], 1)[:, 0] if scores.shape[1] else np.full(len(names), self.NONE, np.int32)
                live = best < self.NONE
                for k, found in zip(names[~live].tolist(), ids[~live].tolist(), strict=True):
                    out[some[k][0]] = tuple(found)
                names, ids, scores, at, best = names[live], ids[live], scores[live], at[live], best[live]
                if not len(names):
                    break
                spot, row = at[:, None], np.arange(len(names))
                column = np.arange(ids.shape[1] - 1)[None, :]
                ids = np.take_along_axis(ids, column + (column > spot), 1)
                ids[row, at] = best
                column = np.arange(scores.shape[1] - 1)[None, :]
                scores = np.take_along_axis(scores, column + (column >= spot), 1)
                has = at > 0
                scores[row[has], at[has] - 1] = self.rank(ids[row[has], at[has] - 1], best[has])
                has = at < scores.shape[1]
                scores[row[has], at[has]] = self.rank(best[has], ids[row[has], at[has] + 1])
        return out


#: Characters for which the classes of the fast pattern below are those of the full one.
_PLAIN = r"\t-\r -~\u00a1\u00ab\u00bb\u00bf\u00c0-\u024f\u2010-\u2027\u20a0-\u20bf"
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SPACE = r"\t-\r "


class Splitter:
    """Pre-tokens of public_tokenizers.PATTERN; texts of plain characters go through the same pattern with short classes."""

    def __init__(self):
        self.full = regex.compile(public_tokenizers.PATTERN).findall
        self.fast = re.compile(f" ?[{_LETTER}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}0-9{_LETTER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall
        self.odd = re.compile(f"[^{_PLAIN}]").search

    def __call__(self, text: str) -> list[str]:
        return self.full(text) if self.odd(text) else self.fast(text)


class Codec:
    """Word -> ids of the distinct words met so far; encodes and decodes whole texts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table, self.split = MergeTable(ranks), Splitter()
        self.piece = {rank: piece for piece, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.piece}
        #: Word -> (ids, their digits with spaces, the bytes that the ids decode to).
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def words(self, texts: list[str]) -> Iterator[list[tuple[tuple[int, ...], str, bytes]]]:
        """For each text, its words' ids, encoded and decoded once a distinct word."""
        words = [self.split(t) for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        known, digits = self.known, self.digits.__getitem__
        for word, ids in self.table.fold([w for w in set(chain.from_iterable(words)) if w not in known]).items():
            known[word] = (ids, " ".join(map(digits, ids)), self.decode(ids))
        for some in words:
            yield list(map(known.__getitem__, some))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for some in self.words(texts):
            yield list(chain.from_iterable(x[0] for x in some))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))


_codec: tuple[object, Codec] | None = None


def _worker_codec(shared) -> Codec:
    """One codec a Python worker and broadcast, kept between tasks."""
    global _codec
    if _codec is None or _codec[0] != shared.value["name"]:
        _codec = (shared.value["name"], Codec(shared.value["ranks"]))
    return _codec[1]


def encode_decode(docs: DataFrame, path: str, outputs: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: the id column plus the chosen ``OUTPUTS``.

    A null or empty text has no tokens and decodes to no bytes. Rows are returned one for one, repeated rows too.
    There is no shuffle; memory is one Arrow batch, the vocabulary (a file of fixed size, broadcast) and WORDS_KEPT words.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"name": path, "ranks": read_ranks(path)})
    names = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles; scanning the known words again and again costs a fifth
        codec = _worker_codec(shared)
        for whole in batches:
            sizes = np.cumsum(np.fromiter((len(x.as_py() or "") for x in whole.column(1)), np.int64, whole.num_rows))
            cuts = np.unique([0, *np.searchsorted(sizes, np.arange(BATCH_CHARS, sizes[-1] if len(sizes) else 0, BATCH_CHARS)), whole.num_rows])
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                batch = whole.slice(start, stop - start)
                made: dict[str, list] = {name: [] for name in names}
                for some in codec.words([x.as_py() or "" for x in batch.column(1)]):
                    for name in names:
                        made[name].append(
                            sum(len(x[0]) for x in some) if name == "n_tokens"
                            else list(chain.from_iterable(x[0] for x in some)) if name == "ids"
                            else b"".join([x[2] for x in some]) if name == "decoded"
                            else hashlib.sha256(" ".join([x[1] for x in some]).encode()).hexdigest() if name == "ids_sha256"
                            else hashlib.sha256(b"".join([x[2] for x in some])).hexdigest()
                        )
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[n], _ARROW[n]) for n in names)], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} {OUTPUTS[n]}" for n in names)]))


def fold_words_native(words: DataFrame, path: str, word_col: str = "word", buckets: int = 1 << 16) -> DataFrame:
    """The fold as Spark expressions: all columns plus ``ids``, for a table of distinct words.

    The rank map is one literal (JSON folded at planning), an array of hash buckets, since a lookup in a Spark map scans
    its keys. Each step of an aggregate() over the word's bytes merges the best pair. See the README for its cost, which
    is why ``encode_decode`` folds in numpy. A null or empty word has no ids.
    """
    spark = words.sparkSession
    ranks = [(piece.hex(), rank) for piece, rank in read_ranks(path).items()]
    hashed = spark.createDataFrame(ranks, "p string, r int").select("p", "r", F.pmod(F.hash("p"), F.lit(buckets)).alias("b")).collect()
    table_: list[list[dict]] = [[] for _ in range(buckets)]
    for row in hashed:  # a vocabulary file's rows
        table_[row.b].append({"p": row.p, "r": row.r})
    literal = F.from_json(F.lit(json.dumps(table_, separators=(",", ":"))), F.lit("array<array<struct<p:string,r:int>>>"))

    def rank(piece: Column) -> Column:
        there = F.get(literal, F.pmod(F.hash(piece), F.lit(buckets)))
        return F.get(F.filter(there, lambda x: x["p"] == piece), F.lit(0))["r"]

    def merged(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: F.struct(F.coalesce(rank(F.concat(x, F.get(parts, i + 1))), F.lit(1 << 30)).alias("r"), i.alias("i")))
        best = F.array_min(pairs)
        done = F.concat(F.slice(parts, F.lit(1), best["i"]), F.array(F.concat(F.get(parts, best["i"]), F.get(parts, best["i"] + 1))), F.slice(parts, best["i"] + 3, F.size(parts)))
        return F.when(best["r"] < 1 << 30, done).otherwise(parts)

    raw = F.lower(F.hex(F.encode(F.col(word_col), "UTF-8")))
    size = F.length(raw) / 2
    bytes_ = F.when(size > 0, F.transform(F.sequence(F.lit(1), size.cast("int")), lambda k: F.substring(raw, k * 2 - 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size.cast("int"), F.lit(1))), bytes_, merged)
    return words.withColumn("ids", F.transform(folded, rank))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256 (null: empty text)."""
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), ["n_tokens", "ids_sha256", "decoded_sha256"])


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
