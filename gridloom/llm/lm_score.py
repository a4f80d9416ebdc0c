"""LM scoring by a hierarchical Pitman-Yor model: a restaurant for each word before; those of a class share a parent."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW, Scratch, partitions, table, whole_groups

SEED = 3
#: Every distinct word has a restaurant of its own for what follows it. Those of the words of one fine class share a
#: parent, FAN fine classes share each of the COARSE ones, and these share the root.
COARSE, FAN = 64, 16
FINE = COARSE * FAN
DISCOUNT = {"word": 0.75, "fine": 0.75, "coarse": 0.75, "root": 0.5}
STRENGTH = {"word": 1.0, "fine": 1.0, "coarse": 1.0, "root": 1.0}
#: Sweeps before sampling, and samples whose predictive probabilities are averaged.
BURN_IN, SAMPLES, ROUNDS = 2, 3, 2
#: The end of a text as a token; no word is empty. It also stands before a text's first word.
END = b""
#: Share of the base measure that unseen words have together; the known types share the rest equally.
UNSEEN = 0.5
BATCH_CHARS = 6 << 20
#: Tokens for each bucket of words: the number of buckets follows the corpus alone, so a bucket is what bounds a task's
#: memory, and the seats drawn do not depend on how many partitions there are or where rows lie.
BUCKET_TOKENS = 1 << 19
#: Share of all tokens (and part of a bucket) from which a word counts as hot: at most 4,000 words, whose probabilities in
#: all classes are 33 MB at most. A hot word's pairs are dealt over all buckets, so that no bucket follows one word.
HOT_SHARE, HOT_PART = 2.5e-4, 64
#: Pairs of one word listed together at most, and a pair's occurrences in a batch from which they are listed apart, so that
#: both are a byte.
RUN, BIG = 255, 127
#: Customers up to which the weights of all seatings are tabled one by one, the largest tabled, and most tables in a row.
EXACT, LARGEST, MOST_TABLES = 64, 1 << 14, 1024
#: Buckets whose words' restaurants are added up together, and parts in which sums for the driver are added up.
HOME_BUCKETS, SLICES = 8, 64
#: Passes in which texts are scored, each over its share of the buckets, so that not all pairs are on disk at once with their answers.
PASSES = 2


def context_class(word: bytes) -> int:
    """Fine class of a word, the parent of its restaurant: its coarse class (two last bytes) and a part from its last four."""
    return zlib.crc32(word[-2:]) % COARSE * FAN + (zlib.crc32(word[-4:]) >> 8) % FAN


@cache
def log_seatings(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the weights of all ways to seat c customers at t tables (generalised Stirling numbers): the c that
    have a row (all up to EXACT, then 5 % apart up to LARGEST), and the rows by t up to MOST_TABLES."""
    sizes, rows = [], []
    row = np.full(MOST_TABLES + 1, -np.inf)
    row[1] = 0.0
    t = np.arange(MOST_TABLES + 1)
    for c in range(1, LARGEST + 1):
        if c <= EXACT or c >= 1.05 * sizes[-1]:
            sizes.append(c)
            rows.append(row - row[1])
        top = min(c + 1, MOST_TABLES) + 1
        with np.errstate(divide="ignore"):
            stay = row[1:top] + np.log(np.maximum(c - discount * t[1:top], 0))
        row[1:top] = np.logaddexp(row[: top - 1], stay)
    return np.array(sizes), np.stack(rows)


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A blocked Gibbs step: all customers of a dish leave their tables and sit down anew, given everything else.

    A new table weighs ``mass`` (the restaurant's strength and tables times the parent's probability), a taken one its
    customers less the discount; so t tables of c customers have probability in proportion to mass^t times the weight
    of all seatings of c at t, from which t is drawn. That weight is exact up to EXACT customers and that of the nearest
    tabled c beyond. Where far more tables than tabled ones are likely, t is drawn from its limit for many customers,
    1 + Poisson(mass / discount)."""
    tables = (customers > 0).astype(np.int64)
    sizes, ways = log_seatings(discount)
    many = np.flatnonzero(customers > 1)
    mean = mass[many] / discount
    far = (mean > MOST_TABLES / 4) & (customers[many] > MOST_TABLES)
    tables[many[far]] = np.minimum(1 + rng.poisson(mean[far]), customers[many[far]])
    many, mean = many[~far], mean[~far]
    up = np.minimum(np.searchsorted(sizes, customers[many]), len(sizes) - 1)
    row = up - (customers[many] * 2 < sizes[up] + sizes[np.maximum(up - 1, 0)])  # the nearest
    width = np.minimum(np.minimum(customers[many], MOST_TABLES), (2 * mean + 40)).astype(np.int64)
    order = np.argsort(width, kind="stable")
    k = 0
    while k < len(order):
        some = order[k : k + max(1, (1 << 19) // int(width[order[min(k + 4096, len(order) - 1)]]))][:4096]
        n = int(width[some[-1]])
        weight = ways[row[some], 1 : n + 1] + np.log(mass[many[some]])[:, None] * np.arange(1, n + 1)
        weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
        tables[many[some]] = 1 + (weight < (rng.random(len(some)) * weight[:, -1])[:, None]).sum(1)
        k += len(some)
    return np.minimum(tables, customers)


class Counts:
    """Customers of one bucket's words in the classes' restaurants: entries (word, fine class, count), ordered by both."""

    def __init__(self, words: int, key: np.ndarray, count: np.ndarray):
        """``key`` is word * FINE + context, distinct and in order, ``count`` its customers, at least one."""
        self.key = key
        self.words, self.word, self.fine = words, key // FINE, key % FINE
        pair = self.word * COARSE + self.fine // FAN  # in order too
        new = np.diff(pair, prepend=-1) != 0
        self.pairs, self.pair_of = pair[new], np.cumsum(new) - 1
        self.recount(count)

    def recount(self, count: np.ndarray) -> None:
        """Other numbers of customers in the same places."""
        self.count = count
        self.total = np.bincount(self.word, count, self.words).astype(np.int64)

    def sample(self, tables: dict[str, np.ndarray], customers: np.ndarray, known: int, rng: np.random.Generator, rounds: int = ROUNDS, before: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """Seat every customer anew, given all restaurants' table totals of the last sweep, bottom up, ``rounds`` times over,
        the first time by the parents of what sat there ``before``.

        What sits in a restaurant is sent up as one customer a table."""
        fine_mass, coarse_mass, root_mass = _masses(tables)
        base = (1 - UNSEEN) / max(known, 1)
        word_of_pair, coarse_of_pair = self.pairs // COARSE, self.pairs % COARSE
        root = np.maximum(self.total, 1) / max(customers.sum(), 1)
        pair = root[word_of_pair]
        if before:
            root, pair = self.parents(before, tables, known)
        for number in range(rounds):
            fine_tables = seat(self.count, fine_mass[self.fine] * pair[self.pair_of], DISCOUNT["fine"], rng)
            pair_customers = np.bincount(self.pair_of, fine_tables, len(self.pairs)).astype(np.int64)
            pair_tables = seat(pair_customers, coarse_mass[coarse_of_pair] * root[word_of_pair], DISCOUNT["coarse"], rng)
            word_customers = np.bincount(word_of_pair, pair_tables, self.words).astype(np.int64)
            word_tables = seat(word_customers, np.full(self.words, root_mass * base), DISCOUNT["root"], rng)
            got = {"fine": fine_tables, "pair_customers": pair_customers, "coarse": pair_tables, "word_customers": word_customers, "root": word_tables}
            if number + 1 < rounds:
                root, pair = self.parents(got, tables, known)
        return got

    def parents(self, got: dict[str, np.ndarray], tables: dict[str, np.ndarray], known: int) -> tuple[np.ndarray, np.ndarray]:
        """Predictive probabilities of each word at the root, and of each (word, coarse context) that holds it."""
        _, coarse_mass, root_mass = _masses(tables)
        coarse_customers = tables["fine"].reshape(COARSE, FAN).sum(1)
        word_of_pair, coarse_of_pair = self.pairs // COARSE, self.pairs % COARSE
        root = np.where(got["word_customers"] > 0, got["word_customers"] - DISCOUNT["root"] * got["root"], 0)
        root = (root + root_mass * np.where(self.total > 0, (1 - UNSEEN) / max(known, 1), UNSEEN)) / (STRENGTH["root"] + tables["coarse"].sum())
        pair = got["pair_customers"] - DISCOUNT["coarse"] * got["coarse"] + coarse_mass[coarse_of_pair] * root[word_of_pair]
        return root, pair / (STRENGTH["coarse"] + coarse_customers[coarse_of_pair])

    def totals(self, got: dict[str, np.ndarray]) -> np.ndarray:
        """Tables in every restaurant that this bucket's words sit at: fine, coarse, root."""
        return np.concatenate([np.bincount(self.fine, got["fine"], FINE), np.bincount(self.pairs % COARSE, got["coarse"], COARSE), [got["root"].sum()]])

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where keys (word * FINE + context) and their coarse pairs stand among those that hold customers, and whether."""
        def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

        word, fine = wanted // FINE, wanted % FINE
        return word, fine, *lookup(self.pairs, word * COARSE + fine // FAN), *lookup(self.key, wanted)

    def predict(self, got: dict[str, np.ndarray], tables: dict[str, np.ndarray], customers: np.ndarray, known: int, places: tuple[np.ndarray, ...]) -> np.ndarray:
        """Probability of each key of ``places`` under one sample, ``tables`` being that sample's own totals, so that
        every restaurant's probabilities sum to one; words a restaurant does not hold back off to its parents."""
        word, fine, pair_at, pair_there, at, there = places
        fine_mass, coarse_mass, _ = _masses(tables)
        root, pair = self.parents(got, tables, known)
        p = (coarse_mass / (STRENGTH["coarse"] + tables["fine"].reshape(COARSE, FAN).sum(1)))[fine // FAN] * root[word]
        p[pair_there] = pair[pair_at[pair_there]]
        p *= (fine_mass / (STRENGTH["fine"] + customers))[fine]
        at = at[there]
        p[there] += (self.count[at] - DISCOUNT["fine"] * got["fine"][at]) / (STRENGTH["fine"] + customers[fine[there]])
        return p


def _masses(tables: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights with which restaurants open a new table: fine, coarse, root."""
    return (STRENGTH["fine"] + DISCOUNT["fine"] * tables["fine"], STRENGTH["coarse"] + DISCOUNT["coarse"] * tables["coarse"], STRENGTH["root"] + DISCOUNT["root"] * tables["root"][0])


def _split_totals(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {"fine": flat[:FINE], "coarse": flat[FINE : FINE + COARSE], "root": flat[FINE + COARSE :]}


def tokenise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens of texts one after another as numbers, tokens a text, and the distinct words by number; the last is END."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end of a text leaves an empty piece
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    lengths = np.diff(before[split.offsets.to_numpy()])
    found = flat.filter(full).dictionary_encode()
    words = pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
    return np.insert(found.indices.to_numpy().astype(np.int64), np.cumsum(lengths), len(words) - 1), lengths + 1, words


#: What CRC-32 adds for each byte; crc32 of a byte b takes the entry at b ^ 255.
_CRC = np.array([~zlib.crc32(bytes([k ^ 255])) & 0xFFFFFFFF ^ 0x00FFFFFF for k in range(256)], np.uint32)


def _crc_of_ends(text: np.ndarray, stops: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """zlib.crc32 of the last ``most`` bytes, or all, of words that end before ``stops`` in ``text``."""
    crc = np.full(len(stops), 0xFFFFFFFF, np.uint32)
    for back in range(most, 0, -1):
        there = sizes >= back
        byte = text[np.where(there, stops - back, 0)]
        crc = np.where(there, _CRC[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8)), crc)
    return ~crc


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers by which words are told apart: 54 bits of a hash over the word's class, which follows from its last four bytes."""
    found = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    text, stops = np.frombuffer(b"".join(words) + b"\0", np.uint8), np.cumsum(sizes)
    coarse, fine = _crc_of_ends(text, stops, sizes, 2), _crc_of_ends(text, stops, sizes, 4)
    return found - found % np.uint64(FINE) + coarse % np.uint32(COARSE) * np.uint64(FAN) + (fine >> np.uint32(8)) % np.uint32(FAN)


def _index(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each of ``ids`` among the others, -1 where it is none of them."""
    if not len(sorted_ids):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return np.where(sorted_ids[at] == ids, at, -1)


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Rows of bytes: those of ``values`` between each two neighbours of ``cuts``."""
    width = values.dtype.itemsize * int(np.prod(values.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """All rows of bytes one after another, as numbers."""
    found = [np.zeros(0, np.uint8)]
    for chunk in column.chunks:
        if len(chunk) and chunk.buffers()[2] is not None:
            cuts = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            found.append(np.frombuffer(chunk.buffers()[2], np.uint8)[cuts[0] : cuts[-1]])
    return np.concatenate(found).view(kind)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Each value of ``key`` with its rows, from batches sorted by it."""
    for group in whole_groups(batches, key, 1):
        column = group.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(column[lo]), group.slice(lo, hi - lo)


def _token_table(docs: DataFrame, kind: str) -> DataFrame:
    """Texts in batches: a row with ids, lengths, which are held out, the distinct words' numbers, most frequent first, how
    often each stands in all and in training texts, and all tokens as places among them, byte by byte of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.unique([0, *np.searchsorted(sizes, np.arange(BATCH_CHARS, sizes[-1] if len(sizes) else 0, BATCH_CHARS)), whole.num_rows])
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                batch = whole.slice(start, stop - start)
                held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                tokens, lengths, words = tokenise(batch.column(1))
                each = np.bincount(tokens, minlength=len(words))
                order = np.argsort(-each, kind="stable")
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                learnt = np.bincount(tokens[~np.repeat(held, lengths)], minlength=len(words))
                values = lengths.astype("<u4"), held.astype(np.uint8), word_ids(words.to_pylist())[order].astype("<u8"), np.stack([each, learnt])[:, order].astype("<u4"), rank[tokens].astype("<u4").view(np.uint8).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)), *(pa.array([x.tobytes()]) for x in values)], ["batch", "ids", "lengths", "held", "words", "each", "tokens"])
                number += 1

    return docs.mapInArrow(run, f"batch long, ids array<{kind}>, lengths binary, held binary, words binary, each binary, tokens binary")


def hot_words(scratch: Scratch, tokens: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Numbers of all and of training tokens; hot words, in order of their numbers, and how often each stands in training texts.

    A hot word has the share of all tokens in at least one batch, and only words that have it in one are counted in all:
    which words are hot does not depend on how texts lie in batches."""

    def counts(words: bytes, each: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(words, "<u8"), np.frombuffer(each, "<u4").reshape(2, -1).astype(np.int64)

    def row(words: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(x) for x in numbers)], ["word", "n", "learnt"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, numbers = counts(*x)
                often = numbers[0] >= HOT_SHARE * numbers[0].sum()
                # the batch's sums go with word null
                yield pa.RecordBatch.from_arrays([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), *(pa.array([int(k.sum()), *[0] * int(often.sum())]) for k in numbers)], ["word", "n", "learnt"])

    each, schema = tokens.select("words", "each"), "word long, n long, learnt long"
    found = scratch.keep(each.mapInArrow(propose, schema).groupBy("word").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")), NARROW)
    sums = found.where("word is null").first()
    total, trained = (sums.n, sums.learnt) if sums else (0, 0)
    some = np.sort(np.array([r[0] for r in found.where("word is not null").select("word").collect()], np.int64).view(np.uint64))
    shared = tokens.sparkSession.sparkContext.broadcast(some)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = shared.value
        sums = np.zeros((2, len(some)), np.int64)
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, numbers = counts(*x)
                at = _index(some, words)
                for k in (0, 1):
                    np.add.at(sums[k], at[at >= 0], numbers[k][at >= 0])
        yield row(some, sums)

    exact = each.mapInArrow(count, schema).groupBy("word").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt"))
    rows = exact.where(F.col("n") >= max(HOT_SHARE * total, BUCKET_TOKENS // HOT_PART)).collect()
    hot, learnt = np.array([r.word for r in rows], np.int64).view(np.uint64), np.array([r.learnt for r in rows], np.int64)
    order = np.argsort(hot)
    return total, trained, hot[order], learnt[order]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with its inverse, of numbers from 0; faster where a number and its place fit 63 bits, as one sort does both."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    both = keys << bits | np.arange(len(keys))
    both.sort()
    ordered = both >> bits
    new = np.diff(ordered, prepend=-1) != 0
    back = np.empty(len(keys), np.int64)
    back[both & ((1 << bits) - 1)] = np.cumsum(new) - 1
    return ordered[new], back


class Pairs:
    """Distinct pairs (word, word before) of a batch in order of their bucket, the word (hot ones first), and the word before;
    ``of`` is each token's pair. A pair's bucket is that of its word, but the pairs of a hot word are dealt over all buckets.
    With ``share`` (k, n) only pairs in buckets that leave k when divided by n; ``of`` is then that of the tokens ``mine``."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, hot: np.ndarray, buckets: int, share: tuple[int, int] = (0, 1)):
        self.words, self.hot = words, _index(hot, words)
        end = np.flatnonzero(words == word_ids([END])[0])[:1]  # the word before a first word is the last text's END
        before = np.concatenate([end, tokens[:-1]])
        mixed, warm_words = words // np.uint64(FINE), self.hot >= 0
        dealt = (mixed % np.uint64(buckets)).astype(np.int64)

        def bucket_of(word: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, warm = dealt[word], warm_words[word]
            spread = (mixed[word[warm]] * np.uint64(0x9E3779B97F4A7C15)) ^ mixed[near[warm]]
            spread *= np.uint64(0xD6E8FEB86659FD93)
            found[warm] = ((spread ^ (spread >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)
            return found, warm

        self.mine = np.ones(len(tokens), bool)
        if share[1] > 1:
            self.mine = bucket_of(tokens, before)[0] % share[1] == share[0]
            tokens, before = tokens[self.mine], before[self.mine]
        keys, back = _distinct(tokens * len(words) + before)
        word, near = keys // len(words), keys % len(words)
        bucket, warm = bucket_of(word, near)
        order = np.argsort((2 * bucket + ~warm).astype(np.uint16 if buckets <= 1 << 15 else np.int64), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of, self.word, self.near, self.bucket = rank[back], word[order], near[order], bucket[order]
        #: Where a run of a word in a bucket begins (RUN pairs at most), whether its word is hot, and where another bucket begins.
        new = (np.diff(self.word, prepend=-1) != 0) | (np.diff(self.bucket, prepend=-1) != 0)
        self.starts = np.flatnonzero((np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % RUN == 0)
        self.warm = self.hot[self.word[self.starts]] >= 0
        self.cuts = np.append(np.flatnonzero(np.diff(self.bucket, prepend=-1)), len(order))


def _read_tokens(column: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(column, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _messages(tokens: DataFrame, hot: np.ndarray, buckets: int, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """A row for each batch and bucket (of the ``share``, as for Pairs): its runs' words (``warm``: hot ones, as places among the hot words; after them ``words``),
    how many pairs each has, the words before (``near``: hot ones, ``far``), and a byte ``n`` a pair: twice how often it stands in training
    texts (beyond BIG in ``big``), and one more if the word before is not hot."""
    shared = tokens.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        hot = shared.value
        for batch in batches:
            for number, lengths, held, words, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = Pairs(np.frombuffer(words, "<u8"), _read_tokens(ids), hot, buckets, share)
                learnt = np.repeat(np.frombuffer(held, np.uint8) == 0, np.frombuffer(lengths, "<u4"))[p.mine]
                n = np.bincount(p.of[learnt], minlength=len(p.word))
                cold, big = p.hot[p.near] < 0, n >= BIG

                def cuts(which: np.ndarray, at: np.ndarray) -> np.ndarray:
                    return np.concatenate([[0], np.cumsum(which)])[at]

                runs = np.searchsorted(p.starts, p.cuts)
                word, sizes = p.word[p.starts], np.diff(p.starts, append=len(p.word)).astype(np.uint8)
                columns = [
                    _packed(p.hot[word[p.warm]].astype("<u2"), cuts(p.warm, runs)),
                    _packed(p.words[word[~p.warm]], cuts(~p.warm, runs)),
                    _packed(sizes, runs),
                    _packed(p.hot[p.near[~cold]].astype("<u2"), cuts(~cold, p.cuts)),
                    _packed(p.words[p.near[cold]], cuts(cold, p.cuts)),
                    _packed((2 * np.minimum(n, BIG) + cold).astype(np.uint8), p.cuts),
                    _packed(n[big].astype("<u4"), cuts(big, p.cuts)),
                ]
                used = p.bucket[p.cuts[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), number)), *columns], ["bucket", "batch", "warm", "words", "sizes", "near", "far", "n", "big"])

    return tokens.select("batch", "lengths", "held", "words", "tokens").mapInArrow(run, "bucket long, batch long, warm binary, words binary, sizes binary, near binary, far binary, n binary, big binary")


class Leaves:
    """The restaurants of words at one bucket's dishes, below ``upper``, those of the classes.

    ``key`` (word * FINE + class of the word before) are the places in the classes' restaurants, ``once`` how many words of
    that class stand before the word just once: those have one table each, always. Pairs seen more often have a place
    ``at`` in ``key``, a number ``near`` for the word before and a ``count``. ``hot`` is each word's place among the hot words, or -1:
    a hot word's pairs lie in all buckets, so its classes' restaurants are sampled by the driver."""

    def __init__(self, hot: np.ndarray, key: np.ndarray, once: np.ndarray, at: np.ndarray, near: np.ndarray, count: np.ndarray):
        self.hot, self.key, self.once, self.at, self.near, self.count = hot, key, once, at, near, count
        self.cold = hot[key // FINE] < 0
        self.least = once + np.bincount(at, minlength=len(key))
        self.upper = Counts(len(hot), key[self.cold], self.least[self.cold])
        upper, every = self.upper, np.ones(len(self.upper.key), bool)
        self.places = upper.word, upper.fine, upper.pair_of, every, np.arange(len(every)), every  # of its own keys

    def sample(self, seated: np.ndarray, state: State, known: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Seat every customer anew, given the last sweep's tables of every restaurant (``seated``: of the words before):
        tables of the pairs seen more than once, customers of ``key``, and what sits in the classes' restaurants."""
        mass = STRENGTH["word"] + DISCOUNT["word"] * seated[self.near]
        word = self.key // FINE
        self.upper.recount(self.least[self.cold])
        p = (np.maximum(self.upper.total, 1) / max(state.customers.sum(), 1))[word]
        p[~self.cold] = state.warm[self.hot[word[~self.cold]], self.key[~self.cold] % FINE]
        got = None
        for _ in range(ROUNDS):
            if got:
                p[self.cold] = self.upper.predict(got, state.tables, state.customers, known, self.places)
            tables = seat(self.count, mass * p[self.at], DISCOUNT["word"], rng)
            customers = self.once + np.bincount(self.at, tables, len(self.key)).astype(np.int64)
            self.upper.recount(customers[self.cold])
            got = self.upper.sample(state.tables, state.customers, known, rng, 1, got)
        return tables, customers, got


class State:
    """What every bucket is given of a sweep: customers and tables of the classes' restaurants, tables of the hot words'
    own (``seated``), and the hot words' probabilities in every class (``warm``)."""

    def __init__(self, customers: np.ndarray, tables: dict[str, np.ndarray], seated: np.ndarray, warm: np.ndarray):
        self.customers, self.tables, self.seated, self.warm = customers, tables, seated, warm


class Bucket:
    """A bucket's words and words before in order of their numbers, its distinct pairs with training counts, and the pair
    of each pair that came from a batch (``back``), batch by batch."""

    def __init__(self, rows: pa.Table, hot: np.ndarray):
        #: Runs of words in each batch's row that are hot, and that are not.
        self.runs = (pc.binary_length(rows.column(k)).to_numpy() // size for k, size in (("warm", 2), ("words", 8)))
        self.runs = np.stack(list(self.runs), 1)
        cold = np.repeat(np.tile([False, True], len(self.runs)), self.runs.ravel())
        words = np.empty(len(cold), np.uint64)
        words[cold], words[~cold] = _flat(rows.column("words"), "<u8"), hot[_flat(rows.column("warm"), "<u2")]
        self.words, word = np.unique(words, return_inverse=True)
        self.cold_runs = word[cold]
        n = _flat(rows.column("n"), "<u1")
        self.pairs = pc.binary_length(rows.column("n")).to_numpy()
        cold, n = (n & 1).astype(bool), (n >> 1).astype(np.int64)
        n[n == BIG] = _flat(rows.column("big"), "<u4")
        before = np.empty(len(n), np.uint64)
        before[cold], before[~cold] = _flat(rows.column("far"), "<u8"), hot[_flat(rows.column("near"), "<u2")]
        self.befores, before = np.unique(before, return_inverse=True)
        keys, self.back = np.unique(np.repeat(word, _flat(rows.column("sizes"), "<u1")) * len(self.befores) + before, return_inverse=True)
        self.n = np.bincount(self.back, n, len(keys)).astype(np.int64)
        self.word, self.near = keys // len(self.befores), keys % len(self.befores)
        self.hot, self.hot_before = _index(hot, self.words), _index(hot, self.befores)
        self.total = np.bincount(self.word, self.n, len(self.words)).astype(np.int64)
        self.key = self.word * FINE + (self.befores % np.uint64(FINE)).astype(np.int64)[self.near]

    def leaves(self) -> tuple[Leaves, np.ndarray]:
        """The restaurants at these pairs, and which pairs stand more than once in training texts."""
        many = self.n > 1
        key, at = np.unique(self.key[self.n > 0], return_inverse=True)
        more = many[self.n > 0]
        return Leaves(self.hot, key, np.bincount(at[~more], minlength=len(key)), at[more], self.near[many], self.n[many]), many


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    return (ids // np.uint64(FINE) % np.uint64(homes)).astype(np.int64)


MESSAGE = "to long, bucket long, slot int, ask boolean, u binary, v binary"


def _post(bucket: int, slot: int, ask: bool, ids: np.ndarray, values: np.ndarray, homes: int) -> pa.RecordBatch:
    """Messages from a bucket to the homes of its words before, which are sorted by home."""
    home = _home(ids, homes)
    cuts = np.append(np.flatnonzero(np.diff(home, prepend=-1)), len(home))
    n = len(cuts) - 1
    columns = [pa.array(home[cuts[:-1]]), pa.array(np.full(n, bucket)), pa.array(np.full(n, slot, np.int32)), pa.array(np.full(n, ask)), _packed(ids.astype("<u8"), cuts), _packed(values.astype("<i4"), cuts)]
    return pa.RecordBatch.from_arrays(columns, ["to", "bucket", "slot", "ask", "u", "v"])


def _post_sums(sums: np.ndarray) -> pa.RecordBatch:
    """Messages with a task's sums for the driver; their ids are places in the driver's vector."""
    at = np.flatnonzero(sums)
    at = at[np.argsort(at % SLICES, kind="stable")]
    cuts = np.searchsorted(at % SLICES, np.arange(SLICES + 1))
    columns = [pa.array(-1 - np.arange(SLICES)), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int32()), pa.nulls(SLICES, pa.bool_()), _packed(at.astype("<u8"), cuts), _packed(sums[at].astype("<i8"), cuts)]
    return pa.RecordBatch.from_arrays(columns, ["to", "bucket", "slot", "ask", "u", "v"])


def _exchange(scratch: Scratch, messages: DataFrame, slots: dict[int, tuple[int, int]]) -> DataFrame:
    """Messages added up by word at its home, and the sums sent to the buckets that ask: rows (bucket, home, v), ``v`` for the
    asked ids in their order. ``slots``: the first column of each slot's values, and how many. Sums for the driver come in
    rows of negative buckets, with their ``u``."""
    width = max(first + many for first, many in slots.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        names = ["bucket", "home", "u", "v"]
        for to, rows in _groups(batches, "to"):
            ids, back = np.unique(_flat(rows.column("u"), "<u8"), return_inverse=True)
            if to < 0:
                sums = np.bincount(back, _flat(rows.column("v"), "<i8"), len(ids)).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([to]), pa.array([ids.tobytes()]), pa.array([sums.tobytes()])], names)
                continue
            lengths = pc.binary_length(rows.column("u")).to_numpy() // 8
            slot = rows.column("slot").to_numpy()
            sums = np.zeros((len(ids), width))
            for k, (first, many) in slots.items():
                mine = slot == k
                if mine.any():
                    values = _flat(rows.filter(pa.array(mine)).column("v"), "<i4").reshape(-1, many)
                    for j in range(many):
                        sums[:, first + j] += np.bincount(back[np.repeat(mine, lengths)], values[:, j], len(ids))
            ask = rows.column("ask").to_numpy()
            if ask.any():
                cuts = np.concatenate([[0], np.cumsum(lengths[ask])])
                answer = sums.astype("<i4")[back[np.repeat(ask, lengths)]]
                yield pa.RecordBatch.from_arrays([pa.array(rows.column("bucket").to_numpy()[ask]), pa.array(np.full(len(cuts) - 1, to)), pa.nulls(len(cuts) - 1, pa.binary()), _packed(answer, cuts)], names)

    n = partitions(messages.sparkSession)
    dealt = messages.repartition(n, "to").sortWithinPartitions("to", "bucket", "slot")
    return scratch.keep(dealt.mapInArrow(run, "bucket long, home long, u binary, v binary"))


def _with_answers(rows: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each bucket's rows (``part`` 0) and after them the answers it got, in order of home."""
    for part, answer in enumerate(answers, 1):
        rows = rows.unionByName(answer.where("bucket >= 0").select("bucket", F.lit(part).alias("part"), F.col("home").alias("batch"), "v"), allowMissingColumns=True)
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "part", "batch")


#: Places of the driver's vector: customers by fine class, tables (fine, coarse, root), words known; then hot words' own
#: tables, and their customers by fine class.
KNOWN = 2 * FINE + COARSE + 1


def _add(sums: np.ndarray, leaves: Leaves, customers: np.ndarray, tables: np.ndarray, warm: int) -> None:
    """Add a bucket's customers and tables of the classes' restaurants to the vector for the driver."""
    fine = leaves.key % FINE
    sums[:FINE] += np.bincount(fine[leaves.cold], customers[leaves.cold], FINE)
    sums[FINE:KNOWN] += tables
    hot = ~leaves.cold
    np.add.at(sums[KNOWN + 1 + warm :], leaves.hot[leaves.key[hot] // FINE] * FINE + fine[hot], customers[hot])


class Hot:
    """The classes' restaurants at the hot words' dishes, sampled by the driver: at most 1 / HOT_SHARE words in FINE classes."""

    def __init__(self, sums: np.ndarray):
        """``sums``: each hot word's customers by fine class."""
        self.parts = []
        for k in range(0, len(sums), 256):
            part = sums[k : k + 256].astype(np.int64)
            key = np.flatnonzero(part)
            self.parts.append(Counts(len(part), key, part.ravel()[key]))

    def sample(self, state: State, known: int, number: int) -> list[dict[str, np.ndarray]]:
        return [c.sample(state.tables, state.customers, known, np.random.default_rng([SEED, number, k, 1])) for k, c in enumerate(self.parts)]

    def totals(self, got: list[dict[str, np.ndarray]]) -> np.ndarray:
        return sum((c.totals(g) for c, g in zip(self.parts, got, strict=True)), np.zeros(FINE + COARSE + 1))

    def warm(self, got: list[dict[str, np.ndarray]], customers: np.ndarray, tables: dict[str, np.ndarray], known: int) -> np.ndarray:
        found = [c.predict(g, tables, customers, known, c.places(np.arange(c.words * FINE))).reshape(-1, FINE) for c, g in zip(self.parts, got, strict=True)]
        return np.concatenate([np.zeros((0, FINE)), *found])


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probabilities of whole texts: (id, n_tokens, n_known, base_score, score, train_tokens, perplexity).

    Lower-cases A-Z; tokens are words between ASCII white space and one end for each text, so null and empty texts
    score their end. Rows where ``held_out`` (null: false) is true are scored but not learnt from. Words never seen in
    training are one type, as in the base score. Every row is returned once. Without training texts all words are unseen.
    The same rows give the same scores whatever their partitions, but for the last digits of sums.

    Each distinct word before has a restaurant of its own; how many there are follows the corpus alone. A dish (word) with its seats
    in all restaurants sits in one bucket, that of a hot word by pairs in all buckets. A sweep is one pass over the buckets,
    given the tables of the last: those of the classes' restaurants and of hot words' own are a small vector, those of
    all other words' own are added up at the word's home and sent to the buckets that ask for them. The same seeds give the same seats
    when texts are scored, so nothing but totals is kept. Texts stay in batches of numbered tokens; a batch sends
    its distinct pairs to their buckets and gets their log10 probabilities back, as floats of 4 bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    tokens = scratch.keep(_token_table(source, kind))
    total, trained, hot, hot_total = hot_words(scratch, tokens)
    buckets = -(-total // BUCKET_TOKENS) or 1
    homes, warm = -(-buckets // HOME_BUCKETS), len(hot)
    shared_hot = spark.sparkContext.broadcast(hot)
    messages = _messages(tokens, hot, buckets)
    sizes = KNOWN + 1 + warm + warm * FINE

    def ordered(ids: np.ndarray) -> np.ndarray:
        """Places of ids, which are sorted, in order of home."""
        return np.argsort(_home(ids, homes), kind="stable")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        hot, sums = shared_hot.value, np.zeros(sizes)

        def sent(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.list_(pa.binary()))], [*batch.schema.names, "state"])

        for b, rows in _groups(batches, "bucket"):
            x = Bucket(rows, hot)
            leaves, many = x.leaves()
            upper = leaves.upper
            _add(sums, leaves, leaves.least, np.concatenate([np.bincount(upper.fine, minlength=FINE), np.bincount(upper.pairs % COARSE, minlength=COARSE), [(upper.total > 0).sum()]]), warm)
            sums[KNOWN] += (upper.total > 0).sum()
            each = np.bincount(x.near, x.n, len(x.befores)), np.bincount(x.near[x.n > 0], minlength=len(x.befores))
            own = x.hot_before >= 0
            sums[KNOWN + 1 + x.hot_before[own]] += each[1][own]
            cold = np.flatnonzero(~own)
            cold = cold[ordered(x.befores[cold])]
            yield sent(_post(b, 0, False, x.befores[cold], np.stack([k[cold] for k in each], 1), homes))
            # Words before that are asked for in sweeps: those of pairs that can have more than one table; hot ones stand last.
            asked = np.zeros(len(x.befores), bool)
            asked[leaves.near] = True
            cold = cold[asked[cold]]
            place = np.empty(len(x.befores), np.int64)
            place[cold] = np.arange(len(cold))
            own = np.flatnonzero(asked & own)
            place[own] = len(cold) + np.arange(len(own))
            yield sent(_post(b, 1, True, x.befores[cold], np.zeros((len(cold), 1)), homes))
            arrays = leaves.hot.astype("<i2"), leaves.key.astype("<i8"), leaves.once.astype("<u4"), leaves.at.astype("<u4"), place[leaves.near].astype("<u4"), leaves.count.astype("<i8"), x.befores[cold], x.hot_before[own].astype("<i2")
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([b]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([[k.tobytes() for k in arrays]], pa.list_(pa.binary()))], ["to", "bucket", "slot", "ask", "u", "v", "state"])
        yield sent(_post_sums(sums))

    dealt = messages.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "batch")
    counted = scratch.keep(dealt.mapInArrow(count, f"{MESSAGE}, state array<binary>"))
    names = ["to", "bucket", "slot", "ask", "u", "v"]
    firsts = _exchange(scratch, counted.where("to is not null").select(names), {0: (0, 2), 1: (2, 1)})

    def gathered(answers: DataFrame) -> np.ndarray:
        out = np.zeros(sizes)
        for r in answers.where("bucket < 0").select("u", "v").toLocalIterator():
            out[np.frombuffer(r[0], "<u8").astype(np.int64)] = np.frombuffer(r[1], "<i8")
        return out

    flat = gathered(firsts)
    known = int(flat[KNOWN]) + int((hot_total > 0).sum())
    hot_first = flat[KNOWN + 1 : KNOWN + 1 + warm]
    by_class = flat[KNOWN + 1 + warm :].reshape(warm, FINE)
    there = by_class > 0
    tables = flat[FINE:KNOWN] + np.concatenate([there.sum(0), there.reshape(warm, COARSE, FAN).any(2).sum(0), [there.any(1).sum()]])
    state = State(flat[:FINE] + by_class.sum(0), _split_totals(tables), hot_first, np.repeat(np.maximum(hot_total, 1)[:, None] / max(trained, 1), FINE, 1))
    sampler = counted.where("state is not null").select("bucket", F.lit(0).alias("part"), F.lit(None).cast("long").alias("batch"), "state")

    def sweep(number: int, state: State, answers: DataFrame | None) -> tuple[State, DataFrame, DataFrame]:
        given = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gc.disable()
            state, sums = given.value, np.zeros(sizes)
            for b, rows in _groups(batches, "bucket"):
                part = rows.column("part").to_numpy()
                arrays = rows.column("state")[0].as_py()
                words, key, once, at, near, many, asked, own = (np.frombuffer(k, t) for k, t in zip(arrays, ("<i2", "<i8", "<u4", "<u4", "<u4", "<i8", "<u8", "<i2"), strict=True))
                leaves = Leaves(words.astype(np.int64), key, once.astype(np.int64), at.astype(np.int64), near, many)
                first, more = (_flat(rows.filter(pa.array(part == k)).column("v"), "<i4") for k in (1, 2))
                seated = first.reshape(-1, 3)[:, 1] + (more if len(more) else 0)
                found, customers, got = leaves.sample(np.concatenate([seated, state.seated[own]]), state, known, np.random.default_rng([SEED, number, b]))
                _add(sums, leaves, customers, leaves.upper.totals(got), warm)
                extra = np.bincount(near, found - 1, len(asked) + len(own))
                sums[KNOWN + 1 + own.astype(np.int64)] += extra[len(asked) :]
                yield _post(b, 2 + number, True, asked, extra[: len(asked), None], homes)
            yield _post_sums(sums)

        rows = _with_answers(sampler, firsts, *([answers] if answers is not None else []))
        sent = scratch.keep(rows.mapInArrow(run, MESSAGE))
        answers = _exchange(scratch, sent, {2 + number: (0, 1)})
        given.destroy()
        flat = gathered(answers)
        by_class = flat[KNOWN + 1 + warm :].reshape(warm, FINE)
        upper = Hot(by_class)
        got = upper.sample(state, known, number)
        customers, tables = flat[:FINE] + by_class.sum(0), _split_totals(flat[FINE:KNOWN] + upper.totals(got))
        return State(customers, tables, hot_first + flat[KNOWN + 1 : KNOWN + 1 + warm], upper.warm(got, customers, tables, known)), sent, answers

    answers, states, posts = None, [state], []
    for number in range(BURN_IN + SAMPLES):
        before = answers
        state, sent, answers = sweep(number, states[-1], answers)
        states.append(state)
        posts.append(sent)
        if before is not None:
            scratch.free(before)
    scratch.free(answers)
    scratch.free(firsts)

    # Sample k is drawn given the tables of the sweep before it, and predicts with its own.
    numbers = range(BURN_IN, BURN_IN + SAMPLES)
    columns = {k: 2 + k - max(BURN_IN - 1, 0) for k in range(max(BURN_IN - 1, 0), BURN_IN + SAMPLES)}
    asked = counted.where("slot = 0").withColumn("ask", F.lit(True)).select(names)
    for k in columns:
        asked = asked.unionByName(posts[k].where("to >= 0").withColumn("ask", F.lit(False)).select(names))
    lasts = _exchange(scratch, asked, {0: (0, 2), **{2 + k: (at, 1) for k, at in columns.items()}})
    for frame in (counted, *posts):
        scratch.free(frame)
    width = 2 + len(columns)
    shared = spark.sparkContext.broadcast(states[BURN_IN:])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        hot, states = shared_hot.value, shared.value
        for b, rows in _groups(batches, "bucket"):
            part = rows.column("part").to_numpy()
            answers = _flat(rows.filter(pa.array(part == 1)).column("v"), "<i4").reshape(-1, width)
            rows = rows.filter(pa.array(part == 0))
            x = Bucket(rows, hot)
            leaves, many = x.leaves()
            own = x.hot_before >= 0
            cold = np.flatnonzero(~own)
            cold = cold[ordered(x.befores[cold])]

            def of_befores(answer: np.ndarray | int, hot_part: np.ndarray, cold: np.ndarray = cold, own: np.ndarray = own, x: Bucket = x) -> np.ndarray:
                out = np.zeros(len(x.befores))
                out[cold] = answer
                out[own] = hot_part[x.hot_before[own]]
                return out

            def seated(k: int, state: State, answers: np.ndarray = answers) -> np.ndarray:
                return of_befores(answers[:, 1] + (answers[:, columns[k]] if k >= 0 else 0), state.seated)  # noqa: B023

            customers = of_befores(answers[:, 0], hot_total)
            wanted, at = np.unique(x.key, return_inverse=True)
            warm_ = x.hot[wanted // FINE]
            places = leaves.upper.places(wanted[warm_ < 0])
            p, p_class, tables = np.zeros(len(x.n)), np.zeros(len(wanted)), (x.n > 0).astype(np.int64)
            for given, state, k in zip(states[:-1], states[1:], numbers, strict=True):
                tables[many], _, got = leaves.sample(seated(k - 1, given), given, known, np.random.default_rng([SEED, k, b]))
                p_class[warm_ < 0] = leaves.upper.predict(got, state.tables, state.customers, known, places)
                p_class[warm_ >= 0] = state.warm[warm_[warm_ >= 0], wanted[warm_ >= 0] % FINE]
                mass = STRENGTH["word"] + DISCOUNT["word"] * seated(k, state)
                p += (x.n - DISCOUNT["word"] * tables + mass[x.near] * p_class[at]) / (STRENGTH["word"] + customers[x.near])
            model = np.log10(p / SAMPLES).astype("<f4")[x.back]
            per_word, per_pair = (np.concatenate([[0], np.cumsum(k)]) for k in (x.runs[:, 1], x.pairs))
            yield pa.RecordBatch.from_arrays([rows.column("batch").combine_chunks(), pa.array(np.full(rows.num_rows, b)), _packed(x.total[x.cold_runs].astype("<i8"), per_word), _packed(model, per_pair)], ["batch", "bucket", "total", "model"])

    passes = min(PASSES, buckets)
    for k in range(passes):
        mine = F.col("bucket") % passes == k
        some = scratch.keep(_with_answers(_messages(tokens, hot, buckets, (k, passes)).withColumn("part", F.lit(0)), lasts.where(mine)).mapInArrow(score, "batch long, bucket long, total binary, model binary"))
        scored = scored.unionByName(some) if k else some
    scratch.free(lasts)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        hot = shared_hot.value
        for _, rows in _groups(batches, "batch"):
            own = rows.slice(0, 1).select(["ids", "lengths", "words", "tokens"]).to_pylist()[0]  # sorted first: its bucket is null
            lengths = np.frombuffer(own["lengths"], "<u4").astype(np.int64)
            ids = _read_tokens(own["tokens"])
            pairs = Pairs(np.frombuffer(own["words"], "<u8"), ids, hot, buckets)
            seen = np.zeros(len(pairs.words), np.int64)
            seen[pairs.word[pairs.starts[~pairs.warm]]] = _flat(rows.column("total"), "<i8")
            seen[pairs.hot >= 0] = hot_total[pairs.hot[pairs.hot >= 0]]
            model = _flat(rows.column("model"), "<f4").astype(float)[pairs.of]
            text = np.repeat(np.arange(len(lengths)), lengths)
            base = np.log10((seen + 0.5) / (trained + 0.5 * (known + 1)))[ids]
            sums = (np.bincount(text, k, len(lengths)) for k in (base, model))
            n_known = np.bincount(text, seen[ids] > 0, len(lengths)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own["ids"], rows.schema.field("ids").type.value_type), pa.array(lengths), pa.array(n_known), *(pa.array(k) for k in sums)], ["id", "n_tokens", "n_known", "base_score", "score"])

    together = tokens.select("batch", F.lit(None).cast("long").alias("bucket"), "ids", "lengths", "words", "tokens").unionByName(scored, allowMissingColumns=True)
    done = together.repartition(partitions(spark), "batch").sortWithinPartitions("batch", "bucket").mapInArrow(finish, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(trained).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of all scored texts together, by ``held_out``: ten to the power of minus the mean log10 probability a token."""
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity (of the text)."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    found = lm_scores(table(spark, sf_dir, "documents"), held)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES = {"op3_lm_score": op3_lm_score}
