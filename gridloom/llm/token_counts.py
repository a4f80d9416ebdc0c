"""Token counts under a unigram model: forward scores shared along the trie of distinct pre-tokens."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import BATCH_CHARS, VOCABULARY, WORDS_KEPT, Splitter, read_ranks
from .common import table

#: Scores are whole micro-nats in the high bits; the low bits count tokens, so that equal scores prefer fewer.
COUNT_BITS = 40
#: Zipf-Mandelbrot offset of the rank-derived piece probabilities.
OFFSET = 2.7


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Unigram scores from ranks, log p = -log(rank + OFFSET) - log Z, each less one in the count bits."""
    total = math.log(math.fsum(1 / (r + OFFSET) for r in ranks.values()))
    return {p: round(-1e6 * (math.log(r + OFFSET) + total)) * (1 << COUNT_BITS) - 1 for p, r in ranks.items()}


def trie_counts(words: Iterable[bytes], scores: dict[bytes, int]) -> dict[bytes, int]:
    """Tokens of each distinct word's best segmentation.

    Words come in byte order, so the walk is a depth-first pass over their trie: ``forward`` holds the best score of
    every prefix on the path to the current node, a shared prefix is scored once, and a terminal stores its count.
    All 256 bytes must be pieces.
    """
    longest = max(map(len, scores))
    get, low = scores.get, (1 << COUNT_BITS) - 1
    counts: dict[bytes, int] = {}
    forward, before = [0], b""
    for word in sorted(words):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del forward[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best = None
            for start in range(max(0, end - longest), end):
                piece = get(word[start:end])
                if piece is not None and (best is None or forward[start] + piece > best):
                    best = forward[start] + piece
            forward.append(best)
        counts[word] = -forward[-1] & low
        before = word
    return counts


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens, n_bytes) of every whole text, pre-tokens split by public_tokenizers.PATTERN.

    A null or empty text has no tokens. Rows are returned one for one. There is no shuffle; memory is one Arrow batch,
    the vocabulary (a file of fixed size, broadcast) and the counts of WORDS_KEPT words a Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(piece_scores(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        scores, split = shared.value, Splitter()
        known: dict[str, int] = {}
        for whole in batches:
            sizes = np.cumsum(np.fromiter((len(x.as_py() or "") for x in whole.column(1)), np.int64, whole.num_rows))
            cuts = np.unique([0, *np.searchsorted(sizes, np.arange(BATCH_CHARS, sizes[-1] if len(sizes) else 0, BATCH_CHARS)), whole.num_rows])
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                batch = whole.slice(start, stop - start)
                texts = [x.as_py() or "" for x in batch.column(1)]
                words = [split(t) for t in texts]
                if len(known) > WORDS_KEPT:
                    known.clear()
                new = {w.encode(): w for w in set(chain.from_iterable(words)) if w not in known}
                known.update((new[raw], n) for raw, n in trie_counts(new, scores).items())
                numbers = ([len(w) for w in words], [sum(map(known.__getitem__, w)) for w in words], [len(t.encode()) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n, pa.int64()) for n in numbers)], [id_col, "n_pretokens", "n_tokens", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long, n_bytes long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, n_pretokens, n_tokens, n_bytes (null: empty text)."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op7_token_counts": op7_token_counts}
