"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEED = 11
#: Words in a window, and between the starts of overlapping windows.
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 8, 8, 8
CHAR_BUCKETS, MAX_VOCABULARY = 4096, 8192
#: Toxic rows that the model is fitted on, at most, and three times as many clean ones; the first by a hash of the id.
FIT_ROWS = 1200
THRESHOLD = 0.7
BATCH_CHARS = 4 << 20
WINDOWS_AT_ONCE = 2048
#: Words whose trigrams are held at once; a vocabulary's together are what the driver would need most memory for.
WORDS_AT_ONCE = 1 << 14


#: Word bytes: digits, letters (A-Z lowered) and everything outside ASCII; the rest becomes a space.
_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def char_means(words: list[bytes], table_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean embedding of each word's bracketed byte trigrams; also the trigram buckets and their words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    grams = (raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:]
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes + 2) - sizes - 2
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    bucket = (((grams[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(len(table_))).astype(np.int64)
    means = np.add.reduceat(table_[bucket], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    return means.astype(np.float32), bucket, owner


def window_starts(n: int) -> list[int]:
    """Starts of windows that overlap by half and cover all n words, the last flush with the end."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Model:
    """Parameters by name; gates are ordered update, reset, candidate; index 0 of a pair reads forwards, 1 backwards."""

    def __init__(self, vocabulary: dict[bytes, int], parameters: dict[str, np.ndarray], scale: float = 1.0, shift: float = 0.0):
        self.vocabulary, self.p, self.scale, self.shift = vocabulary, parameters, scale, shift

    @classmethod
    def new(cls, vocabulary: dict[bytes, int]) -> Model:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        inputs = WORD_DIM + CHAR_DIM
        return cls(vocabulary, {
            "word": draw(len(vocabulary) + 1, WORD_DIM, by=0.3), "char": draw(CHAR_BUCKETS, CHAR_DIM, by=0.3),
            "w": draw(2, inputs, 3 * HIDDEN, by=inputs**-0.5), "u": draw(2, HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "a": draw(2 * HIDDEN, ATTEND, by=(2 * HIDDEN) ** -0.5), "c": np.zeros(ATTEND, np.float32), "v": draw(ATTEND, by=0.5),
            "o": draw(2 * HIDDEN, by=0.3), "d": np.zeros(1, np.float32),
        })

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Word and character embeddings of distinct words."""
        known = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        means = [char_means(words[k : k + WORDS_AT_ONCE], self.p["char"])[0] for k in range(0, len(words), WORDS_AT_ONCE)]
        return np.concatenate([self.p["word"][known], np.concatenate(means)], 1)

    def forward(self, gates: np.ndarray, ids: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows of word ids (windows, steps); ``gates`` holds each word's input to both directions' gates."""
        p, (n, steps), h = self.p, ids.shape, HIDDEN
        kind = gates.dtype
        state, states = np.zeros((2, n, h), kind), np.empty((steps, 2, n, h), kind)
        x, rec, column = np.empty((2, n, 3 * h), kind), np.empty((2, n, 3 * h), kind), np.ascontiguousarray(ids.T)
        on, trail = None, []
        ragged = bool((lengths < steps).any())
        for k in range(steps):
            np.take(gates[0], column[k], axis=0, out=x[0], mode="clip")
            np.take(gates[1], column[steps - 1 - k], axis=0, out=x[1], mode="clip")
            np.matmul(state, p["u"], out=rec)
            both = x[..., : 2 * h] + rec[..., : 2 * h]  # update and reset gates; sigmoid(x) = (tanh(x / 2) + 1) / 2
            both *= 0.5
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            z, r = both[..., :h], both[..., h:]
            new = r * rec[..., 2 * h :]
            new += x[..., 2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                trail.append([state, rec[..., 2 * h :].copy(), z, r, new])
            if ragged:  # outside a text the state stays
                on = np.stack([k < lengths, steps - 1 - k < lengths])[..., None]
                z = np.where(on, z, 1)
            out = states[k]
            np.subtract(state, new, out=out)
            out *= z
            out += new
            if keep is not None:
                trail[-1] += [z, on]
            state = out
        ahead, back = states[:, 0], states[::-1, 1]  # in text order
        scored = ahead @ p["a"][:h]
        scored += back @ p["a"][h:]
        scored += p["c"]
        np.tanh(scored, out=scored)
        energy = scored @ p["v"]
        if ragged:
            energy = np.where(np.arange(steps)[:, None] < lengths[None, :], energy, -1e9)
        energy = np.exp(energy - energy.max(0))
        weight = energy / energy.sum(0)
        pooled = np.concatenate([np.einsum("kn,knh->nh", weight, ahead), np.einsum("kn,knh->nh", weight, back)], 1)
        if keep is not None:
            keep.update(trail=trail, both=np.concatenate([ahead, back], 2), scored=scored, weight=weight, pooled=pooled)
        return pooled @ p["o"] + p["d"]

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        return inputs[None] @ self.p["w"] + self.p["b"]

    def logits(self, gates: np.ndarray, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Logits of all overlapping windows of each text; ``texts`` hold indices of words, at least one each."""
        flat = np.concatenate(texts)
        first = np.cumsum([0, *map(len, texts)][:-1])
        starts = [window_starts(len(t)) for t in texts]
        at = np.concatenate([f + np.array(s) for f, s in zip(first.tolist(), starts, strict=True)])
        length = np.repeat([min(len(t), WINDOW) for t in texts], [len(s) for s in starts])
        out = np.empty(len(at), np.float32)
        for k in range(0, len(at), WINDOWS_AT_ONCE):
            rows = at[k : k + WINDOWS_AT_ONCE, None] + np.arange(WINDOW)
            out[k : k + WINDOWS_AT_ONCE] = self.forward(gates, flat[np.minimum(rows, len(flat) - 1)], length[k : k + WINDOWS_AT_ONCE])
        return np.split(out, np.cumsum([len(s) for s in starts])[:-1])

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """Probability for each text from its most toxic window; a text without words has none and scores 0."""
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        ids = [np.fromiter(map(place.__getitem__, words), np.int32, len(words)) for words in texts]
        out = np.zeros(len(texts))
        some = [k for k, x in enumerate(ids) if len(x)]
        if some:
            best = np.array([x.max() for x in self.logits(self.gates(self.inputs(list(place))), [ids[k] for k in some])], np.float64)
            out[some] = _sigmoid(np.clip(self.scale * best + self.shift, -500, 500))
        return out

    def gradient(self, batch: list[list[bytes]], target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy of windows (lists of at most WINDOW words)."""
        p, h, n = self.p, HIDDEN, len(batch)
        distinct = list(dict.fromkeys(w for words in batch for w in words))
        place = {w: k for k, w in enumerate(distinct)}
        known = np.array([self.vocabulary.get(w, 0) for w in distinct])
        means, bucket, owner = char_means(distinct, p["char"])
        x = np.concatenate([p["word"][known], means], 1)
        lengths = np.array([len(w) for w in batch])
        ids = np.zeros((n, WINDOW), np.int64)
        for k, words in enumerate(batch):
            ids[k, : len(words)] = [place[w] for w in words]
        keep: dict = {}
        error = (_sigmoid(self.forward(self.gates(x), ids, lengths, keep)) - target).astype(np.float32) / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"], g["d"] = keep["pooled"].T @ error, error.sum(keepdims=True)
        d_pooled = error[:, None] * p["o"]
        both, weight, scored = keep["both"], keep["weight"], keep["scored"]
        d_both = weight[..., None] * d_pooled
        d_weight = (both * d_pooled).sum(2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0))
        g["v"] = (d_energy[..., None] * scored).sum((0, 1))
        d_scored = d_energy[..., None] * p["v"] * (1 - scored**2)
        g["a"], g["c"] = np.tensordot(both, d_scored, ((0, 1), (0, 1))), d_scored.sum((0, 1))
        d_both += d_scored @ p["a"].T
        d_words = np.empty((2, WINDOW, n, 3 * h), np.float32)
        d_state = np.zeros((2, n, h), np.float32)
        for k in range(WINDOW - 1, -1, -1):
            state, rec_new, z, r, new, z_used, on = keep["trail"][k]
            d_state = d_state + np.stack([d_both[k, :, :h], d_both[WINDOW - 1 - k, :, h:]])
            d_pre = d_state if on is None else d_state * on
            d_new = d_pre * (1 - z) * (1 - new**2)
            d_z = d_pre * (state - new) * z * (1 - z)
            d_r = d_new * rec_new * r * (1 - r)
            d_rec = np.concatenate([d_z, d_r, d_new * r], 2)
            g["u"] += state.transpose(0, 2, 1) @ d_rec
            d_state = d_state * z_used + d_rec @ p["u"].transpose(0, 2, 1)
            d_words[0, k], d_words[1, WINDOW - 1 - k] = np.concatenate([d_z, d_r, d_new], 2)
        flat = np.ascontiguousarray(ids.T).ravel()
        order = np.argsort(flat, kind="stable")
        held, first = np.unique(flat[order], return_index=True)
        d_gates = np.zeros((2, len(distinct), 3 * h), np.float32)
        d_gates[:, held] = np.add.reduceat(d_words.reshape(2, -1, 3 * h)[:, order], first, axis=1)
        g["w"], g["b"] = x.T[None] @ d_gates, d_gates.sum(1, keepdims=True)
        d_in = (d_gates @ p["w"].transpose(0, 2, 1)).sum(0)
        np.add.at(g["word"], known, d_in[:, :WORD_DIM])
        share = d_in[:, WORD_DIM:] / np.bincount(owner, minlength=len(distinct))[:, None]
        np.add.at(g["char"], bucket, share[owner])
        return g


def fit(texts: list[list[bytes]], labels: list[int], rounds: int = 4, batch: int = 128, least_steps: int = 200) -> Model:
    """Fit on whole labelled texts. A text's label speaks for its most toxic window only, so each round trains on the
    windows that score highest so far, clean texts' too, and on some drawn at random; few texts get more rounds, to ``least_steps`` in all."""
    rng = np.random.default_rng(SEED)
    pairs = [(t, y) for t, y in zip(texts, labels, strict=True) if t]
    texts, target = [t for t, _ in pairs], np.array([y for _, y in pairs], np.float32)
    seen = Counter(w for t in texts for w in set(t))
    vocabulary = {w: k + 1 for k, (w, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:MAX_VOCABULARY]) if n > 1}
    model = Model.new(vocabulary)
    if not len(target) or target.min() == target.max():
        model.scale, model.shift = 0.0, -10.0 if not len(target) or target.max() == 0 else 10.0
        return model
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    starts = [window_starts(len(t)) for t in texts]
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    ids = [np.fromiter(map(place.__getitem__, words), np.int32, len(words)) for words in texts]
    step = 0
    turn = 0
    while turn < rounds or step < least_steps:
        last = turn >= rounds - 1 and step >= least_steps * 3 // 4
        chosen = [(k, int(rng.integers(len(s)))) for k, s in enumerate(starts) for _ in range(2 if turn == 0 else 1) if turn == 0 or target[k] == 0]
        if turn:
            ranked = model.logits(model.gates(model.inputs(list(place))), ids)
            chosen += [(k, int(i)) for k, x in enumerate(ranked) for i in np.argsort(-x)[: 2 if target[k] else 3]]
        order = rng.permutation(len(chosen))
        for a in range(0, len(order), batch):
            some = [chosen[i] for i in order[a : a + batch]]
            step += 1
            windows = [texts[k][starts[k][s] : starts[k][s] + WINDOW] for k, s in some]
            for name, grad in model.gradient(windows, target[[k for k, _ in some]]).items():
                one, two = moment[name]
                one += 0.1 * (grad - one)
                two += 0.01 * (grad**2 - two)
                model.p[name] -= (0.003 if last else 0.01) * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)
        turn += 1
    best = np.array([x.max() for x in model.logits(model.gates(model.inputs(list(place))), ids)], np.float64)
    scale, shift = 1.0, 0.0
    for _ in range(25):  # logistic calibration on the texts' highest logits, ridge towards a slope of 1
        q = _sigmoid(np.clip(scale * best + shift, -30, 30))
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - target) * best).sum() + (scale - 1), (q - target).sum() + 0.01 * shift])
        curve = np.array([[(w * best * best).sum() + 1, (w * best).sum()], [(w * best).sum(), w.sum() + 0.01]])
        move = np.linalg.solve(curve, grad)
        scale, shift = scale - float(np.clip(move[0], -1, 1)), shift - float(np.clip(move[1], -2, 2))
    model.scale, model.shift = max(scale, 1e-3), shift
    return model


def fit_on(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``fit_rows`` toxic and three times as many clean labelled texts outside the held-out third (crc32 of the id mod 3 = 1).

    Which rows is decided by a hash of the id over all labels; an id with several labels counts as toxic if one says so,
    and one with several texts is fitted on the least of them.
    """
    marks = labels.where(F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 3 != 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    marks = marks.withColumn("h", F.xxhash64(id_col))
    chosen = [marks.where(F.col("y") == y).orderBy("h", id_col).limit(n) for y, n in ((0, 3 * fit_rows), (1, fit_rows))]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # at most 4 * fit_rows ids
    rows = docs.select(id_col, text_col).join(chosen, id_col).groupBy("h", id_col, "y").agg(F.min(text_col)).select("h", f"min({text_col})", "y").collect()
    rows.sort(key=lambda r: r[0])
    return fit([words_of(r[1]) for r in rows], [r.y for r in rows])


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 at THRESHOLD or more), replacing such columns.

    Scores come from the whole text alone: every overlapping window is scored, the highest counts. Null and empty texts
    and texts without words score 0. Rows are returned one for one; there is no shuffle, memory is one Arrow batch.
    """
    base = docs.drop("score", "predicted")
    names = base.columns
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        model = shared.value
        for whole in batches:
            texts = whole.column(at)
            sizes = np.cumsum(np.fromiter((len(x.as_py() or "") for x in texts), np.int64, len(texts)))
            cuts = np.unique([0, *np.searchsorted(sizes, np.arange(BATCH_CHARS, sizes[-1] if len(sizes) else 0, BATCH_CHARS)), len(texts)])
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                batch = whole.slice(start, stop - start)
                score = model.score([words_of(x.as_py()) for x in batch.column(at)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return base.mapInArrow(run, base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, score, predicted; rows with crc32(doc_id) mod 3 of 1 are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, fit_on(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
