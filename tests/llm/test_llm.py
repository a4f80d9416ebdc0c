"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, common, decontaminate, embeddings, html_text, lm_score, queries, simhash, substrings, token_counts, toxicity, warc

PATH = public_tokenizers.path(bpe.VOCABULARY)


def prose(seed, words=60, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(words))


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# shared pieces


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in common.connected_components(common.Scratch(spark, "t"), frame).collect()}
    want = components(600, links)
    assert all(got.get(k, k) == want[k] for k in range(600))
    assert common.connected_components(common.Scratch(spark, "t"), frame.where("false")).count() == 0


def test_hot_groups_meet_once(spark):
    rows = spark.range(50).select(F.lit(7).cast("long").alias("key"), "id")
    dealt = common.split_hot_groups(rows, "key", "id", 8)
    seen = Counter()
    tasks = {}
    for r in dealt.collect():
        tasks.setdefault(r.task, []).append(r)
    assert max(map(len, tasks.values())) < 40
    for t in tasks.values():
        for i, j in common.task_pairs(np.zeros(len(t)), np.array([r.part for r in t]), np.array([r.cross for r in t])):
            for a, b in zip(i, j, strict=True):
                seen[frozenset((t[a].id, t[b].id))] += 1
    assert len(seen) == 50 * 49 // 2 and set(seen.values()) == {1}


# 1


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 16))
    x = np.concatenate([base, base[:40] + 0.1 * rng.standard_normal((40, 16)), np.repeat(base[:1], 30, 0), base[:20] * 3.5])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, []), (9005, [1.0, None]), (None, x[1].tolist()), (9006, [1.0, 0.0]), (9007, [2.0, 0.001])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: r for r in embeddings.embedding_groups(frame, chunk=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    extra = (unit @ unit[1] >= 0.9).astype(int)  # the row with a null id
    roots = components(len(x), np.argwhere(near))
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (near[k].sum() + extra[k], roots[k], roots[k] == k), k
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in (9001, 9002, 9003, 9004, 9005))
    assert got[9006].n_links == got[9007].n_links == 1 and got[9007].component_id == 9006
    assert embeddings.embedding_groups(frame.where("false")).count() == 0


def test_recall_by_design():
    rng = np.random.default_rng(9)
    for rows in (200, 50_000, 10**7):
        parts, tables = embeddings.cells_for(rows)
        x = rng.standard_normal((3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((3000, 64))
        y -= (x * y).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        cosine = rng.uniform(0.9, 0.92, (3000, 1))
        a, b = (embeddings.cell_names(embeddings.compress(v)[0], parts, tables) for v in (x, cosine * x + np.sqrt(1 - cosine**2) * y))
        found = (a == b).any(1)
        assert found.mean() >= 0.995, (rows, parts, tables, found.mean())
    assert 0 < embeddings.count_needed() < embeddings.COUNTED


def test_bytes_a_vector_grow_slowly():
    """Multiples of a vector of 64 floats; 12 KB were sent at 51,000 rows and 400 KB at 10^9 when whole vectors travelled."""
    assert [round(embeddings.bytes_a_vector(10**k, 64) / 256) for k in (5, 6, 7, 8, 9)] == sorted(round(embeddings.bytes_a_vector(10**k, 64) / 256) for k in (5, 6, 7, 8, 9))
    assert embeddings.bytes_a_vector(51_000, 64) < 8 * 256 and embeddings.bytes_a_vector(10**9, 64) < 48 * 256


def test_links_near_the_threshold_and_repeated_ids(spark):
    """Cosines all around 0.9, some within 1e-6 of it: decided as in double precision. Ids repeat, another column clashes."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((120, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = np.concatenate([rng.uniform(0.88, 0.92, 60), 0.9 + rng.choice([-1e-6, 1e-6, -1e-3, 1e-3], 60)])[:, None]
    both = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(both)] + [(5, both[5].tolist(), 2)]
    got = embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"))
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = {(r.id, r.n_links) for r in got.collect()}
    extra = near[:, 5].astype(int) + (np.arange(240) == 5)
    assert found == {(k, int(near[k].sum() + extra[k])) for k in range(240)} and got.count() == 241


# 2


def ranks():
    with open(PATH, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def test_bpe_against_tiktoken(spark, docs, no_docs):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    odd = ["a_b __init__ x²³ Ⅷ", "I'll they've 's S   x　y", "tab\t\tx\n\n y \r\n", "\x1c\x1d\x85 x", "=" * 3000, "ab" * 900, "é" * 300, "<|endoftext|>", " "]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    rows = bpe.encode_decode(frame, PATH, list(bpe.OUTPUTS)).collect()
    assert len(rows) == 11 + len(odd)
    for (_, text), r in zip([(r.doc_id, r.text) for r in frame.collect()], rows, strict=True):
        want = own.encode_ordinary(text or "")
        assert r.ids == want and bytes(r.decoded) == (text or "").encode() and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(no_docs, PATH, ["ids"]).count() == 0


def test_folds_agree():
    r = ranks()
    table = bpe.MergeTable(r)
    rng = random.Random(2)
    words = {"".join(rng.choice("abthe é日") for _ in range(rng.randrange(1, 70))) for _ in range(400)}
    got = table.fold(sorted(words))
    assert all(tuple(got[w]) == bpe.merge_pieces(w.encode(), r) == (bpe._merge_long(w.encode(), r) if w.encode() not in r else (r[w.encode()],)) for w in words)


def test_native_fold(spark):
    words = ["hello", " thttible", "é", "日本", "a", "", "aaaaaaaa", " antidisestablishmentarianism"]
    rows = bpe.fold_words_native(spark.createDataFrame([(w,) for w in words], "word string"), PATH).collect()
    r = ranks()
    assert [x.ids for x in rows] == [list(bpe.merge_pieces(w.encode(), r)) if w else [] for w in words]


# 3


def test_lm_scores(spark, docs, no_docs):
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, prose(k, 80, 50)) for k in range(80)], "doc_id long, text string"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    rows = lm_score.lm_scores(frame, held).collect()
    source = frame.collect()
    assert len(rows) == len(source)
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for r in source if not out(r.doc_id) for w in tokens(r.text))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for r in source:
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(r.text))
        want[r.doc_id, len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), round(base, 6)] += 1
    assert want == Counter((r.id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    assert all(r.train_tokens == total and r.score < 0 for r in rows)
    fresh = [r for r in rows if r.id and r.id >= 100 and out(r.id)]
    assert sum(r.score for r in fresh) > 1.2 * sum(r.base_score for r in fresh)
    assert lm_score.lm_scores(no_docs, held).count() == 0
    assert lm_score.lm_scores(frame, F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0


def test_lm_restaurants_sum_to_one():
    rng = np.random.default_rng(0)
    n, words = 150, np.concatenate([np.arange(150), rng.zipf(1.5, 5000) % 150])
    fine = rng.integers(0, lm_score.FINE, len(words))
    counts = lm_score.Counts(n + 1, *np.unique(words * lm_score.FINE + fine, return_counts=True))
    customers = np.bincount(fine, minlength=lm_score.FINE).astype(float)
    tables = np.concatenate([np.bincount(counts.fine, minlength=lm_score.FINE), np.bincount(counts.pairs % lm_score.COARSE, minlength=lm_score.COARSE), [n]]).astype(float)
    for k in range(3):
        got = counts.sample(lm_score._split_totals(tables), customers, n, np.random.default_rng(k))
        tables = counts.totals(got)
        assert (got["fine"] >= 1).all() and (got["fine"] <= counts.count).all()
    for f in (0, 3, 1000):
        p = counts.predict(got, lm_score._split_totals(tables), customers, n, counts.places(np.arange(n + 1) * lm_score.FINE + f))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def one_by_one(c, mass, discount, rng, sweeps):
    """Mean tables of c customers of one dish under plain Gibbs: each leaves its table and sits down again, in turn."""
    at, sizes, seen = list(range(c)), {k: 1 for k in range(c)}, []
    for sweep in range(sweeps):
        for k in range(c):
            sizes[at[k]] -= 1
            if not sizes[at[k]]:
                del sizes[at[k]]
            names = list(sizes)
            weight = np.array([sizes[t] - discount for t in names] + [mass]).cumsum()
            pick = int((weight < rng.random() * weight[-1]).sum())
            at[k] = names[pick] if pick < len(names) else max(sizes, default=0) + 1
            sizes[at[k]] = sizes.get(at[k], 0) + 1
        if sweep >= sweeps // 5:
            seen.append(len(sizes))
    return np.mean(seen)


def exact_mean(c, mass, discount):
    """The same mean from the weights of all seatings."""
    ways = np.array([1.0])
    for n in range(1, c):
        ways = np.append(ways * (n - discount * np.arange(1, n + 1)), 0) + np.append(0, ways)
        ways /= ways.max()
    p = ways * np.float64(mass) ** (np.arange(c) - c)
    return (p * np.arange(1, c + 1)).sum() / p.sum()


@pytest.mark.parametrize(("c", "mass", "discount"), [(2, 0.3, 0.75), (9, 2.0, 0.75), (25, 1.5, 0.5), (64, 0.2, 0.75)])
def test_lm_seating_is_that_of_one_by_one_gibbs(c, mass, discount):
    rng = np.random.default_rng(1)
    drawn = lm_score.seat(np.full(20_000, c), np.full(20_000, mass), discount, rng).mean()
    assert abs(drawn - exact_mean(c, mass, discount)) < 0.01 * drawn + 0.02
    assert abs(drawn - one_by_one(c, mass, discount, rng, 1500 if c < 30 else 400)) < 0.05 * drawn + 0.05


@pytest.mark.parametrize(("c", "mass", "discount"), [(120, 5.0, 0.75), (150, 0.5, 0.75), (150, 3.0, 0.5), (140, 60.0, 0.75), (160, 20.0, 0.75)])
def test_lm_seating_of_many_customers(c, mass, discount):
    drawn = lm_score.seat(np.full(5_000, c), np.full(5_000, mass), discount, np.random.default_rng(2)).mean()
    assert abs(drawn / exact_mean(c, mass, discount) - 1) < 0.02


def test_lm_seating_at_the_limit():
    """Beyond the tabled sizes the mean is near that of one-by-one Gibbs, here by the limit 1 + mass / discount."""
    for c, mass in ((200_000, 3.0), (10_000_000, 400.0)):
        drawn = lm_score.seat(np.full(4_000, c), np.full(4_000, mass), 0.75, np.random.default_rng(3)).mean()
        assert abs(drawn / (1 + mass / 0.75) - 1) < 0.03


def test_lm_scores_do_not_follow_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 500)
    rows = [(k, prose(k, 60, 50)) for k in range(60)]
    held, found = F.crc32(F.col("doc_id").cast("string")) % 5 == 1, []
    for parts in (4, 7):
        monkeypatch.setattr(lm_score, "partitions", lambda _, parts=parts: parts)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found.append(sorted((r.id, round(r.score, 6), round(r.perplexity, 6)) for r in lm_score.lm_scores(frame, held).collect()))
    assert found[0] == found[1] and len(found[0]) == 60
    scored = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), held).withColumn("held_out", F.crc32(F.col("id").cast("string")) % 5 == 1)
    for r in lm_score.perplexity(scored).collect():
        mine = [(x.score, x.n_tokens) for x in scored.where(F.col("held_out") == r.held_out).collect()]
        assert abs(r.perplexity - 10 ** (-sum(a for a, _ in mine) / sum(b for _, b in mine))) < 1e-6


def test_lm_contexts_are_words(spark):
    """Words of one class are contexts of their own: what follows one of them is not expected after another."""
    a, b = "aaxyzw", "bbxyzw"
    assert lm_score.context_class(a.encode()) == lm_score.context_class(b.encode())
    rows = [(k, f"{a} left" if k % 2 else f"{b} right") for k in range(200)]
    asked = [f"{a} left", f"{b} right", f"{a} right", f"{b} left"]
    frame = spark.createDataFrame(rows + [(1000 + k, t) for k, t in enumerate(asked)], "doc_id long, text string")
    got = {r.id: r.score for r in lm_score.lm_scores(frame, F.col("doc_id") >= 1000).where("id >= 1000").collect()}
    assert min(got[1000], got[1001]) > max(got[1002], got[1003]) + 1


def test_lm_shares_of_pairs():
    """A scoring pass makes the pairs of its own buckets only, the same as are made for all; a pass may have none."""
    rng = np.random.default_rng(4)
    words = np.unique(lm_score.word_ids([f"w{k}".encode() for k in range(300)] + [b"", b"a", b"ab"]))
    tokens, hot = rng.zipf(1.3, 5000) % len(words), np.sort(words[:4])
    every = lm_score.Pairs(words, tokens, hot, 7)
    assert (every.word[every.of] == tokens).all()
    for k in range(8):
        some, mine = lm_score.Pairs(words, tokens, hot, 7, (k, 8)), every.bucket % 8 == k
        assert all((getattr(some, name) == getattr(every, name)[mine]).all() for name in ("word", "near", "bucket"))
        assert (some.word[some.of] == tokens[some.mine]).all() and (len(some.word) == 0) == (k == 7)
    for keys in (rng.integers(0, 50, 400), rng.integers(2**61, 2**62, 400), np.zeros(0, np.int64)):
        assert all((a == b).all() for a, b in zip(lm_score._distinct(keys), np.unique(keys, return_inverse=True), strict=True))
    for word in (b"", b"a", b"ab", b"abc", b"abcd", "naïve".encode()):
        assert int(lm_score.word_ids([word])[0]) % lm_score.FINE == lm_score.context_class(word)


def test_lm_dealing_changes_nothing(spark, monkeypatch):
    """Many buckets, with hot words' pairs in all of them, score as one bucket does; some words stand after more than RUN
    others, some pairs more than BIG times."""
    rng = np.random.default_rng(5)
    follow = rng.integers(0, 450, (450, 3))
    texts = []
    for _ in range(250):
        word, text = int(rng.integers(450)), []
        for _ in range(40):
            text.append(word)
            word = int(follow[word, rng.integers(3)]) if rng.random() < 0.6 else min(int(rng.zipf(1.4)), 449)
        texts.append(" ".join(f"w{k}" for k in text))
    pairs = Counter(p for t in texts for p in zip(t.split(), t.split()[1:], strict=False))
    assert max(pairs.values()) > lm_score.BIG and max(Counter(b for _, b in pairs).values()) > lm_score.RUN
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    held, found = F.col("doc_id") % 5 == 1, []
    for tokens in (1 << 19, 1500):
        monkeypatch.setattr(lm_score, "BUCKET_TOKENS", tokens)
        found.append({r.id: r for r in lm_score.lm_scores(frame, held).collect()})
    one, many = found
    assert one.keys() == many.keys() and len(one) == 250
    assert all((one[k].n_tokens, one[k].n_known, round(one[k].base_score, 8)) == (many[k].n_tokens, many[k].n_known, round(many[k].base_score, 8)) for k in one)
    sums = [sum(x[k].score for k in x if k % 5 == 1) for x in found]
    assert abs(sums[0] / sums[1] - 1) < 0.01
    assert np.corrcoef([one[k].score for k in one], [many[k].score for k in one])[0, 1] > 0.99


# 4


def simhash_brute(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash_against_brute_force(spark, docs, no_docs):
    texts = [prose(k, 120) for k in range(30)]
    texts += [t.replace("v1 ", "x ", 1) for t in texts] + [t + " tail" for t in texts[:10]] + [texts[0]] * 5
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    source = frame.collect()
    prints = [simhash_brute(r.text) for r in source]
    roots = components(len(source), [(i, j) for i in range(len(source)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    low = {}
    for r, root in zip(source, roots, strict=True):
        if r.doc_id is not None:
            low[root] = min(low.get(root, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, p, low.get(root)) for r, p, root in zip(source, prints, roots, strict=True))
    got = simhash.simhash_groups(frame).collect()
    assert Counter((r.id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert len(set(roots)) < len(source) - 20
    assert simhash.simhash_groups(no_docs).count() == 0


def test_simhash_finds_every_close_pair(spark):
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(20)]
    prints = [c ^ sum(1 << b for b in rng.sample(range(64), d)) for c in centre for d in (0, 1, 2, 3, 4)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").distinct()
    links = simhash.near_links(common.Scratch(spark, "t"), frame, chunk=4).collect()
    place = {p: k for k, p in enumerate(signed)}
    assert components(100, [(place[r.a], place[r.b]) for r in links]) == components(100, [(i, j) for i in range(100) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    for rows in (10, 1 << 26):
        for d in range(4):
            a, b = prints[0], prints[0] ^ sum(1 << k for k in rng.sample(range(64), d))
            assert any(a & m == b & m for m in simhash.signature_masks(3, rows))


# 5


def contamination_brute(texts, items, width=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for name, text in items:
        w = split(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add("" if name is None else str(name))
    out = []
    for text in texts:
        w, hit, found = split(text), set(), set()
        for size in set(map(len, windows)):
            for k in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= owners
        out.append((len(w), len(hit), sorted(found), bool(hit)))
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 30])
def test_contamination_against_brute_force(spark, docs, no_docs, block_words):
    items = [(1, prose(1, 25)), (2, "Quick, brown fox!"), (3, None), (4, ""), (5, prose(1, 25)), (10, prose(2, 10)), (11, "é"), (12, "...")]
    texts = [prose(3) + " " + prose(1, 25).upper() + " " + prose(4), prose(2, 10), prose(1, 25)[:-4], "x " + "é " * 3]
    frame = docs.select("doc_id", "text", "score", "n_words").union(spark.createDataFrame([(100 + k, t, 0, 0) for k, t in enumerate(texts)], "doc_id long, text string, score long, n_words int"))
    got = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert got.columns == ["doc_id", "text", "score", "n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated"]
    rows = got.collect()
    want = contamination_brute([r.text for r in rows], items)
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows] == want
    assert all(r.n_items == len(r["items"]) and sum(s.end - s.start for s in r.hit_spans) == r.n_hit for r in rows)
    assert sum(r.contaminated for r in rows) >= 4
    assert decontaminate.contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = decontaminate.contamination(frame, spark.createDataFrame([(1, None)], "item_id long, text string")).collect()
    assert sorted(r.n_words for r in none) == sorted(w[0] for w in want) and not any(r.contaminated for r in none)


def test_index_of_many_windows(monkeypatch):
    """A block's index is arrays of some 30 bytes a window; common words, repeats and short items as brute force has them."""
    rng = np.random.default_rng(7)
    items = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 50)) for k in range(300)] + [(900, "w1 " * 40), (901, "w1 " * 12)]
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 50) + " " + items[k][1] for k in range(0, 60)] + ["w1 " * 30, None, "", "w2"]
    vocabulary = pa.array(sorted({w for _, t in items for w in t.split()}))
    words, ends = decontaminate.words_of(pa.array([t for _, t in items]))
    index = decontaminate.Index(decontaminate.numbered(words, vocabulary), ends, rng.permutation(len(vocabulary)), 10)
    words, starts = decontaminate.words_of(pa.array(texts))
    ids, want = decontaminate.numbered(words, vocabulary), contamination_brute(texts, items)
    hit, found = [set() for _ in texts], [set() for _ in texts]
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    for at, windows in index.hits(ids, starts):
        for a, w in zip(at.tolist(), windows.tolist(), strict=True):
            t = int(np.searchsorted(starts, a, "right")) - 1
            hit[t] |= set(range(a, a + int(index.size[w])))
            found[t] |= {str(items[k][0]) for k in index.owners[index.owners_at[w] : index.owners_at[w + 1]]}
    assert [(len(h), sorted(f)) for h, f in zip(hit, found, strict=True)] == [(w[1], w[2]) for w in want]
    many = np.arange(1 << 20) % 40_000
    index = decontaminate.Index(many, np.array([0, 1 << 19, 1 << 20]), np.arange(40_000), 10)
    assert sum(x.nbytes for x in vars(index).values()) < 40 << 20


# 6


def test_warc_round_trip(spark, tmp_path):
    pages = [(k, f"http://x/{k}", f"<p>{k % 7 if k < 40 else k}</p>" * (k % 5 + 1)) for k in range(60)] + [(100, None, None), (101, "u", ""), (None, "n", "<p>alone</p>"), (102, "a\r\nb", "é" * 1000), (102, "a\r\nb", "é" * 1000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    target = f"file://{tmp_path}/a"
    listing = warc.write_archives(frame, target, roll_bytes=4000)
    assert listing.agg(F.sum("records")).first()[0] == len(pages) and listing.count() > spark.conf.get("spark.sql.shuffle.partitions").__len__()
    rows = warc.read_archives(spark, target).collect()
    owner = {}
    for i, _, h in pages:
        owner[h or ""] = max(owner.get(h or "", -1), -1 if i is None else i)
    seen = Counter()
    for r in rows:
        text = next(h or "" for i, _, h in pages if i == r.page_id)
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        seen[text, r.record_type] += 1
        if r.record_type == "response":
            assert bytes(r.payload).decode() == text and r.refers_to is None and (r.page_id is None or owner[text] == r.page_id)
        else:
            assert r.refers_to == owner[text]
    assert all(seen[t, "response"] == 1 for t in owner) and len(rows) == len(pages)
    first = {p.name: p.read_bytes() for p in (tmp_path / "a").iterdir()}
    warc.write_archives(frame, f"file://{tmp_path}/b", roll_bytes=4000)
    assert first == {p.name: p.read_bytes() for p in (tmp_path / "b").iterdir()} and not any(n.endswith(".tmp") for n in first)
    warc.write_archives(frame.where("false"), f"file://{tmp_path}/c")
    assert warc.read_archives(spark, f"file://{tmp_path}/c").count() == 0
    warc.write_archives(frame, f"file://{tmp_path}/d", min_revisit_bytes=1 << 20)
    assert warc.read_archives(spark, f"file://{tmp_path}/d").where("record_type = 'revisit'").count() == 0


# 7


def test_token_counts_against_plain_search(spark, docs, no_docs):
    scores = token_counts.piece_scores(ranks())

    def plain(word):
        best = [0]
        for end in range(1, len(word) + 1):
            best.append(max(best[k] + scores[word[k:end]] for k in range(end) if word[k:end] in scores))
        return -best[-1] & ((1 << token_counts.COUNT_BITS) - 1)

    split = bpe.Splitter()
    for r, got in zip(docs.collect(), token_counts.count_tokens(docs, PATH).collect(), strict=True):
        words = split(r.text or "")
        assert (got.doc_id, got.n_pretokens, got.n_tokens, got.n_bytes) == (r.doc_id, len(words), sum(plain(w.encode()) for w in words), len((r.text or "").encode()))
    assert token_counts.count_tokens(no_docs, PATH).count() == 0


# 8


def toxic_rows(n=240):
    rng = random.Random(8)
    bad = ["vile", "nasty", "hateful", "loathsome"]
    rows = []
    for k in range(n):
        words = prose(1000 + k, rng.randrange(1, 150), 300).split()
        y = k % 3 == 0
        for _ in range(rng.randrange(1, 4) if y else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((k, " ".join(words), int(y)))
    return rows


def test_toxicity_held_out(spark, docs, no_docs):
    rows = toxic_rows()
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (0, 1), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_on(frame, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].predicted == y for i, y in held]) >= 0.95
    long = " ".join(["calm"] * 5000 + ["vile", "nasty"] + ["calm"] * 5000)
    other = toxicity.score_toxicity(docs.union(spark.createDataFrame([(500, long, 0, "x", 0)], docs.schema)), model)
    assert other.columns == ["doc_id", "text", "kept", "n_words", "score", "predicted"]
    seen = other.collect()
    assert len(seen) == 12 and all(0 <= r.score <= 1 for r in seen) and {r.score for r in seen if not (r.text or "").strip()} == {0.0}
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    none = toxicity.fit_on(frame, labels.where("false"))
    assert toxicity.score_toxicity(frame, none).where("predicted = 1").count() == 0


def test_toxicity_gradient():
    model = toxicity.Model.new({b"a": 1, b"bb": 2})
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    windows, y = [[b"a", b"bb", b"ccc"] * 5, [b"bb"] * toxicity.WINDOW, [b"zz"]], np.array([1, 0, 1.0])

    def loss():
        words = list(dict.fromkeys(w for x in windows for w in x))
        ids = np.zeros((3, toxicity.WINDOW), int)
        for k, x in enumerate(windows):
            ids[k, : len(x)] = [words.index(w) for w in x]
        z = model.forward(model.gates(model.inputs(words).astype(np.float64)), ids, np.array([len(x) for x in windows]))
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    for name, g in model.gradient(windows, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-3
        up = loss()
        model.p[name][at] = old - 1e-3
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3 + 0.02 * abs(g[at]), name


def test_windows_cover_texts():
    for n in (1, 31, 32, 33, 48, 49, 1000):
        starts = toxicity.window_starts(n)
        assert {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


# 9


def test_html_text(spark):
    article = "<article><h1>T &amp; t</h1><p>One\n two&nbsp;three<p>Short.<div class='ad'>Buy</div><ul><li>item</li></ul></article>"
    page = f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li>Home</li></ul></nav><script>var a='</p><p>no</p>';</script>{article}<aside>side</aside><div id='comments'><p>reader words</p></div><form><p>ask</p></form><footer>foot</footer></body></html>"
    assert html_text.main_text(page) == "T & t\n\nOne two three\n\nShort.\n\nitem"
    long = "Plain words in a row that go on and on for a while. " * 3
    bare = f"<body><div class='menu'><a href=x>A</a></div><h2>Head</h2><p>{long}</p><p>tiny</p><div class=sidebar>{long}</div><div><a href=1>{long}</a></div></body>"
    assert html_text.main_text(bare) == f"Head\n\n{long.strip()}\n\ntiny"
    for odd in (None, "", "<", "<p", "<!-- x", "<script>x", "plain", "a < b > c", "<nav>only</nav>", "<p>cut <b"):
        html_text.main_text(odd)
    assert html_text.main_text(None) == html_text.main_text("<nav>only</nav>") == "" and html_text.main_text("a < b") == "a < b"
    rows = spark.createDataFrame([(1, "u", page, "old"), (1, "u", page, "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract(rows)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and [r.n_chars for r in got.orderBy("page_id").collect()] == [34, 34, 0]
    assert html_text.extract(rows.where("false")).count() == 0


# 10


def repeats_brute(rows, width):
    seen, out = set(), []
    for _, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone |= set(range(k, k + width))
            seen.add(window)
        out.append((len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("first_bits", [64, 5])
def test_substrings_against_brute_force(spark, docs, no_docs, monkeypatch, first_bits):
    """With five bits the first hash collides all the time; what goes is decided by both hashes."""
    monkeypatch.setattr(substrings, "CHUNK_ROWS", 7)
    rng = random.Random(10)
    shared = [prose(k, 30, 5000) for k in range(5)]
    texts = [" ".join([prose(100 + k, 20), rng.choice(shared), prose(200 + k, 10), rng.choice(shared)]) for k in range(60)] + ["same " * 50, "ab " * 19, "ab " * 20, "ab " * 21]
    frame = docs.union(spark.createDataFrame([(100 + k, t, 0, "x", 0) for k, t in enumerate(texts)], docs.schema))
    frame = frame.union(spark.createDataFrame([(None, texts[3], 0, "x", 0)], docs.schema)).where("doc_id is not null or text not like 'no id%'")
    got = substrings.remove_repeats(frame, first_bits=first_bits)
    assert got.columns == ["doc_id", "text", "score", "n_words", "n_removed", "removed", "kept"]
    rows = got.orderBy("doc_id").collect()
    source = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = repeats_brute(source, substrings.WINDOW)
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in rows) == sorted((repr(i), *w) for (i, _), w in zip(source, want, strict=True))
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in rows) and sum(r.n_removed > 0 for r in rows) > 50
    assert substrings.remove_repeats(no_docs).count() == 0
    assert substrings.remove_repeats(docs).count() == 11


def test_window_hashes():
    words = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 20):
        got = substrings.window_hashes(words, width)
        want = [sum(int(words[k + i]) * pow(substrings.BASE, width - 1 - i, 1 << 64) for i in range(width)) % (1 << 64) for k in range(len(words) - width + 1)]
        assert got.tolist() == want


# pipeline


def test_pipeline(spark, tmp_path, docs):
    rows = toxic_rows(150)
    item = prose(77, 30, 300)
    passage = prose(78, 60, 300)
    extra = [(1000, prose(50, 200, 300)), (1001, prose(50, 200, 300)), (1002, prose(51, 50, 300) + " " + item), (1003, prose(52, 50, 300) + " " + passage), (1004, passage + " " + prose(53, 50, 300)), (1005, prose(54, 40, 300)), (1006, None), (1007, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5) for i, t in [*((i, t) for i, t, _ in rows), *extra]], "doc_id long, text string, lang string, source string, n_chars long, score double")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = common.table(spark, str(tmp_path), "documents"), {}
    scratch = common.Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = scratch.keep(stage(spark, docs, str(tmp_path)))
        assert docs.columns == before.columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert len(seen[name]) == docs.count()
    clean = {i for i, _, y in rows if not y}
    assert len(clean - set(seen["toxicity"])) <= 2 and len(set(seen["toxicity"]) & {i for i, _, y in rows if y}) <= 4
    assert 1000 in seen["simhash"] and 1001 not in seen["simhash"] and {1006, 1007} & set(seen["simhash"]) == {1006} and seen["simhash"][1000].score == 1.5
    assert seen["substrings"][1003].text.endswith(passage) and passage not in seen["substrings"][1004].text and seen["substrings"][1004].n_chars == len(seen["substrings"][1004].text)
    assert 1002 in seen["substrings"] and 1002 not in seen["decontaminate"] and {1003, 1005, 1006} <= set(seen["decontaminate"])
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(seen["decontaminate"])
    codec = bpe.Codec(ranks())
    assert all(codec.decode(r.ids).decode() == (seen["decontaminate"][i].text or "") and r.n_tokens == len(r.ids) for i, r in out.items())


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids stay but for what is cut from them, repeated rows are one, a column that clashes comes back, no rows give none."""
    item, passage, alone = prose(77, 30, 300), prose(78, 60, 300), prose(60, 80, 300)
    odd = [(None, prose(61, 40, 300)), (None, None), (1, alone), (1, alone), (2, alone + " end"), (3, passage + " " + prose(62, 30, 300)), (4, prose(63, 30, 300) + " " + passage), (5, item), (6, "w " * 70_000 + passage)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, predicted int"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", 7) for i, t in odd], schema)
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    scratch, docs, left = common.Scratch(spark, "t"), frame, {}
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)))
        assert docs.schema.names == frame.schema.names and {(r.kept, r.predicted) for r in docs.collect()} == {("mine", 7)}
        left[name] = sorted((repr(r.doc_id), r.text or "") for r in docs.collect())
        none = stage(spark, frame.where("false"), str(tmp_path))
        assert none.count() == 0 and none.columns == frame.columns
    texts = dict(odd[2:])
    assert left["simhash"] == sorted([("None", odd[0][1]), ("None", ""), ("1", alone), *((str(k), texts[k]) for k in (3, 4, 5, 6))])
    cut = dict(left["substrings"])
    assert cut["3"] == texts[3] and cut["4"] == texts[4][: -len(passage) - 1] and cut["6"].split() == ["w"] and cut["None"] in (odd[0][1], "")
    assert [k for k, _ in left["decontaminate"]] == ["1", "3", "4", "6", "None", "None"]
    assert corpus_pipeline.tokenize(spark, docs, str(tmp_path)).count() == 6


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
