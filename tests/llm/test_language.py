"""Spelling variants, language-model scores and whitening against plain versions, on small tables with odd rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, documents
from tidemark.llm import language_model, scratch, spelling, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Spelling


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    form = {}
    out = {}
    for w, n in counts.items():
        beside = [v for v in counts if v != w and near(v, w)]
        best = min(beside, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [n, len(beside)]
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w], counts[form[w]] if form[w] else None)
    return out


def test_variants_equal_the_plain_version(spark):
    letters = ["banana", "bananna", "banan", "bananaé", "Bananas", "xanana", "xbnana", "anabanana", "aaaaaa", "aaaaaaa", "aaaaab", "aaabaa", "×÷ÿéèÀ"]
    texts = [*ODD, *(" ".join([w] * n) for w, n in zip(letters, (5, 30, 9, 150, 800, 6, 5, 6, 25, 5, 125, 5, 9))), "banana" * 3, "theébanana,banana-banana 1banana2"]
    rows = list(enumerate(texts))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(documents(spark, texts)).collect()}
    assert got == plain_variants(plain_words(rows)) and any(r[0] and r[1] != r[0] for r in got.values())


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=6), min_size=2, max_size=40, unique=True), st.integers(0, 1000))
def test_neighbours_of_any_words(spark, words, seed):
    counts = {w: int(n) for w, n in zip(words, np.random.default_rng(seed).zipf(1.3, len(words)).clip(1, 10**6))}
    found = spelling.group_variants(spark.createDataFrame([(w, n, 1.0) for w, n in counts.items()], "word string, n long, key double"))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()} == plain_variants(counts)


def test_chains_are_followed_to_the_end(spark):
    words = [("a" * k, 5**k) for k in range(1, 12)]
    got = {r.word: r.root for r in spelling.group_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 11}


def test_damage_can_be_recomputed_and_odd_tables(spark):
    texts = [" ".join(f"letters{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400))] * 6
    ids = [None, None, 3, 3, 4, 5]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.word: r.n for r in spelling.spelling_variants(docs).collect()}
    assert got == plain_words(zip(ids, texts)) and min(got.values()) == 5
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
    whole = spelling.count_words(spelling.words(docs, flaw_every=None), 6)
    assert whole.count() == 400


# Language model


def plain_scores(rows):
    """All contexts kept apart in dictionaries, one bit after the other: the model as it is described."""
    L = language_model
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    texts = held.count(False)
    order = sorted((w for w in counts if counts[w] >= L.LEAST_CODED), key=lambda w: (-counts[w], w))[: L.HEAD]
    index = {w: i for i, w in enumerate(order)}
    after = np.zeros((256, 257), np.int64)
    for w in counts:
        if w not in index:
            for a, b in itertools.pairwise([0, *w.encode(), 256]):
                after[a, b] += counts[w]
    spelled = sum(n for w, n in counts.items() if w not in index)
    own = L.huffman(np.array([*(counts[w] for w in order), texts + 1, spelled + 1]))
    letters = [L.huffman(row + 1) for row in after]
    end = len(order)

    def bits(ws):
        marker = 0
        for i, w in enumerate([*ws, None]):
            prev = ws[i - 1] if i else None
            known = None if prev is None else index[prev] if index.get(prev, L.KNOWN) < L.KNOWN else prev.encode()[-3:]
            if prev in index and index[prev] < min(L.MARKERS, end):
                marker = index[prev] + 1
            at = end if w is None else index.get(w)
            code = int(own[end + 1 if at is None else at])
            deep = code.bit_length() - 1
            for k in range(deep):
                node = code >> (deep - k)
                yield int(k >= 3), (code >> (deep - k - 1)) & 1, [("w", node), ("m", marker, node), ("p", known, node)]
            if at is None:
                raw = w.encode()
                for k in range(len(raw) + 1):
                    code = int(letters[raw[k - 1] if k else 0][raw[k] if k < len(raw) else 256])
                    deep = code.bit_length() - 1
                    for j in range(deep):
                        node = code >> (deep - j)
                        yield 2, (code >> (deep - j - 1)) & 1, [(r, raw[max(0, k - o) : k], marker if r == 0 else 0, node) for r, o in enumerate(L.ORDERS)]

    seen = Counter()
    for ws, h in zip(words, held):
        if not h:
            seen.update((c, y) for _, y, cs in bits(ws) for c in cs)
    total, distinct = sum(counts.values()) + texts, len(counts) + (texts > 0)
    out = []
    for ws, h in zip(words, held):
        w, score, done = {}, 0.0, 0
        for kind, y, cs in bits(ws):
            if done % L.BLOCK == 0:
                w = {}
            done += 1
            x = [round(math.log((seen[c, 1] + L.PRIOR) / (seen[c, 0] + L.PRIOR)) * L._SCALE) / L._SCALE for c in cs]
            gate = (kind, *((x[r] != 0) + (abs(x[r]) > 2) for r in (1, 2)))
            own_w = w.setdefault(gate, [L.FIRST_WEIGHT] * 3)
            p = 1 / (1 + math.exp(-max(-20, min(20, sum(a * b for a, b in zip(own_w, x))))))
            score += math.log10(p if y else 1 - p)
            w[gate] = [a + float(L.RATE) * (y - p) * b for a, b in zip(own_w, x)]
        c = [counts[v] for v in ws] + [texts]
        out.append((h, len(c), sum(v > 0 for v in c), total, sum(math.log10((v + 1) / (total + distinct + 1)) for v in c), score))
    return out


@pytest.mark.parametrize("head", [4, 50, 1 << 16])
def test_scores_equal_the_plain_version(spark, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    texts = [*ODD[:-1], "the cat sat on the mat and the dog sat on the cat", "THE the Theé 漢字", "a " * 700 + "zebra", *(f"word{i} the word{i % 3}" for i in range(30))]
    got = {r.doc_id: r for r in language_model.score_texts(documents(spark, texts)).collect()}
    for i, want in enumerate(plain_scores(list(enumerate(texts)))):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9, abs=1e-9) and r.score == pytest.approx(want[5], rel=1e-3, abs=1e-3)
        n_bytes = len((texts[i] or "").encode())
        assert r.bits_per_byte is None if not n_bytes else r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / n_bytes)


def test_codes_are_prefix_free_and_short():
    weights = np.array([50, 1, 1, 20, 7, 7, 0])
    codes = [bin(c)[3:] for c in language_model.huffman(weights)]
    assert sum(2.0 ** -len(c) for c in codes) == 1 and not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert len(codes[0]) == 1 and len(codes[6]) == max(map(len, codes))


def test_probabilities_of_all_continuations_add_up():
    """Each bit's two outcomes share its probability, whatever the weights have become."""
    rng = np.random.default_rng(1)
    x = [rng.integers(-9000, 9000, 60).astype(np.int16) for _ in range(3)]
    gate = rng.integers(0, 27, 60).astype(np.int16)
    for at in (0, 31, 59):
        flip = [c.copy() for c in x]
        for c in flip:
            c[at] = -c[at]
        one, two = (language_model.mix_bits([c[: at + 1] for c in s], gate[: at + 1], np.array([0, at + 1])) for s in (x, flip))
        before = language_model.mix_bits([c[:at] for c in x], gate[:at], np.array([0, at]))
        assert 10 ** (one[0] - before[0]) + 10 ** (two[0] - before[0]) == pytest.approx(1, abs=1e-6)


def test_the_model_beats_token_frequencies_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = language_model.score_texts(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.95 * r[1]


def test_scores_of_odd_tables(spark):
    docs = documents(spark, ["a b", None, ""])
    assert language_model.score_texts(docs.limit(0)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    only = spark.createDataFrame([(i, "un mot") for i in held], "doc_id long, text string")
    for r in language_model.score_texts(only).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0
    same = language_model.score_texts(docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))).collect()
    assert len(same) == 6 and sum(r.doc_id is None for r in same) == 2 and not any(r.held_out for r in same if r.doc_id is None)
    assert len({(r.n_tokens, round(r.score, 9)) for r in same}) == 2


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, x string, component double")


def plain_components(rows, k=32):
    x = np.floor(64 * np.array(rows, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    z = x - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    return x, n, s, z, e[::-1][:k], v[:, ::-1][:, :k], np.trace(z.T @ z / n)


@pytest.mark.parametrize("dim", [3, 40, 150])
def test_whitening_equals_the_plain_version(spark, dim):
    rng = np.random.default_rng(dim)
    rows = (rng.standard_normal((300, dim)) * np.linspace(3, 0.5, dim) + 5).astype(np.float32).tolist()
    odd = [None, [], [None] * dim, [float("nan")] + [0.0] * (dim - 1), [float("inf")] * dim, [1.0] * (dim + 1)]
    k = min(dim, 32)
    x, n, s, z, e, v, total = plain_components(rows)
    got = whitening.whiten(vectors(spark, rows + odd)).collect()
    assert len(got) == 300 * k
    w, share = np.zeros((300, k)), np.zeros(k)
    for r in got:
        w[r.vec_id, r.component - 1], share[r.component - 1] = r.whitened, r.explained
        assert r.n == 300 and r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum()) and r.identity_error < 1e-9 and r.residual < 1e-10
    assert np.allclose(share, e / total, rtol=1e-12)
    want = z @ v / np.sqrt(e)
    sign = np.sign((w * want).sum(0))
    assert np.allclose(w, want * sign, atol=1e-7)


def test_whitening_of_odd_tables(spark):
    one = vectors(spark, [[1.0, 2.0]])
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [[1.0, 2.0]] * 5)).count() == 0
    flat = whitening.whiten(vectors(spark, [[0.0, 1.0, 1.0], [1.0, 1.0, 1.0], [2.0, 1.0, 1.0], [2.0, 1.0, 1.0]])).collect()
    assert [r.component for r in flat] == [1] * 4 and all(r.explained == pytest.approx(1) for r in flat)
    huge = whitening.whiten(vectors(spark, [[3e10, 0.0], [-3e10, 1.0], [0.0, 2.0]])).collect()
    assert {r.deviation for r in huge} == {None, int(sum((3 * a - b) ** 2 for a, b in zip((1_000_000, 1_000_128), (3_000_000, 3_000_192))))}


def test_exact_sums_and_steps(spark):
    rows = [[2**61, -5, 7]] * 9 + [[-(2**61) + 1, 3, 7]] * 2
    mean = whitening.centre(spark.createDataFrame([(r,) for r in rows], "x array<long>"))
    sums = [sum(r[i] for r in rows) for i in range(3)]
    assert [int(q) * 11 + int(r) for q, r in zip(mean.whole, mean.rest)] == sums


def test_results_leave_no_folder_behind_but_their_own(spark):
    assert scratch.shared_root(spark).startswith("file:")


def test_base_scores_need_no_predictors(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b word{i % 7} b") for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, language_model.score_texts(docs).select("doc_id", "n_tokens", "n_known", "base_score").collect()))
    monkeypatch.delattr(language_model, "learn_tables")
    rows = language_model.score_texts(docs, mixed=False).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in rows) == want and all(r.score is None for r in rows)


def test_vocabulary_is_met_once_a_slice(monkeypatch):
    """Looking words up builds a table of the vocabulary, whose cost must not recur with every few texts."""
    import pyarrow as pa

    vocabulary = language_model.Vocabulary.of(["a", "bc"], [20, 9], 3, 5, 4, np.zeros((256, 257), np.int64))
    shared = type("Shared", (), {"value": vocabulary})
    texts = pa.array(["a bc other " * 900] * 100)
    calls, plain = [], language_model.pc.index_in
    monkeypatch.setattr(language_model.pc, "index_in", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert list(language_model._count_slots(shared)([pa.RecordBatch.from_arrays([texts], ["text"])])) and len(calls) == 1
    tokens, _ = language_model.tokens_of(next(language_model.slices(texts)), vocabulary)
    whole, parts = language_model.bits_of(tokens, vocabulary), [language_model.bits_of(p, vocabulary) for p in language_model.pieces_of(tokens)]
    assert len(parts) > 9 and all(np.array_equal(a, np.concatenate(b)) for a, b in zip(whole.slots, zip(*(p.slots for p in parts))))


def test_only_the_mixing_asks_for_kinds():
    import pyarrow as pa

    vocabulary = language_model.Vocabulary.of(["a", "bc"], [20, 9], 3, 5, 4, np.zeros((256, 257), np.int64))
    tokens, _ = language_model.tokens_of(next(language_model.slices(pa.array(["a bc other " * 9]))), vocabulary)
    plain, spare = language_model.bits_of(tokens, vocabulary), language_model.bits_of(tokens, vocabulary, kinds=False)
    assert spare.kind is None and len(plain.kind) == len(plain.outcome) and all(map(np.array_equal, plain.slots, spare.slots))
