"""Language identification of code-switched text by a linear-chain conditional random field.

Each word, or ``PIECE`` characters of a script without spaces, is an observation whose features are its affixes, all its
character n-grams and the lexicons that hold it; the labels are languages, with learned transitions between neighbouring words. Forward-backward gives every word's
posterior; a text's language is the one with the largest posterior sum, its score the mean posterior.

Only texts carry labels, so training chains are made of runs of words of texts in known languages, which also shows
the model how languages alternate. Training reads a bounded sample of rows (``SAMPLE_DOCS``), drawn by hash over all
labelled rows, and the whole of their texts: every word counts for the lexicons, and every run stands in a chain once.
Prediction reads every word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sampling import sample_ids
from tidemark.llm.scratch import Scratch
from tidemark.llm.textkernel import SLICE_BYTES, Words, hash_spans, lower_ascii, mix, runs, slices, tidy

#: Rows to learn from, whose whole texts are used: so many in all, and a language at least.
SAMPLE_DOCS = (320, 8)
HASH_BITS = 16
#: Words of a training chain, and how many words of one language stand together in it.
CHAIN, RUN = 48, (6, 32)
LEXICON_WORDS = 300
EPOCHS = 12
BLOCK = 32
#: With more labels than this, chains are stepped through word by word, as a block's product has their square.
WIDE = 16
#: Words of training chains whose probabilities are held at once.
HELD = 1 << 14
#: Characters of an observation in scripts that are written without spaces.
PIECE = 2
UNDETERMINED = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # from x to
    lexicon: np.ndarray  # ordered word hashes
    lexicon_of: np.ndarray  # label of each


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of the Latin-1 range to small ones; bytes keep their places."""
    out = lower_ascii(data)
    after = np.concatenate([np.zeros(1, bool), data[:-1] == 0xC3])[: len(data)]
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    return out + (capital.astype(np.uint8) << 5)


#: First and last code points of scripts without spaces (Thai to Tibetan, Myanmar, Khmer, Tai scripts, Balinese, kana,
#: bopomofo, Han, Yi, Javanese, half-width kana), and of punctuation and digits among them.
_UNSPACED = np.array([(0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)])
_OUTSIDE = np.array([(0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x303D, 0x303F), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)])


def _among(code: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    spot = np.searchsorted(ranges[:, 0], code, side="right") - 1
    return (spot >= 0) & (code <= ranges[spot, 1])


def word_runs(data: np.ndarray, offsets: np.ndarray):
    """Words are runs of a-z and bytes beyond ASCII, punctuation (general, CJK, full-width) and U+00A0 to U+00BF left out.

    What a run holds of scripts without spaces is cut into words of ``PIECE`` characters.
    """
    inside = (data - np.uint8(97) < 26) | (data >= 0x80)
    c2 = np.flatnonzero(data == 0xC2)
    c2 = c2[c2 + 1 < len(data)]
    inside[c2] = inside[c2 + 1] = False
    at = np.flatnonzero(data >= 0xE0)  # first bytes of three or four
    size = np.where(data[at] >= 0xF0, 4, 3)
    whole = at + size <= len(data)
    at, size = at[whole], size[whole]
    if not len(at):
        return runs(inside, offsets)
    byte = lambda i: (data[np.minimum(at + i, len(data) - 1)] & 63).astype(np.int64)
    code = np.where(size == 3, (byte(0) & 15) << 12 | byte(1) << 6 | byte(2), (byte(0) & 7) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3))
    for spot in range(3):
        inside[at[_among(code, _OUTSIDE)] + spot] = False
    own = _among(code, _UNSPACED) & ~_among(code, _OUTSIDE)
    at, size = at[own], size[own]
    if not len(at):
        return runs(inside, offsets)
    text = np.searchsorted(offsets, at, side="right")
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + size[:-1]) | (text[1:] != text[:-1])
    place = np.arange(len(at))
    place = place - np.maximum.accumulate(np.where(first, place, 0))
    last = np.append(first[1:], True)
    cut = runs(inside, np.unique(np.concatenate([offsets, at[place % PIECE == 0], (at + size)[last]])))
    bounds = np.searchsorted(cut.start, offsets)
    return Words(cut.start, cut.end, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds)


#: Feature families, kept apart by a salt.
_PREFIX, _SUFFIX, _GRAM, _WORD, _LEXICON = 1, 2, 3, 4, 5
_WIDTH = 20  # bytes of a word's head whose n-grams are taken for all words side by side; those beyond come one by one
_GRAMS = 1 << 16  # n-grams beyond heads that are taken at once


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray, lexicon_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Hashed feature numbers and the words that have them, in order and possibly repeated; None stands for every word once."""
    size = end - start
    padded = np.concatenate([data, np.zeros(_WIDTH + 4, np.uint8)])
    mask = np.uint64((1 << HASH_BITS) - 1)

    def number(family: int, value: np.ndarray) -> np.ndarray:
        return (mix(value + np.uint64(family * 0x9E3779B97F4A7C15 % (1 << 64))) & mask).astype(np.int64)

    def some(family: int, value: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        return (number(family, value), None) if has.all() else (number(family, value[has]), np.flatnonzero(has))

    yield number(_WORD, hashes), None
    head = np.zeros(len(start), np.uint64)
    tail = np.zeros(len(start), np.uint64)
    for n in range(1, 5):
        head = head | padded[start + n - 1].astype(np.uint64) << np.uint64(8 * (n - 1))
        tail = tail | padded[np.maximum(end - n, 0)].astype(np.uint64) << np.uint64(8 * (n - 1))
        has = size >= n
        salt = np.uint64(n) << np.uint64(40)
        yield some(_PREFIX, head | salt, has)
        yield some(_SUFFIX, tail | salt, has)

    def grams(at: np.ndarray) -> np.ndarray:
        return padded[at].astype(np.uint64) | padded[at + 1].astype(np.uint64) << np.uint64(8) | padded[at + 2].astype(np.uint64) << np.uint64(16)

    for at in range(_WIDTH - 2):
        has = size >= at + 3
        if not has.any():
            break
        yield some(_GRAM, grams(start + at), has)
    long = np.flatnonzero(size > _WIDTH)
    more = size[long] - _WIDTH
    upto = np.cumsum(more)
    for low in range(0, int(upto[-1]) if len(long) else 0, _GRAMS):
        j = np.arange(low, min(low + _GRAMS, int(upto[-1])))
        w = np.searchsorted(upto, j, side="right")
        yield number(_GRAM, grams(start[long[w]] + _WIDTH - 2 + j - (upto - more)[w])), long[w]
    if len(lexicon):
        spot = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        yield some(_LEXICON, lexicon_of[spot].astype(np.uint64), lexicon[spot] == hashes)


def emissions(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scores of every label for every word; each distinct word is scored once."""
    hashes = hash_spans(data, start, end)
    distinct, example, back = np.unique(hashes, return_index=True, return_inverse=True)
    score = np.zeros((len(distinct), len(model.labels)), np.float32)
    for feature, own in word_features(data, start[example], end[example], distinct, model.lexicon, model.lexicon_of):
        if own is None:
            score += model.weights[feature]
        elif len(own):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            part = model.weights[feature]
            score[own[first]] += part if len(first) == len(own) else np.add.reduceat(part, first)
    return score[back]


def posteriors(score: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over the chains score[bounds[i]:bounds[i + 1]]: each word's label probabilities.

    Chains are cut into blocks; blocks are multiplied out side by side, joined in order, and filled in side by side.
    """
    total, k = score.shape
    if not total:
        return np.zeros((0, k))
    a = np.exp(transitions.astype(np.float64))
    e = np.exp((score - score.max(1, keepdims=True)).astype(np.float64))
    if k > WIDE:
        return _stepped(e, bounds, a)
    n = np.diff(bounds)
    blocks = -(-n // BLOCK)
    block_bounds = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(block_bounds[-1])
    inner = np.arange(nb) - np.repeat(block_bounds[:-1], blocks)
    first = np.repeat(bounds[:-1], blocks) + inner * BLOCK
    size = np.minimum(np.repeat(bounds[1:], blocks) - first, BLOCK)
    spot = np.minimum(first[:, None] + np.arange(BLOCK), total - 1)
    live = np.arange(BLOCK) < size[:, None]
    eb = np.where(live[:, :, None], e[spot], 1.0)

    product = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(BLOCK):
        step = (product.reshape(-1, k) @ a).reshape(nb, k, k) * eb[:, t, None, :]
        product = np.where(live[:, t, None, None], step, product)
        product /= product.max((1, 2), keepdims=True)
    ahead = np.full((nb, k), 1.0 / k)
    behind = np.ones((nb, k))
    for j in range(1, int(blocks.max()) if nb else 0):
        b = block_bounds[:-1][blocks > j] + j
        v = (ahead[b - 1][:, None, :] @ product[b - 1])[:, 0]
        ahead[b] = v / v.sum(1, keepdims=True)
    for j in range(1, int(blocks.max()) if nb else 0):
        b = block_bounds[1:][blocks > j] - 1 - j
        v = (product[b + 1] @ behind[b + 1][:, :, None])[:, :, 0]
        behind[b] = v / v.sum(1, keepdims=True)

    forward = np.empty((nb, BLOCK, k))
    v = ahead
    for t in range(BLOCK):
        step = (v @ a) * eb[:, t]
        v = np.where(live[:, t, None], step / step.sum(1, keepdims=True), v)
        forward[:, t] = v
    v = behind
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= v
        step = (v * eb[:, t]) @ a.T
        v = np.where(live[:, t, None], step / step.sum(1, keepdims=True), v)
    out = forward[live]  # block order is word order
    return out / out.sum(1, keepdims=True)


def _stepped(e: np.ndarray, bounds: np.ndarray, a: np.ndarray) -> np.ndarray:
    """As ``posteriors``, over all chains side by side, with memory for one row a word."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    first, last, n = bounds[:-1][order], bounds[1:][order] - 1, n[order]
    live = np.searchsorted(-n, -np.arange(int(n[0])), side="left")  # chains longer than t
    out = np.empty_like(e)
    for t, m in enumerate(live):
        spot = first[:m] + t
        v = (out[spot - 1] @ a if t else a.sum(0)) * e[spot]
        out[spot] = v / v.sum(1, keepdims=True)
    v = np.ones((len(n), e.shape[1]))
    for m in live:
        spot = last[:m]
        out[spot] *= v[:m]
        v[:m] = (v[:m] * e[spot]) @ a.T
        v[:m] /= v[:m].sum(1, keepdims=True)
        last = last - 1
    return out / out.sum(1, keepdims=True)


def _held(data: np.ndarray, bounds: np.ndarray, i: int) -> bool:
    """Whether text i holds a letter of any script."""
    own = data[bounds[i] : bounds[i + 1]]
    return bool(((own | 32) - np.uint8(97) < 26).any()) or (bool((own >= 0x80).any()) and any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace")))


def predict_batch(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, number of words and mean certainty of a word (its largest posterior) of each text."""
    names, scores, words_of, certain = [], [], [], []
    for piece in slices(column, SLICE_BYTES * WIDE // max(WIDE, len(model.labels))):
        data = fold_case(piece.data)
        words = word_runs(data, piece.offsets)
        p = posteriors(emissions(model, data, words.start, words.end), words.bounds, model.transitions)
        sums = np.concatenate([np.zeros((1, len(model.labels))), np.cumsum(p, 0)])
        mass = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
        sure = np.concatenate([np.zeros(1), np.cumsum(p.max(1))])
        sure = sure[words.bounds[1:]] - sure[words.bounds[:-1]]
        count = np.diff(words.bounds)
        best = mass.argmax(1)
        for i in range(len(count)):
            if not _held(piece.data, piece.offsets, i):
                names.append(UNDETERMINED)
                scores.append(0.0)
                certain.append(0.0)
            else:  # letters outside every word leave all languages equal
                names.append(model.labels[best[i]])
                scores.append(float(mass[i, best[i]] / count[i]) if count[i] else 1.0 / len(model.labels))
                certain.append(float(sure[i] / count[i]) if count[i] else 1.0 / len(model.labels))
            words_of.append(int(count[i]))
    return names, np.clip(np.asarray(scores, float), 0, 1), np.asarray(words_of, np.int64), np.clip(np.asarray(certain, float), 0, 1)


@dataclass
class Sample:
    """What the driver gets to learn from, all of it bounded by the number of labels."""

    labels: list[str]
    lexicon: np.ndarray  # ordered word hashes
    lexicon_of: np.ndarray
    runs: pd.DataFrame  # lang and run: some consecutive words, folded


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word (its hash), n of each batch."""
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for piece in slices(batch.column("text")):
            data = fold_case(piece.data)
            words = word_runs(data, piece.offsets)
            names, code = np.unique(langs[piece.first : piece.first + len(piece.offsets) - 1], return_inverse=True)
            hashes = hash_spans(data, words.start, words.end)
            for k, name in enumerate(names):
                word, n = np.unique(hashes[code[words.doc] == k], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(word), pa.string()), "word": pa.array(word.view(np.int64)), "n": pa.array(n)})


def _cut_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, order, run: the whole texts as consecutive runs, whose lengths and order come from the hash ``seed``."""
    for batch in batches:
        seeds = np.asarray(batch.column("seed")).view(np.uint64)
        for piece in slices(batch.column("text")):
            data = fold_case(piece.data)
            words = word_runs(data, piece.offsets)
            lang, order, run = [], [], []
            for d in range(len(piece.offsets) - 1):
                at, stop = int(words.bounds[d]), int(words.bounds[d + 1])
                step = mix(seeds[piece.first + d] + np.arange((stop - at) // RUN[0] + 1, dtype=np.uint64))
                ends = np.minimum(at + np.cumsum(RUN[0] + (step % np.uint64(RUN[1] - RUN[0])).astype(np.int64)), stop)
                for j, end in enumerate(ends.tolist()):
                    if at >= stop:
                        break
                    lang.append(batch.column("lang")[piece.first + d])
                    order.append(int(mix(step[j : j + 1]).view(np.int64)[0]))
                    run.append(data[words.start[at] : words.end[end - 1]].tobytes().decode("utf-8", "replace"))
                    at = end
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x.as_py() for x in lang], pa.string()), "order": pa.array(order, pa.int64()), "run": pa.array(run, pa.string())})


def training_sample(labelled: DataFrame, docs: tuple[int, int] = SAMPLE_DOCS) -> Sample:
    """From the whole texts of a few rows a language, ``docs[0]`` in all and ``docs[1]`` a language at least: lexicons
    (frequent words that one language mostly owns) and all runs of words."""
    scratch = Scratch(labelled.sparkSession, "language-id")
    languages = labelled.filter("lang IS NOT NULL").select("lang").distinct().count()
    picked = sample_ids(labelled, "lang", max(docs[1], docs[0] // max(languages, 1)))
    near = labelled.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"], "left_semi")
    # Rows that repeat an id count once.
    near = near.groupBy("doc_id", "lang").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    near = scratch.keep(near.select("lang", F.xxhash64(F.col("doc_id").cast("string")).alias("seed"), "text"), "sample")
    labels = sorted(r.lang for r in near.select("lang").distinct().collect())
    counts = scratch.keep(near.mapInArrow(tidy(_count_words), "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = F.max(F.struct("share", F.col("n").alias("own"), "lang"))
    words = shares.groupBy("word").agg(F.sum("n").alias("n"), F.sum("share").alias("shares"), best.alias("best")).filter("n >= 4 AND best.share >= 0.8 * shares").select("word", "best.lang", "best.own")
    first = lambda order, most: F.row_number().over(Window.partitionBy("lang").orderBy(*order)) <= most
    chosen = words.withColumn("ok", first((F.desc("own"), F.col("word")), LEXICON_WORDS)).filter("ok").select("word", "lang").collect()
    lexicon = np.array([r.word for r in chosen], np.int64).view(np.uint64)
    ranked = np.argsort(lexicon)
    runs = near.mapInArrow(tidy(_cut_runs), "lang string, order long, run string").toPandas()
    scratch.keep_only()
    return Sample(labels, lexicon[ranked], np.array([labels.index(r.lang) for r in chosen], np.int64)[ranked], runs.sort_values(["lang", "order", "run"], ignore_index=True))


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... n[i] of them, one after another."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def fit(sample: Sample, seed: int = 7) -> Model:
    """Maximum conditional likelihood by Adam on chains mixed from the sample's runs."""
    labels = sample.labels or [UNDETERMINED]
    rng = np.random.default_rng(seed)
    lexicon, lexicon_of = sample.lexicon, sample.lexicon_of
    column = pa.array(sample.runs["run"], pa.string())
    parts = [(p.first, fold_case(p.data), p.offsets) for p in slices(column, 1 << 40)]
    empty = Model(labels, np.zeros((1 << HASH_BITS, len(labels)), np.float32), np.zeros((len(labels),) * 2), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if not parts:
        return empty
    _, data, offsets = parts[0]
    words = word_runs(data, offsets)
    if not len(words.start):
        return empty
    hashes = hash_spans(data, words.start, words.end)
    distinct, example, word = np.unique(hashes, return_index=True, return_inverse=True)
    k = len(labels)
    features, rows = [], []
    for feature, own in word_features(data, words.start[example], words.end[example], distinct, lexicon, lexicon_of):
        features.append(feature)
        rows.append(np.arange(len(distinct)) if own is None else own)
    feature, row = np.concatenate(features), np.concatenate(rows)
    # Chains: all runs in random order, one after the other, cut every CHAIN words; the last begins again with the first.
    lang_of = np.searchsorted(labels, sample.runs["lang"].to_numpy())
    order = rng.permutation(len(words.bounds) - 1)
    length = np.diff(words.bounds)[order]
    stream = word[_ranges(words.bounds[:-1][order], length)]
    chains = -(-len(stream) // CHAIN)
    flat, tags = (np.resize(x, chains * CHAIN).reshape(chains, CHAIN) for x in (stream, np.repeat(lang_of[order], length)))
    weights = np.zeros((1 << HASH_BITS, k))
    transitions = np.zeros((k, k))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    gold = np.bincount(flat.reshape(-1) * k + tags.reshape(-1), minlength=len(distinct) * k).reshape(-1, k)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (tags[:, :-1].reshape(-1), tags[:, 1:].reshape(-1)), 1)
    for step in range(1, EPOCHS + 1):
        score = np.zeros((len(distinct), k))
        for c in range(k):
            score[:, c] = np.bincount(row, weights[feature, c], minlength=len(distinct))
        e_of = np.exp(score - score.max(1, keepdims=True))
        a = np.exp(transitions)
        expected, joint = np.zeros((len(distinct), k)), np.zeros((k, k))
        for low in range(0, chains, HELD // CHAIN):
            own = flat[low : low + HELD // CHAIN]
            e = e_of[own]
            forward, backward = np.empty_like(e), np.empty_like(e)
            v = np.full((len(own), k), 1.0 / k)
            for t in range(CHAIN):
                v = (v @ a if t else v) * e[:, t]
                v /= v.sum(1, keepdims=True)
                forward[:, t] = v
            v = np.ones((len(own), k))
            for t in range(CHAIN - 1, -1, -1):
                backward[:, t] = v
                v = (v * e[:, t]) @ a.T
                v /= v.sum(1, keepdims=True)
            p = forward * backward
            p /= p.sum(2, keepdims=True)
            seen, at = np.unique(own, return_inverse=True)
            expected[seen] += np.stack([np.bincount(at.reshape(-1), p[:, :, c].reshape(-1), minlength=len(seen)) for c in range(k)], 1)
            left, right = forward[:, :-1].reshape(-1, k), (backward[:, 1:] * e[:, 1:]).reshape(-1, k)
            joint += a * ((left / ((left @ a) * right).sum(1, keepdims=True)).T @ right)
        drift = gold - expected
        slope = np.stack([np.bincount(feature, drift[row, c], minlength=1 << HASH_BITS) for c in range(k)], 1) / chains - 1e-3 * weights
        slope_t = (gold_pairs - joint) / chains - 1e-3 * transitions
        for x, g, m, s in ((weights, slope, moments[0], moments[1]), (transitions, slope_t, moments[2], moments[3])):
            m += 0.1 * (g - m)
            s += 0.02 * (g * g - s)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-6)
    return Model(labels, weights.astype(np.float32), transitions, lexicon, lexicon_of)


_VERDICT = (("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("n_words", "long", pa.int64()), ("certainty", "double", pa.float64()))


def _run(model: Model, least: float | None = None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict_batch(model, batch.column("text"))
            if least is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, v[2]) for c, v in zip(found, _VERDICT))], ["doc_id", *(v[0] for v in _VERDICT)])
            else:
                yield batch.filter(pa.array((np.asarray(found[0], object) != UNDETERMINED) & (found[3] >= least)))

    return run


def keep_certain(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows whose words are at least ``least`` certain, on average, of some known language, with all their columns.

    Texts that are null or have no letters go. Each row is judged where it is read, so that nothing is shuffled and rows
    without an id, or of one id, are told apart.
    """
    return docs.mapInArrow(tidy(_run(model, least)), docs.schema)


def train(labelled: DataFrame, docs: tuple[int, int] = SAMPLE_DOCS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of some of the given rows: ``docs[0]`` in all, ``docs[1]`` a language at least."""
    return fit(training_sample(labelled, docs))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", certainty: bool = False) -> DataFrame:
    """One row per row: doc_id, lang_pred, score (0 to 1) and n_words, from every word of the text alone;
    with ``certainty`` also the mean over words of the largest posterior, high where each word is of some known language.

    A null text, or one without a letter, is ``und`` with score 0; letters in no word the model sees give an even
    score; ties go to the first language in order; repeated rows each give a row; a null id stays null; an empty table
    gives an empty result; other columns are ignored. Without any labelled row every text with letters is ``und``.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(tidy(_run(model)), f"doc_id {kind}, " + ", ".join(f"{v[0]} {v[1]}" for v in _VERDICT))
    return out if certainty else out.drop("certainty")


def held_out(id_col: str = "doc_id"):
    """The fifth of the rows from which nothing is learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
