"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary and on toxic text. The toxic one keeps of its trained strings
the beginnings whose share of toxic texts is significantly larger than their share of ordinary ones, ahead of the
ordinary content, so that the two compress alike but for what is special to toxic text. Each window of a text (``WINDOW`` words) is compressed
with both; the bytes that the toxic dictionary saves are the window's distance. A logistic curve fitted on labelled
texts turns a text's largest, mean and repeated savings into a score, calibrated so that 0.5 separates the classes.

Training reads a bounded sample of rows, up to ``SAMPLE_DOCS`` labelled texts a class, drawn by hash, and all of their
texts: dictionaries are trained on all their windows, and strings are counted and texts measured whole, in tasks. The intercept is moved from the sample's mix of classes to
that of all labelled texts, which are counted. Scoring reads whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sampling import sample_ids
from tidemark.llm.scratch import Scratch
from tidemark.llm.textkernel import is_space, lower_ascii, runs, slices

WINDOW = 16
SAMPLE_DOCS = 1000
ORDINARY_BYTES, TOXIC_BYTES = 16384, 16384
#: Significance (likelihood ratio) of a string's excess in toxic texts, and how many times more frequent it must be.
EXCESS, TIMES = 25.0, 8.0
#: Bytes of a string kept beyond its significant beginning, as a short one alone is below the least match.
BEYOND = 2


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept


class _Meter:
    """Bytes saved by the toxic dictionary in each window of texts."""

    def __init__(self, model: Model):
        self._pair = [self._compressor(model.ordinary), self._compressor(model.toxic + model.ordinary)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters.from_level(
            7, source_size=128, dict_size=len(content), min_match=6, search_log=7, hash_log=16, chain_log=16, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        own = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=own, compression_params=settings)

    def savings(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        segments = np.empty((len(start), 2), np.uint64)
        segments[:, 0], segments[:, 1] = start, length
        windows = zstandard.BufferWithSegments(data.tobytes(), segments.tobytes())
        sizes = []
        for c in self._pair:
            packed = c.multi_compress_to_buffer(windows, threads=1)
            sizes.append(np.fromiter((len(packed[i]) for i in range(len(packed))), np.int64, len(packed)))
        return sizes[0] - sizes[1]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of each text's windows of ``WINDOW`` words, with the space around them, and their bounds."""
    words = runs(data != 32, offsets)
    n = np.diff(words.bounds)
    per = -(-n // WINDOW)
    bounds = np.concatenate([[0], np.cumsum(per)])
    inner = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per)
    first = np.repeat(words.bounds[:-1], per) + inner * WINDOW
    last = np.minimum(first + WINDOW, np.repeat(words.bounds[1:], per)) - 1
    low, high = np.repeat(offsets[:-1], per), np.repeat(offsets[1:], per)
    start = np.maximum(words.start[first] - 1, low)
    end = np.minimum(words.end[last] + 1, high)
    return start, end - start, bounds


def _flat(piece) -> np.ndarray:
    data = lower_ascii(piece.data)
    data[is_space(data)] = 32
    return data


FEATURES = 5


def describe(meter: _Meter, column: pa.Array) -> np.ndarray:
    """Each text's features: largest saving, mean of the three largest, mean, windows with a clear saving, log of their number."""
    out = []
    for piece in slices(column):
        data = _flat(piece)
        start, length, bounds = windows(data, piece.offsets)
        saved = meter.savings(data, start, length) if len(start) else np.zeros(0, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = saved[a:b]
            if a == b:
                out.append((0.0, 0.0, 0.0, 0.0, 0.0))
                continue
            top = np.sort(own)[::-1][:3]
            out.append((float(min(top[0], 12)), float(np.minimum(top, 12).mean()), float(own.mean()), math.log1p(float((own >= 3).sum())), math.log1p(b - a)))
    return np.asarray(out, float).reshape(-1, FEATURES)


def _excess(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of a of n against b of m, 0 unless the first share is ``TIMES`` the second."""
    if a * m <= TIMES * (b + 0.5) * n:
        return 0.0
    p = (a + b) / (n + m)
    part = lambda k, t: (k * math.log(k / t / p) if k else 0.0) + ((t - k) * math.log((t - k) / t / (1 - p)) if t > k else 0.0)
    return 2 * (part(a, n) + part(b, m))


def _strings(trained: bytes) -> set[bytes]:
    return {w for w in trained.split() if 3 < len(w) <= 32}


def _heads(word: bytes) -> list[bytes]:
    return [word[:n] for n in range(4, min(len(word), 32) + 1)]


def _count_heads(heads: set[bytes]):
    """toxic, head, n: in how many texts of a batch a word begins with each of some strings."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            marks = batch.column("toxic").to_pylist()
            for piece in slices(batch.column("text")):
                raw = _flat(piece).tobytes()
                for i, (a, b) in enumerate(zip(piece.offsets[:-1], piece.offsets[1:])):
                    seen: set[bytes] = set()
                    for w in set(raw[a:b].split()):
                        seen.update(_heads(w))
                    found.update((marks[piece.first + i], h) for h in seen & heads)
            yield pa.RecordBatch.from_pydict({"toxic": pa.array([k[0] for k in found], pa.int32()), "head": pa.array([k[1] for k in found], pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    return run


def _special(trained: bytes, near: DataFrame, texts: tuple[int, int]) -> bytes:
    """What the trained strings have that is special to toxic text: of each, the beginning whose excess is most significant."""
    strings = _strings(trained)
    heads = {h for w in strings for h in _heads(w)}
    found = near.mapInArrow(_count_heads(heads), "toxic int, head binary, n long").groupBy("toxic", "head").agg(F.sum("n").alias("n")).collect()
    count = {(r.toxic, bytes(r.head)): r.n for r in found}
    excess = {h: _excess(count.get((1, h), 0), texts[1], count.get((0, h), 0), texts[0]) for h in heads}
    best = {w: max(_heads(w), key=lambda h: (excess[h], len(h))) for w in strings}
    kept = sorted({w[: len(h) + BEYOND] for w, h in best.items() if excess[h] > EXCESS})
    return b" " + b" ".join(kept) + b" " if kept else b""


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method; classes keep their own weights, so that 0.5 means likelier toxic than not in the given mix."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _marks(labels: DataFrame) -> DataFrame:
    """One mark, the worst, of each labelled id."""
    return labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def class_counts(docs: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """How many ordinary and toxic documents are labelled."""
    found = {r.toxic: r["count"] for r in _marks(labels).join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("toxic").count().collect()}
    return found.get(0, 0), found.get(1, 0)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> DataFrame:
    """``text`` and ``toxic`` of up to ``per_class`` labelled texts of each class, picked by a hash of their ids; equal texts count once."""
    picked = sample_ids(_marks(labels), "toxic", per_class)
    near = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # at most ``per_class`` ids a class
    near = near.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    return near.groupBy("text").agg(F.min_by("toxic", "doc_id").alias("toxic"), F.min("doc_id").cast("string").alias("first"))


def _cut_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, window: all windows of whole texts."""
    for batch in batches:
        marks = np.asarray(batch.column("toxic"))
        for piece in slices(batch.column("text")):
            data = _flat(piece)
            start, length, bounds = windows(data, piece.offsets)
            raw = data.tobytes()
            toxic = np.repeat(marks[piece.first : piece.first + len(bounds) - 1], np.diff(bounds))
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(toxic, pa.int32()), "window": pa.array([raw[s : s + n] for s, n in zip(start.tolist(), length.tolist())], pa.binary())})


def _measure(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(model)
        for batch in batches:
            x = describe(meter, batch.column("text"))
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "first": batch.column("first"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    return run


def _trained(windows_of: list[bytes], size: int, k: int, d: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, windows_of, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b" ".join(windows_of)[:size]


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, counts: tuple[int, int] | None = None) -> Model:
    """Dictionaries and calibration from labelled texts; with under 8 texts of a class every score is the share of toxic ones.

    Of an id's labels the worst counts, and of its texts the first in order. ``counts`` are the ordinary and toxic
    documents that the sample stands for, all that are labelled by default.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    near = scratch.keep(training_sample(docs, labels, per_class), "sample")
    found = {r.toxic: r["count"] for r in near.groupBy("toxic").count().collect()}
    texts = found.get(0, 0), found.get(1, 0)
    n0, n1 = counts or class_counts(docs, labels)
    share = (n1 + 0.5) / (n0 + n1 + 1)
    flat = Model(b"", b"", np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(FEATURES), math.log(share / (1 - share)) if n1 else -9.0))
    if min(texts) < 8:
        return flat
    cut = near.mapInArrow(_cut_windows, "toxic int, window binary").filter(F.length("window") >= 8)
    # All windows of the sampled rows, in an order that does not hang on how they were read.
    drawn = cut.withColumn("h", F.xxhash64("window")).toPandas().sort_values(["toxic", "h", "window"])
    of_ordinary, of_toxic = ([bytes(w) for w in drawn[drawn["toxic"] == mark]["window"]] for mark in (0, 1))
    content = _trained(of_ordinary, ORDINARY_BYTES, 32, 8)
    raw = b" ".join(_trained(of_toxic, TOXIC_BYTES, k, d) for k, d in ((16, 6), (32, 8)))
    model = Model(content, _special(raw, near, texts), flat.center, flat.scale, flat.weights)
    measured = near.mapInArrow(_measure(model), "toxic int, first string, x array<double>").toPandas().sort_values("first")
    x = np.stack(measured["x"].to_numpy())
    model.center, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.center) / model.scale, measured["toxic"].to_numpy(float))
    model.weights[-1] += math.log(n1 / n0) - math.log(texts[1] / texts[0])
    scratch.keep_only()
    return model


def _run(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = _Meter(model)
        for batch in batches:
            x = (describe(meter, batch.column("text")) - model.center) / model.scale
            score = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, score (0 to 1) and predicted (1 from 0.5 on), from the whole text alone.

    A null text counts as empty and has the score of a text without savings; repeated rows each give a row; a null id
    stays null; an empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(_run(model), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
