"""Language-model scores: hashed-context bit predictors mixed online, over the tokens of whole texts.

A text is a sequence of tokens, its words and an end. The commonest words are coded by a Huffman code; any other word is
an escape followed by its bytes, coded likewise. Each bit of a code is predicted by several contexts, whose counts over
all training texts lie in hashed tables of fixed size; a set of weights, chosen by how sure the contexts are, combines
the predictions in the logistic domain, and is refined after every bit. The sum of the bits' log-probabilities is the
score, a probability over all texts. Beside it stands the score by token frequencies alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import Scratch
from tidemark.llm.textkernel import is_space, lower_ascii, mix, runs, slices, tidy

#: Words with a code of their own; all others are spelled.
HEAD = 1 << 16
#: Rarer words are spelled, so that new words are spelled by contexts that have seen rare ones.
LEAST_CODED = 8
#: Words so frequent that the last one seen tells the kind of text.
MARKERS = 256
#: Words that stand for themselves as the word before; of others the last three bytes do.
KNOWN = 4096
#: Bytes of a spelled word that its contexts hold, the first beside the marker.
ORDERS = (2, 4, 6)
#: Slots of each predictor's table, as powers of two.
TABLE_BITS = (20, 22, 22)
#: Added to both counts of a slot.
PRIOR = 0.2
#: Bits after which weights start anew, and the rate at which they learn.
BLOCK, RATE, FIRST_WEIGHT = 2048, np.float32(0.05), 0.4
#: Bytes of text that are mixed at a time, and coded at a time: what is worked out for each bit should stay in a processor's cache.
SLICE, PIECE = 1 << 20, 1 << 15
_CHUNK = 2048
_SCALE = 2000.0
#: A prediction, in the logistic domain, that counts as sure.
SURE = int(2 * _SCALE)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PAD = 8


def huffman(weights: np.ndarray) -> np.ndarray:
    """A prefix code: for each symbol a one followed by the bits of its code, as an integer; equal weights go by symbol.

    Codes are canonical, of the lengths of a Huffman code, so a way down the tree is read off the integer's bits.
    """
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, np.int64)
    for inner in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = inner
        heapq.heappush(heap, (a[0] + b[0], inner))
    length = np.zeros(2 * n - 1, np.int64)
    for at in range(2 * n - 3, -1, -1):
        length[at] = length[parent[at]] + 1
    out, code, before = np.zeros(n, np.int64), 0, 0
    for symbol in np.argsort(length[:n], kind="stable"):
        bits = int(length[symbol])
        code <<= bits - before
        out[symbol], before = code | (1 << bits), bits
        code += 1
    return out


@dataclass(frozen=True)
class Vocabulary:
    """The coded words, most frequent first; then the symbols end and escape, the 256 bytes, and the end of a spelled word."""

    words: pa.Array
    codes: np.ndarray  # of words, end and escape; then, for each byte before (0 at a word's beginning), of 256 bytes and a word's end
    counts: np.ndarray  # of the words, then of end
    total: int  # training tokens
    distinct: int  # distinct training tokens

    @property
    def end(self) -> int:
        return len(self.words)

    @classmethod
    def of(cls, words: list[str], counts: list[int], spelled: int, ends: int, distinct: int, byte_counts: np.ndarray) -> Vocabulary:
        """``spelled``: training tokens that are no coded word; ``byte_counts``: how often each byte, or the end (256), follows each byte in these."""
        codes = np.concatenate([huffman(np.array([*counts, ends + 1, spelled + 1])), *(huffman(after + 1) for after in byte_counts)])
        return cls(pa.array(words, pa.large_string()), codes, np.array([*counts, ends], np.int64), sum(counts) + spelled + ends, distinct)


class Tokens(NamedTuple):
    """The tokens of a slice of texts: an id (-1 for a word without a code), the place of its bytes, and each text's bounds."""

    ids: np.ndarray
    start: np.ndarray
    size: np.ndarray
    data: np.ndarray
    bounds: np.ndarray


def words_of(piece) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased words of a slice as one string array, the bounds of each text's words, and all their bytes."""
    data = lower_ascii(piece.data)
    found = runs(~is_space(data), piece.offsets)
    body = np.ascontiguousarray(data[~is_space(data)])
    offsets = np.concatenate([[0], np.cumsum(found.end - found.start)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(found.start), pa.py_buffer(offsets), pa.py_buffer(body)), found.bounds, body


def tokens_of(piece, vocabulary: Vocabulary) -> tuple[Tokens, pa.Array]:
    words, bounds, body = words_of(piece)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    known = pc.index_in(words, value_set=vocabulary.words).fill_null(-1)
    texts = len(bounds) - 1
    to = np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(bounds))  # an end follows each text's words
    ids = np.full(len(words) + texts, vocabulary.end, np.int64)
    ids[to] = np.asarray(known)
    start, size = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    start[to], size[to] = offsets[:-1], np.diff(offsets)
    return Tokens(ids, start, size, body, bounds + np.arange(texts + 1)), words


def pieces_of(tokens: Tokens) -> Iterator[Tokens]:
    """The tokens of runs of whole texts, at most ``PIECE`` bytes of words together unless one text is longer."""
    upto = np.concatenate([[0], np.cumsum(tokens.size)])[tokens.bounds]
    at, texts = 0, len(tokens.bounds) - 1
    while at < texts:
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PIECE, side="right")) - 1)
        own = slice(tokens.bounds[at], tokens.bounds[stop])
        start = np.where(tokens.size[own] > 0, tokens.start[own] - upto[at], 0)
        yield Tokens(tokens.ids[own], start, tokens.size[own], tokens.data[upto[at] : upto[stop]], tokens.bounds[at : stop + 1] - tokens.bounds[at])
        at = stop


class Bits(NamedTuple):
    """Every decision of a slice: the slots of its contexts, its outcome, its kind, and the bounds of each text's decisions."""

    slots: tuple[np.ndarray, ...]
    outcome: np.ndarray
    kind: np.ndarray | None
    bounds: np.ndarray


def bits_of(tokens: Tokens, vocabulary: Vocabulary, kinds: bool = True) -> Bits:
    """The decisions of a slice; their kinds, which only the mixing needs, on request. Contexts of a word: none, the last marker, the word before. Of a spelled byte: as many of the word's bytes before it as ``ORDERS`` says."""
    ids, n = tokens.ids, len(tokens.ids)
    end = vocabulary.end
    # the last marker before a token, and what is kept of the word before, within its text
    begin = np.repeat(tokens.bounds[:-1], np.diff(tokens.bounds))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where((ids >= 0) & (ids < min(MARKERS, end)), np.arange(n), -1))[:-1]])
    marker = np.where(last >= begin, ids[np.maximum(last, 0)] + 1, 0).astype(np.uint64)
    padded = np.concatenate([np.zeros(_PAD, np.uint8), tokens.data, np.zeros(_PAD, np.uint8)])
    before8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes before a place
    ending = before8[tokens.start + tokens.size] >> (8 * (8 - np.minimum(np.maximum(tokens.size, 1), 3))).astype(np.uint64)
    own = np.where((ids >= 0) & (ids < KNOWN), ids.astype(np.uint64), ending + np.uint64(KNOWN))
    before = np.where(np.arange(n) == begin, np.uint64(1 << 40), np.concatenate([own[:1], own[:-1]]))
    # symbols: a word's own, or an escape, bytes and an end
    size = np.where(ids >= 0, 1, tokens.size + 2)
    upto = np.cumsum(size)
    token = np.repeat(np.arange(n), size)
    place = np.arange(len(token)) - (upto - size)[token]
    spelled = place > 0
    symbol = np.where(ids >= 0, ids, end + 1)[token]
    inner = np.flatnonzero(spelled)
    own, k = token[inner], place[inner]
    where = tokens.start[own] + k - 1
    window = before8[where]
    previous = np.where(k > 1, padded[where + _PAD - 1], np.uint8(0)).astype(np.int64)
    symbol[inner] = end + 2 + 257 * previous + np.where(k <= tokens.size[own], padded[where + _PAD], np.uint16(256))
    context = np.zeros((3, len(token)), np.uint64)
    context[1], context[2] = (marker + np.uint64(7))[token], (before + np.uint64(1 << 41))[token]
    for row, order in enumerate(ORDERS):
        cut = (8 * (8 - np.minimum(order, k - 1))).astype(np.uint64)
        tail = np.where(cut < 64, window >> np.minimum(cut, np.uint64(63)), np.uint64(0))
        context[row, inner] = tail * np.uint64(1024) + np.uint64(512) + (marker[own] if row == 0 else np.uint64(row))
    context = mix(context + np.arange(3, dtype=np.uint64)[:, None] * _ODD)
    # decisions: what is left of a code's bits tells the node, and the next bit the outcome
    codes = vocabulary.codes[symbol]
    deep = np.frexp(codes.astype(np.float64))[1] - 1  # the place of the leading one
    ends = np.cumsum(deep)
    which = np.arange(len(symbol)).repeat(deep)
    left = ends.take(which)
    left -= np.arange(len(left))
    codes = codes.take(which)
    node = (codes >> left).view(np.uint64)
    node *= np.uint64(0xD6E8FEB86659FD93)
    left -= 1
    outcome = codes >> left
    outcome &= 1
    slots = []
    for row, b in zip(context, TABLE_BITS):
        slot = row.take(which)
        slot ^= node
        slot *= _ODD
        slot >>= np.uint64(64 - b)
        slots.append(slot.view(np.int64))
    # a word's own bits: whether they are its code's first three
    kind = None
    if kinds:
        kind = np.where(spelled, np.int8(2), np.int8(0)).take(which)
        kind += left < np.where(spelled, -1, deep - 3).astype(np.int8).take(which)
    totals = np.concatenate([[0], ends])
    by_token = totals[np.concatenate([[0], upto])]
    return Bits(tuple(slots), outcome, kind, by_token[tokens.bounds])


#: Sets of weights.
GATES = 27


def inputs_of(bits: Bits, tables: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each context's prediction of the outcome that came, and the set of weights: the bit's kind, and how sure the last two contexts are."""
    sign = bits.outcome.astype(np.int16)
    sign *= 2
    sign -= 1
    found = [t.take(s) for t, s in zip(tables, bits.slots)]
    gate = bits.kind * np.int8(9)
    for x, step in zip(found[1:], (3, 1)):
        size = np.abs(x)
        gate += np.int8(step) * ((size > 0).view(np.int8) + (size > SURE).view(np.int8))
    for x in found:
        x *= sign
    return found, gate.astype(np.int16)


def mix_bits(inputs: list[np.ndarray], gate: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 probability of each text's outcomes, from three inputs a bit.

    Texts are cut into blocks of ``BLOCK`` bits, each of which starts from equal weights and refines them after every
    bit; the blocks of a slice advance together.
    """
    n = np.diff(bounds)
    blocks = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), blocks)
    begin = bounds[:-1][text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    length = np.minimum(BLOCK, bounds[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    text, begin, length = text[order], begin[order], length[order]
    steps = int(length.max(initial=0))
    active = len(length) - np.searchsorted(length[::-1], np.arange(steps), side="right")
    column = np.concatenate([[0], np.cumsum(active)])
    # the bits of all blocks at one step stand together, each with its inputs and its gate side by side
    to = np.empty(len(gate), np.int64)
    for i, (b, k) in enumerate(zip(begin.tolist(), length.tolist())):
        np.add(column[:k], i, out=to[b : b + k])
    beside = np.empty((len(gate), 4), np.int16)
    for i, x in enumerate((*inputs, gate)):
        beside[:, i] = x
    moved = np.empty(len(gate), np.int64)
    moved[to] = beside.view(np.int64)[:, 0]
    beside = moved.view(np.int16).reshape(-1, 4)
    # A set of three weights, and a fourth number that nothing reads, is moved as one of 16 bytes. Weights are kept
    # negated, as the odds against an outcome are what the steps need.
    weights = np.full(4 * len(length) * GATES, -FIRST_WEIGHT / _SCALE, np.float32).view(np.complex128)
    base = np.arange(len(length)) * GATES
    scores, chance = np.zeros(len(length)), np.ones(len(length))
    rate, one, least, most = (np.float32(v) for v in (RATE / _SCALE**2, 1, -20, 20))
    for t in range(steps):
        own = beside[column[t] : column[t + 1]]
        n_own = len(own)
        row = base[:n_own] + own[:, 3]
        x = own.astype(np.float32)
        held = weights.take(row).view(np.float32)
        each = held * x.reshape(-1)
        dot = each[0::4] + each[1::4]
        dot += each[2::4]
        np.maximum(dot, least, out=dot)
        np.minimum(dot, most, out=dot)
        np.exp(dot, out=dot)
        dot += one
        chance[:n_own] /= dot
        np.divide(rate, dot, out=dot)
        np.subtract(rate, dot, out=dot)
        np.multiply(x.reshape(-1), dot.repeat(4), out=each)
        held -= each
        weights[row] = held.view(np.complex128)
        if t % 32 == 31:  # 32 of the least chances, one in 1 + exp(20), are still a double
            scores += np.log(chance)
            chance[:] = 1
    scores += np.log(chance)
    return np.bincount(text, scores, len(n)) / np.log(10) if len(n) else np.zeros(0)


# Training


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training, by the checksum of its id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n of the lower-cased words; each batch adds up its own before Spark adds up the batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(0), 4 * SLICE):
                counted = pc.value_counts(words_of(piece)[0])
                yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.string()), counted.field(1)], ["word", "n"])

    return docs.select(text_col).mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _successors(rare: DataFrame) -> np.ndarray:
    """How often each byte, or the end (256), follows each byte (0 at the beginning) in words (word, n)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256 * 257, np.int64)
        for batch in batches:
            words = batch.column("word").cast(pa.large_string())
            size = np.asarray(pc.binary_length(words))
            body = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8).astype(np.int64)
            ends = np.cumsum(size + 1) - 1
            symbol = np.full(int(size.sum() + len(size)), 256, np.int64)
            symbol[np.delete(np.arange(len(symbol)), ends)] = body
            before = np.concatenate([[0], symbol[:-1]]) % 256
            total += np.bincount(before * 257 + symbol, np.repeat(np.asarray(batch.column("n")), size + 1), len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    found = rare.select("word", "n").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most 256 x 257 rows
    out = np.zeros(256 * 257, np.int64)
    out[np.asarray(found["i"])] = np.asarray(found["n"])
    return out.reshape(256, 257)


def learn_vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """The ``HEAD`` most frequent words of at least ``LEAST_CODED`` occurrences, equal ones in code-point order, and the codes.

    ``counts`` is a stored table (word, n).
    """
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = counts.filter(F.col("n") >= LEAST_CODED).orderBy(F.desc("n"), "word").limit(HEAD).collect()  # a bounded table
    rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(r.word,) for r in head], "word string")), "word", "left_anti")
    own = [r.n for r in head]
    return Vocabulary.of([r.word for r in head], own, int(total) - sum(own), texts, int(distinct) + (texts > 0), _successors(rare))


def _count_slots(vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        tables = [np.zeros(2 << b, np.uint32) for b in TABLE_BITS]
        for batch in batches:
            for big in slices(batch.column(0), SLICE):
                for piece in pieces_of(tokens_of(big, own)[0]):
                    bits = bits_of(piece, own, kinds=False)
                    ones = np.ones(len(bits.outcome), np.uint32)
                    for table, slot in zip(tables, bits.slots):
                        slot <<= 1
                        slot |= bits.outcome
                        np.add.at(table, slot, ones)
        pack = zstandard.ZstdCompressor(level=1).compress
        chunk = 0
        for table in tables:
            rows = table.reshape(-1, 2 * _CHUNK)
            used = np.flatnonzero(rows.any(1))
            for at in range(0, len(used), 256):
                some = used[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(some + chunk), pa.array([pack(rows[i].tobytes()) for i in some], pa.binary())], ["chunk", "counts"])
            chunk += len(rows)

    return run


def _predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal chunks are added as they stream by; what is held is at most the model."""
    total: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            own = np.frombuffer(unpack(counts), np.uint32)
            if chunk in total:
                total[chunk] += own
            else:
                total[chunk] = own.astype(np.uint64)
    for chunk, counts in total.items():
        n = counts.reshape(-1, 2).astype(np.float64)
        value = np.round(np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR)) * _SCALE).clip(-32767, 32767).astype(np.int16)
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([value.tobytes()], pa.binary())], ["chunk", "value"])


def learn_tables(docs: DataFrame, vocabulary, text_col: str = "text") -> list[np.ndarray]:
    """Each context's prediction for every slot, from the counts of all texts; 18 MB, whatever the corpus.

    Every task counts in tables of its own and sends the chunks that it touched, compressed; those are added up by chunk.
    """
    parts = docs.select(text_col).mapInArrow(tidy(_count_slots(vocabulary)), "chunk long, counts binary")
    found = parts.repartition("chunk").mapInArrow(tidy(_predict), "chunk long, value binary").toArrow()
    flat = np.zeros((sum(1 << b for b in TABLE_BITS) // _CHUNK, _CHUNK), np.int16)
    for chunk, value in zip(found["chunk"].to_pylist(), found["value"].to_pylist()):
        flat[chunk] = np.frombuffer(value, np.int16)
    return np.split(flat.ravel(), np.cumsum([1 << b for b in TABLE_BITS])[:-1])


# Scoring


def _mixed(tokens: Tokens, vocabulary: Vocabulary, tables: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text by the mixed predictors."""
    inputs, gate, bounds, at = [], [], [np.zeros(1, np.int64)], 0
    for piece in pieces_of(tokens):
        bits = bits_of(piece, vocabulary)
        x, g = inputs_of(bits, tables)
        inputs.append(x)
        gate.append(g)
        bounds.append(bits.bounds[1:] + at)
        at += len(g)
    return mix_bits([np.concatenate(x) for x in zip(*inputs)], np.concatenate(gate), np.concatenate(bounds))


def _score(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tables = model.value
        base = np.log10((vocabulary.counts + 1) / (vocabulary.total + vocabulary.distinct + 1))
        for batch in batches:
            for big in slices(batch.column("text"), SLICE):
                texts = len(big.offsets) - 1
                tokens, words = tokens_of(big, vocabulary)
                own, coded = tokens.bounds[:-1], tokens.ids >= 0
                known = np.add.reduceat((coded & (vocabulary.counts[tokens.ids] > 0)).astype(np.int64), own)
                sums = np.add.reduceat(np.where(coded, base[tokens.ids], 0.0), own)
                rest = np.flatnonzero(~coded)
                text = np.searchsorted(tokens.bounds, rest, side="right") - 1
                spelled = words.take(pa.array(rest - text))  # a word's place among words: its token less the ends before it
                rare = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(texts + 1))), spelled)
                score = pa.array(_mixed(tokens, vocabulary, tables)) if tables else pa.nulls(texts, pa.float64())
                rows = batch.slice(big.first, texts)
                columns = [pa.array(np.diff(tokens.bounds)), pa.array(known), pa.array(sums), score, pa.array(np.diff(big.offsets))]
                lists = rare.cast(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("held_out"), *columns, lists], ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "rare"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mixed: bool = True) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte: a row per row of ``docs``.

    Both scores are log10 probabilities of the lower-cased text's tokens, its words and one end; the model learns from
    the rows that are not held out. A null text counts as empty: its end alone. Repeated rows and ids count, and are
    scored, each time; a null id stays null and is never held out; other columns are ignored; an empty table gives no
    rows. Without training rows every token has the base score 0, and the model predicts each bit at even odds.
    ``bits_per_byte`` is null for texts without bytes. Where only the token frequencies are wanted, ``mixed`` is false:
    the predictors are neither learned nor asked, and ``score`` is null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.coalesce(text_col, F.lit("")).alias("text"))
    train = rows.filter("NOT held_out")
    counts = scratch.keep(count_tokens(train), "counts")
    vocabulary = learn_vocabulary(counts, train.count())
    shared = spark.sparkContext.broadcast(vocabulary)
    model = spark.sparkContext.broadcast((vocabulary, learn_tables(train, shared) if mixed else None))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())])
    for name in ("n_tokens", "n_known", "base_score", "score", "n_bytes"):
        schema.add(name, T.DoubleType() if name.endswith("score") else T.LongType())
    schema.add("rare", T.ArrayType(T.StringType()))
    scored = scratch.keep(rows.mapInArrow(tidy(_score(model)), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words without a code are at most one in HEAD of the training tokens each, so no key is hot in their join.
    each = scored.select("row", F.explode("rare").alias("word"))
    chance = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(vocabulary.total + vocabulary.distinct + 1)))
    extra = each.join(counts, "word", "left").groupBy("row").agg(F.sum(chance).alias("more"), F.count_if(F.col("n") > 0).alias("seen"))
    out = scored.drop("rare").join(extra, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.nullif("n_bytes", F.lit(0))).alias("bits_per_byte"),
    )
