"""Exact token ids of public tokenizers, encoding each distinct stretch of text once a task.

For byte-level BPE files with the usual splitting pattern, a space that is followed by a visible character always
starts a new pre-token, so a text falls into stretches that can be encoded apart; most of them recur. Every other
file, and every text that holds a special string, is encoded whole by its library.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.textkernel import give_back, hash_spans, slices

#: Stretches kept by one task before it starts over: bounds its memory, not its result.
CACHE_ENTRIES, CACHE_BYTES = 1_000_000, 1 << 25
#: Stretches given to the library as one text.
JOIN = 64


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: its file's bytes and how texts are given to it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no added special tokens|no truncation|v1").hexdigest()


class Encoder:
    """``ids(column)`` gives each text's ids as they come from the library for this file."""

    def __init__(self, path: str):
        self._path = path
        self._known = np.zeros(0, np.uint64)
        self._count = np.zeros(0, np.int64)
        self._at = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)
        self._begin = np.zeros(0, np.int64)  # the known stretches themselves, as a hash alone does not tell them apart
        self._size = np.zeros(0, np.int64)
        self._text = np.zeros(0, np.uint8)
        self._specials: list[bytes] = []
        self._splits = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda texts: [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            pre, added = tokenizer.pre_tokenizer, tokenizer.get_added_tokens_decoder().values()
            self._splits = tokenizer.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex
            self._specials = [t.content.encode() for t in added]
            self._splits = self._splits and not any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in added)
            if self._splits:  # in these vocabularies a token's characters stand for its bytes
                vocabulary = tokenizer.get_vocab(with_added_tokens=False)
                self._bytes = np.ones(max(vocabulary.values()) + 1, np.int64)
                self._bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
                del vocabulary
            give_back()  # reading the file takes more than what is kept

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        for piece in slices(column):
            raw = piece.data.tobytes()
            bounds = piece.offsets
            if not self._splits or any(s in raw for s in self._specials):
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
                for i, text in enumerate(texts):
                    own = [text] if not self._splits or any(s in raw[bounds[i] : bounds[i + 1]] for s in self._specials) else None
                    if own:
                        yield np.asarray(self._encode(own)[0], np.uint32)
                    else:
                        yield from self._by_stretch(piece.data[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))
            else:
                yield from self._by_stretch(piece.data, bounds)

    def _by_stretch(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        if not len(data):
            yield from (np.zeros(0, np.uint32) for _ in offsets[1:])
            return
        follow = np.concatenate([data[1:], [np.uint8(0)]])
        cut = (data == 32) & (((follow > 32) & (follow < 127)) | ((follow >= 0xC3) & (follow < 0xE0)))
        ends_text = offsets[1:] - 1
        cut[ends_text[ends_text >= 0]] &= False  # what follows the last byte is another text
        spaced = cut.copy()
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        where = self._look_up(data, start, end, spaced[start])
        if not self._same(data, start, end, where):  # two stretches of one hash: each text goes to the library whole
            raw = data.tobytes()
            yield from (np.asarray(self._encode([raw[a:b].decode("utf-8", "replace")])[0], np.uint32) for a, b in zip(offsets[:-1], offsets[1:]))
            return
        count = self._count[where]
        bounds = np.concatenate([[0], np.cumsum(count)])
        flat = self._ids[np.repeat(self._at[where] - bounds[:-1], count) + np.arange(bounds[-1])]
        at = bounds[np.searchsorted(start, offsets)]
        for i in range(len(offsets) - 1):
            yield flat[at[i] : at[i + 1]]

    def _same(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, where: np.ndarray) -> bool:
        """Whether every stretch is, byte for byte, the known one that its hash leads to; stretches lie end to end."""
        size = end - start
        return bool((self._size[where] == size).all()) and np.array_equal(self._text[np.repeat(self._begin[where] - start, size) + np.arange(len(data))], data)

    def _look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        distinct, example, back = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        if len(self._known) > CACHE_ENTRIES or len(self._text) > CACHE_BYTES:
            for kept in ("_known", "_count", "_at", "_ids", "_begin", "_size", "_text"):
                setattr(self, kept, getattr(self, kept)[:0])
        place = np.searchsorted(self._known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self._known)
        new[inside] = self._known[place[inside]] != distinct[inside]
        if new.any():
            pick = example[new]
            raw = data.tobytes()
            ids, at, count = self._encode_new(raw, start[pick], end[pick], spaced[pick])
            size = end[pick] - start[pick]
            begin = len(self._text) + np.cumsum(size) - size
            self._text = np.concatenate([self._text, np.frombuffer(b"".join(raw[a:b] for a, b in zip(start[pick].tolist(), end[pick].tolist())), np.uint8)])
            at += len(self._ids)
            self._ids = np.concatenate([self._ids, ids])
            spots = place[new]
            self._known = np.insert(self._known, spots, distinct[new])
            self._count = np.insert(self._count, spots, count)
            self._at = np.insert(self._at, spots, at)
            self._begin = np.insert(self._begin, spots, begin)
            self._size = np.insert(self._size, spots, size)
            place = np.searchsorted(self._known, distinct)
        return place[back]

    def _encode_new(self, raw: bytes, start: np.ndarray, end: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each stretch's begin and how many they are.

        Stretches that begin with the space of a cut start a pre-token wherever they stand, so ``JOIN`` of them are
        encoded as one text; the bytes that ids stand for tell where each stretch ends.
        """
        order = np.argsort(~spaced, kind="stable")
        bodies = [raw[a:b] for a, b in zip(start[order].tolist(), end[order].tolist())]
        n = int(spaced.sum())
        joined = [b"".join(bodies[i : min(i + JOIN, n)]) for i in range(0, n, JOIN)] + bodies[n:]
        ids = np.concatenate(self._encode([t.decode("utf-8", "replace") for t in joined]))
        upto, ends = np.cumsum(self._bytes[ids]), np.cumsum((end - start)[order])
        last = np.searchsorted(upto, ends)
        if int(upto[-1]) == int(ends[-1]) and np.array_equal(upto[last], ends):
            sizes = np.diff(last + 1, prepend=0)
        else:  # bytes that are no UTF-8 were replaced by longer ones
            found = self._encode([t.decode("utf-8", "replace") for t in bodies])
            ids, sizes = np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        count, at = np.empty_like(sizes), np.empty_like(sizes)
        count[order], at[order] = sizes, np.cumsum(sizes) - sizes
        return ids, at, count
