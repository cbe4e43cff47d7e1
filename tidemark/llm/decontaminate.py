"""Benchmark decontamination by the q-gram lemma.

A stretch of text within k edits of an item of m bytes shares at least m - q + 1 - k q of its q-grams, and their
diagonals (place in the text less place in the item) differ by at most k. A text that holds too few distinct q-grams of
an item is left at once. For the rest, shared q-grams are counted in diagonal bands 2k wide that overlap by k; bands
that reach the bound are aligned with the item, within the band, and kept if the distance is within the budget.
Items too short for the lemma are searched for exactly, at word bounds.

Texts and items are compared with A-Z and Latin capital letters lower-cased and white space runs as one space.
The benchmark is the stated query set. Tasks read the documents once and take the items in blocks of at most
``BLOCK_BYTES``, one block in memory at a time; a benchmark beyond ``PASS_BYTES`` takes one more reading for each such part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.language_id import fold_case
from tidemark.llm.textkernel import is_space, slices, tidy

Q = 8
#: Edits allowed, as a share of an item's bytes; short items allow fewer, so that LEAST q-grams must be shared.
BUDGET, LEAST = 0.1, 6
BLOCK_BYTES, PASS_BYTES = 1 << 20, 1 << 28
_TABLE_BITS = 22
#: Pairs of a text's and an item's q-gram that are held at once.
_HELD = 1 << 21
#: Diagonals of neighbouring bands that are aligned in one go.
_JOINED = 1 << 12
#: Candidate items of one text from which on they may be screened together, how many at a time, and how many steps along
#: the text one item's alignment is worth. Whichever way is taken, the results are the same.
_TOGETHER, _SCREENED, _STEPS = 32, 2048, 500


def normalize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their bounds, and each one's place in ``data``."""
    if not len(data):
        return data, offsets, np.zeros(0, np.int64)
    space = is_space(data)
    drop = space.copy()
    drop[1:] &= space[:-1]
    starts = offsets[:-1][offsets[:-1] < len(data)]
    drop[0] = space[0]
    drop[starts] = space[starts]  # a text does not begin with a space
    place = np.flatnonzero(~drop)
    out = fold_case(data)
    out[space] = 32
    return out[place], np.searchsorted(place, offsets), place


def edit_budget(m: int) -> int:
    """Edits that an item of m folded bytes allows, -1 if it is too short to search for."""
    return min(int(BUDGET * m), (m - Q + 1 - LEAST) // Q) if m - Q + 1 >= LEAST else -1


@dataclass
class Block:
    """A part of the benchmark: ordered distinct q-grams with the items and places where they stand."""

    ids: list
    items: list[bytes]
    budget: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    own: np.ndarray  # items of each distinct q-gram, once each, in the order of ``grams``
    own_times: np.ndarray  # how often the q-gram stands in that item
    own_bounds: np.ndarray
    short_ids: list
    short: list[bytes]

    def __post_init__(self):
        self.short_items = ShortItems(self.short)


def _grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at every byte, as a number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - Q + 1,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)


def make_block(rows: list[tuple]) -> Block:
    ids, items, grams, item, place = [], [], [], [], []
    short_ids, short = [], []
    for name, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        folded, _, _ = normalize(raw, np.array([0, len(raw)]))
        body = folded.tobytes().rstrip(b" ")
        if edit_budget(len(body)) < 0:
            if body.strip():
                short_ids.append(name)
                short.append(body.strip())
            continue
        own = _grams(np.frombuffer(body, np.uint8))
        grams.append(own)
        item.append(np.full(len(own), len(items)))
        place.append(np.arange(len(own)))
        ids.append(name)
        items.append(body)
    budget = np.array([edit_budget(len(s)) for s in items], np.int64)
    if not items:
        none = np.zeros(0, np.int64)
        return Block(ids, items, budget, np.zeros(0, np.uint64), np.zeros(1, np.int64), none, none, none, none, np.zeros(1, np.int64), short_ids, short)
    flat, item, place = np.concatenate(grams), np.concatenate(item), np.concatenate(place)
    order = np.argsort(flat, kind="stable")
    distinct, first = np.unique(flat[order], return_index=True)
    bounds, item, place = np.append(first, len(flat)), item[order], place[order]
    new = np.ones(len(item), bool)  # places of one gram are in the order of items
    new[1:] = item[1:] != item[:-1]
    new[first] = True
    return Block(ids, items, budget, distinct, bounds, item, place, item[new], np.diff(np.append(np.flatnonzero(new), len(new))), np.concatenate([[0], np.cumsum(new)])[bounds], short_ids, short)


def banded_costs(item: bytes, text: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits between ``item`` and the stretches of ``text`` on diagonals low to high, by where they end: edits, begins, ends.

    Row i of the table holds the cells of the item's first i bytes at the text places i + low - 1 to i + high.
    """
    width = high - low + 1
    s, t = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    far = len(item) + len(text) + 1
    place = np.arange(width) + low  # text bytes used in row 0
    cost = np.where((place >= 0) & (place <= len(t)), 0, far)
    begin = place.copy()
    ramp = np.arange(width)
    for i in range(1, len(s) + 1):
        used = place + i
        inside = (used >= 0) & (used <= len(t))
        byte = t[np.clip(used - 1, 0, max(len(t) - 1, 0))] if len(t) else np.zeros(width, np.uint8)
        step = cost + np.where((used >= 1) & (used <= len(t)) & (byte == s[i - 1]), 0, 1)
        step[(used < 1) | (used > len(t))] = far
        drop = np.append(cost[1:] + 1, far)  # an item byte without a text byte
        drop_begin = np.append(begin[1:], 0)
        best = np.where(drop < step, drop, step)
        from_ = np.where(drop < step, drop_begin, begin)
        best = np.where(inside, best, far)
        # a text byte without an item byte: along the row
        level = best - ramp
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, ramp, 0))
        cost = np.where(inside, np.minimum(least + ramp, far), far)
        begin = from_[source]
    return cost, np.maximum(begin, 0), place + len(s)


def banded_distance(item: bytes, text: bytes, low: int, high: int) -> tuple[int, int, int]:
    """The least of ``banded_costs`` and its stretch."""
    cost, begin, end = banded_costs(item, text, low, high)
    at = int(np.argmin(cost))
    return int(cost[at]), int(begin[at]), int(end[at])


def least_distance(item: bytes, text: bytes) -> int:
    """Least edits between ``item`` and any stretch of ``text``, bit-parallel over the item; screens for the alignment."""
    full = (1 << len(item)) - 1
    last = 1 << (len(item) - 1)
    at: dict[int, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, len(item)
    best = score
    for c in text:
        eq = at.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(h | up)), up & h
        score += 1 if rise & last else -1 if fall & last else 0
        best = min(best, score)
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(x | rise)), rise & x
    return best


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... n[i] of them, one after another."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _runs_of(n: np.ndarray, limit: int = _HELD) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive entries whose sizes add up to ``limit`` at most, one entry at least."""
    upto, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield at, stop
        at = stop


def _candidates(block: Block, bound: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Pairs (text * items + item) in which the text holds enough distinct q-grams of the item; texts come in order."""
    items = len(block.items)
    if not len(doc):
        return np.zeros(0, np.int64)
    order = np.lexsort((spot, doc))
    doc, spot = doc[order], spot[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (spot[1:] != spot[:-1])
    doc, spot = doc[new], spot[new]
    n = np.diff(block.own_bounds)[spot]
    heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(heads[1:], len(doc))
    out = []
    for a, b in _runs_of(np.add.reduceat(n, heads)):
        part = slice(heads[a], ends[b - 1])
        post = _spread(block.own_bounds[spot[part]], n[part])
        key, back = np.unique(np.repeat(doc[part], n[part]) * items + block.own[post], return_inverse=True)
        # A q-gram that stands in an item more than once counts as often as it does there at most.
        out.append(key[np.bincount(back, block.own_times[post], len(key)) >= bound[key % items]])
    return np.concatenate(out)


def _bands(item: bytes, budget: int, bound: int, gram: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the diagonal bands of one text (the q-grams ``gram`` at the places ``at``) that reach the bound.

    The text is taken in windows that overlap by more than a whole match, so that repeated q-grams never spread far.
    """
    own = _grams(np.frombuffer(item, np.uint8))
    order = np.argsort(own, kind="stable")
    distinct, first = np.unique(own[order], return_index=True)
    times = np.diff(np.append(first, len(own)))
    spot = np.minimum(np.searchsorted(distinct, gram), len(distinct) - 1)
    real = distinct[spot] == gram
    at, spot = at[real], spot[real]
    if len(at) < bound:
        return np.zeros(0, np.int64)
    reach, width = len(item) + budget, max(budget, 1)
    step = max(reach, min(_HELD // int(times[spot].max()), 8 * _HELD * width // len(item)))
    found = []
    for low in range(0, size, step):
        a, b = np.searchsorted(at, [low, low + step + reach])
        if b - a < bound:
            continue
        first_group = low // width
        held = np.zeros(((min(step + reach, size - low) + len(item)) // width + 3, len(own)), bool)  # groups of diagonals x places
        for c, d in _runs_of(times[spot[a:b]]):
            n = times[spot[a + c : a + d]]
            place = order[_spread(first[spot[a + c : a + d]], n)]
            # Several places of the text may hold one q-gram: distinct ones of the item are what the lemma counts.
            held[(np.repeat(at[a + c : a + d], n) - place + len(item)) // width - first_group, place] = True
        found.append(first_group + np.flatnonzero((held[:-1] | held[1:]).sum(1) >= bound))  # a band is two groups
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _align(item: bytes, budget: int, bands: np.ndarray, text: bytes) -> list[tuple[int, int, int]]:
    """Edits, start and end of the stretches within the budget in some of a text's bands; of overlapping ones the best, then the first."""
    width = max(budget, 1)
    out, rest = [], []
    for band in bands.tolist():
        low = band * width - len(item)
        begin = max(0, low - budget)
        exact = text.find(item, begin, max(begin, low + 3 * width + len(item)))
        if exact >= 0:
            out.append((0, exact, exact + len(item)))
        else:
            rest.append(band)
    # Neighbouring bands are aligned together, up to _JOINED diagonals.
    runs: list[list[int]] = []
    for band in rest:
        if runs and band <= runs[-1][1] + 2 and (band - runs[-1][0]) * width < _JOINED:
            runs[-1][1] = band
        else:
            runs.append([band, band])
    for first, last in runs:
        low, high = first * width - len(item), last * width - len(item) + 2 * width
        begin = max(0, low - budget)
        part = text[begin : max(begin, high + width + len(item))]
        if least_distance(item, part) > budget:
            continue
        cost, starts, ends = banded_costs(item, part, low - begin - budget, high - begin + width)
        taken = np.zeros(len(part) + 1, bool)
        near = np.flatnonzero(cost <= budget)
        for at in near[np.lexsort((ends[near], cost[near]))].tolist():
            s, e = int(starts[at]), int(ends[at])
            if e > s and not taken[s:e].any():
                taken[s:e] = True
                out.append((int(cost[at]), begin + s, begin + e))
    return out


class ShortItems:
    """The short items of a block by their bytes: for each size the ordered distinct ones, as two numbers, and the items that have them."""

    def __init__(self, items: list[bytes]):
        places: dict[bytes, list[int]] = {}
        for i, item in enumerate(items):
            places.setdefault(item, []).append(i)
        self.sizes = []
        for size in sorted({len(item) for item in places}):
            own = [item for item in places if len(item) == size]
            both = np.array([np.frombuffer(item.ljust(16, b"\0"), np.uint64) for item in own])
            order = np.lexsort((both[:, 1], both[:, 0]))
            both = both[order]
            table = np.zeros(1 << 16, bool)
            table[self._spot(both[:, 0], both[:, 1])] = True
            self.sizes.append((size, both, table, [places[own[k]] for k in order]))

    @staticmethod
    def _spot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (((low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end) of the exact places not inside a longer word; of overlapping ones of an item the first.

        Each size is one pass over the places where a word may begin, whatever the number of items.
        """
        body = np.concatenate([data, np.zeros(16, np.uint8)])
        word = np.concatenate([[False], (data - np.uint8(97) < 26) | (data - np.uint8(48) < 10) | (data >= 0x80), [False]])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        cut = edge | ~(word[:-1] & word[1:])  # a word may begin or end before each byte
        begins = np.flatnonzero(cut[:-1])
        heads = np.ndarray((len(data) + 8,), "<u8", body, strides=(1,))
        for size, both, table, items in self.sizes:
            at = begins[begins + size <= len(data)]
            at = at[cut[at + size]]
            low = heads[at] & np.uint64((1 << 8 * min(size, 8)) - 1)
            high = heads[at + 8] & np.uint64((1 << 8 * (size - 8)) - 1) if size > 8 else np.zeros(len(at), np.uint64)
            likely = table[self._spot(low, high)]
            at, low, high = at[likely], low[likely], high[likely]
            doc = np.searchsorted(offsets, at, side="right") - 1
            fits = at + size <= offsets[doc + 1]
            at, low, high, doc = at[fits], low[fits], high[fits], doc[fits]
            first, last = (np.searchsorted(both[:, 0], low, side=side) for side in ("left", "right"))
            end: dict[int, int] = {}
            for k in range(len(at)):
                spot = first[k] + int(np.searchsorted(both[first[k] : last[k], 1], high[k]))
                if spot < last[k] and both[spot, 1] == high[k] and at[k] >= end.get(spot, 0):
                    end[spot] = int(at[k]) + size
                    begin = int(at[k] - offsets[doc[k]])
                    for i in items[spot]:
                        yield int(doc[k]), i, begin, begin + size


def least_distances(items: list[bytes], text: bytes) -> np.ndarray:
    """``least_distance`` of each item, all of them advancing together along the text; items are at most 64 bytes a word long.

    Bit k of an item's words is its byte k; sums carry from word to word.
    """
    n, words = len(items), -(-max(map(len, items)) // 64)
    size = np.array([len(i) for i in items])
    flat = np.frombuffer(b"".join(items), np.uint8)
    row = np.repeat(np.arange(n), size)
    k = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    letters, code = np.unique(np.frombuffer(text, np.uint8), return_inverse=True)
    match = np.zeros((len(letters), words, n), np.uint64)
    spot = np.searchsorted(letters, flat)
    known = letters[np.minimum(spot, len(letters) - 1)] == flat
    np.bitwise_or.at(match, (spot[known], k[known] // 64, row[known]), np.uint64(1) << (k[known] % 64).astype(np.uint64))
    one = np.uint64(1)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    last, shift = ((size - 1) // 64, np.arange(n)), ((size - 1) % 64).astype(np.uint64)
    score = size.astype(np.int64)
    best = score.copy()
    for c in code:
        eq = match[c]
        x = eq | down
        part = eq & up
        total = part + up
        over = total < up
        for w in range(1, words):
            total[w] += over[w - 1]
            over[w] |= over[w - 1] & (total[w] == 0)
        h = (total ^ up) | eq
        rise, fall = down | ~(h | up), up & h
        score += ((rise[last] >> shift) & one).astype(np.int64) - ((fall[last] >> shift) & one).astype(np.int64)
        np.minimum(best, score, out=best)
        high = np.uint64(63)
        left, right = rise << one, fall << one
        left[1:] |= rise[:-1] >> high
        right[1:] |= fall[:-1] >> high
        up, down = right | ~(x | left), left & x
    return best


def _near_enough(block: Block, pairs: list[tuple[int, int]], at: np.ndarray, edge: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (text, item) without those whose item is too far from every part of the text that holds any of the q-grams.

    Items that share a long stem are candidates of each text with the stem; where a text has several, they are screened
    together, so the stem costs each of them some bit operations rather than an alignment.
    """
    out = []
    for d, own in groupby(pairs, key=lambda p: p[0]):
        items = [i for _, i in own]
        if len(items) >= _TOGETHER:  # below, aligning each costs less than a step along the text
            reach = max(len(block.items[i]) + int(block.budget[i]) for i in items)
            low, high = int(offsets[d]), int(offsets[d + 1])
            starts = at[edge[d] : edge[d + 1]]
            cover = np.zeros(high - low + 1, np.int32)
            np.add.at(cover, np.maximum(starts - reach - low, 0), 1)
            np.add.at(cover, np.minimum(starts + reach - low, high - low), -1)
            text = data[low:high][np.cumsum(cover[:-1]) > 0].tobytes()  # parts that lie apart are put together: distances can only fall
            if len(text) * (_TOGETHER + len(items) // 16) > _STEPS * len(items):  # a long text: its bands rule most items out sooner
                out += [(d, i) for i in items]
                continue
            kept = []
            by_size = sorted(items, key=lambda i: len(block.items[i]))
            for k in range(0, len(by_size), _SCREENED):
                some = by_size[k : k + _SCREENED]
                near = least_distances([block.items[i] for i in some], text) <= block.budget[some]
                kept += [i for i, ok in zip(some, near) if ok]
            items = sorted(kept)
        out += [(d, i) for i in items]
    return out


def find_in_slice(block: Block, table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) in folded bytes of each text."""
    found: list[tuple[int, int, int, int, int]] = [(d, len(block.items) + i, s, e, 0) for d, i, s, e in block.short_items.find(data, offsets)] if block.short and len(data) else []
    grams = _grams(data)
    if not len(grams) or not len(block.grams):
        return found
    at = np.flatnonzero(table[((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    spot = np.minimum(np.searchsorted(block.grams, grams[at]), len(block.grams) - 1)
    real = block.grams[spot] == grams[at]
    at, spot = at[real], spot[real]
    doc = np.searchsorted(offsets, at, side="right") - 1
    whole = at + Q <= offsets[doc + 1]
    at, spot, doc = at[whole], spot[whole], doc[whole]
    bound = np.array([len(s) for s in block.items], np.int64) - Q + 1 - block.budget * Q
    edge = np.searchsorted(doc, np.arange(len(offsets)))
    hits: list[tuple[int, int, int, int, int]] = []
    pairs = [divmod(int(k), len(block.items)) for k in _candidates(block, bound, doc, spot)]
    for d, i in _near_enough(block, pairs, at, edge, data, offsets):
        here = slice(edge[d], edge[d + 1])
        own, allowed, size = block.items[i], int(block.budget[i]), int(offsets[d + 1] - offsets[d])
        bands = _bands(own, allowed, int(bound[i]), grams[at[here]], at[here] - offsets[d], size)
        text = data[offsets[d] : offsets[d + 1]].tobytes() if len(bands) else b""
        hits += [(d, i, s, e, edits) for edits, s, e in _align(own, allowed, bands, text)]
    # Overlapping bands see one stretch twice: of overlapping ones of an item, the best stays.
    kept: list[tuple[int, int, int, int, int]] = []
    last: dict[tuple[int, int], int] = {}
    for f in sorted(hits, key=lambda x: (x[0], x[1], x[2], x[4])):
        spot_ = last.get(f[:2])
        if spot_ is not None and f[2] < kept[spot_][3]:
            if f[4] < kept[spot_][4]:
                kept[spot_] = f
            continue
        last[f[:2]] = len(kept)
        kept.append(f)
    return found + kept


def _table(block: Block) -> np.ndarray:
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[((block.grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return table


class _Blocks:
    """The blocks of one pass, as tasks see them; of several, only the one at work is in memory."""

    def __init__(self, shared: list[Broadcast]):
        self._shared = shared
        self._one: tuple[Block, np.ndarray] | None = None

    def __iter__(self) -> Iterator[tuple[Block, np.ndarray]]:
        for rows in self._shared:
            if self._one:
                yield self._one
                continue
            block = make_block(rows.value)
            pair = block, _table(block)
            if len(self._shared) == 1:
                self._one = pair
            yield pair


def _search(shared: list[Broadcast], id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(shared)
        for batch in batches:
            rows: list[tuple] = []
            for block, table in blocks:
                for piece in slices(batch.column("text")):
                    data, offsets, place = normalize(piece.data, piece.offsets)
                    hits = find_in_slice(block, table, data, offsets)
                    points: dict[int, np.ndarray] = {}
                    for d, i, s, e, edits in hits:
                        base = piece.offsets[d]
                        if d not in points:
                            points = {d: np.cumsum((piece.data[base : piece.offsets[d + 1]] & 0xC0) != 0x80)}  # code points up to and with each byte
                        head, tail = place[offsets[d] + s] - base, place[offsets[d] + e - 1] - base
                        name, budget = (block.ids[i], int(block.budget[i])) if i < len(block.ids) else (block.short_ids[i - len(block.ids)], 0)
                        rows.append((piece.first + d, name, int(points[d][head - 1]) if head else 0, int(points[d][tail]), edits, budget))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], id_type), *(pa.array(c, pa.int64()) for c in columns[2:])],
                ["doc_id", "item_id", "start", "end", "edits", "budget"],
            )

    return run


def _clean(shared: list[Broadcast], text_col: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(shared)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for block, table in blocks:
                for piece in slices(batch.column(text_col)):
                    data, offsets, _ = normalize(piece.data, piece.offsets)
                    keep[[piece.first + hit[0] for hit in find_in_slice(block, table, data, offsets)]] = False
            yield batch.filter(pa.array(keep))

    return run


def passes(benchmark: DataFrame) -> Iterator[list[Broadcast]]:
    """The benchmark (item_id, text) as broadcast blocks of bounded size, so many at a time as ``PASS_BYTES`` allows."""
    context = benchmark.sparkSession.sparkContext
    out: list[Broadcast] = []
    rows, size, total = [], 0, 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len((r.text or "").encode())
        if size >= BLOCK_BYTES:
            out.append(context.broadcast(rows))
            total += size
            rows, size = [], 0
        if total >= PASS_BYTES:
            yield out
            out, total = [], 0
    if rows or not out:
        out.append(context.broadcast(rows))
    yield out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per stretch of a document within an item's edit budget: doc_id, item_id, start, end, edits, budget.

    ``start`` and ``end`` are code points of the document's text. Null and empty texts and items hold nothing; items
    whose folded text has fewer than ``Q + LEAST - 1`` bytes are found where they stand unchanged between word bounds;
    repeated rows and items each give rows; a null id stays null; an empty table gives an empty result; other columns
    are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    benchmark = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kinds = [f.schema[c].dataType for f, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    shape = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, start long, end long, edits long, budget long"
    return reduce(DataFrame.union, (docs.mapInArrow(tidy(_search(shared, to_arrow_type(kinds[1]))), shape) for shared in passes(benchmark)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item of the benchmark; rows without a text stay, and so do all columns.

    Each row is judged where it is read, so that nothing is shuffled and rows that share an id are told apart.
    """
    benchmark = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    return reduce(lambda kept, shared: kept.mapInArrow(tidy(_clean(shared, text_col)), kept.schema), passes(benchmark), docs)
