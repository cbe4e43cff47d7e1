"""Packing documents into training sequences by vector best-fit.

Every sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Longer pieces
go first; by the norm rule each takes, of the open sequences that have room in all three, the one that it leaves with
the least weighted norm of the residual. By the dot rule one sequence is filled at a time, with the piece that fits and
has the largest weighted dot product of demand and residual.

Pieces are dealt at random into bins of about ``GROUP`` pieces, which are packed apart: thousands of pieces leave a
part of one sequence unused, so the result is as tight as packing all at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.textkernel import mix, tidy, tidy_group
from tidemark.llm.tokenization import Encoder

#: Pieces packed by one task at a time.
GROUP = 4096


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds.

    No set of pieces within ``tokens`` costs more attention than its square, so that capacity binds only below it; one
    piece of ``tokens`` must still fit.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    rule: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)


def pack_vectors(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths are 1 to ``capacity.tokens``. Ties go to the sequence opened first."""
    if capacity.rule == "dot":
        return _pack_by_dot(lengths, capacity)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.asarray(capacity.weights) / full
    rest = np.zeros((3, 256))
    names = np.zeros(256, np.int64)
    live = opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        length = float(lengths[i])
        need = np.array([length, 1.0, length * length])
        if np.any(need > full):
            raise ValueError(f"a piece of {int(length)} tokens exceeds a sequence's capacities")
        room = rest[:, :live]
        fits = (room[0] >= need[0]) & (room[1] >= need[1]) & (room[2] >= need[2])
        spots = np.flatnonzero(fits)
        if len(spots):
            left = room[:, spots]
            spot = spots[np.argmin((((left - need[:, None]) * weights[:, None]) ** 2).sum(0))]
        else:
            if live == len(names):
                rest = np.concatenate([rest, np.zeros_like(rest)], 1)
                names = np.concatenate([names, np.zeros_like(names)])
            spot, live = live, live + 1
            rest[:, spot], names[spot] = full, opened
            opened += 1
        bins[i] = names[spot]
        offsets[i] = int(full[0] - rest[0, spot])
        rest[:, spot] -= need
        if rest[0, spot] < 1 or rest[1, spot] < 1 or rest[2, spot] < 1:  # closed: the last open one takes its place
            live -= 1
            rest[:, spot], names[spot] = rest[:, live], names[live]
    return bins, offsets


def _pack_by_dot(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequences filled one by one; pieces of one length are alike, so each step weighs the lengths that are left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    size, first, count = np.unique(lengths[order], return_index=True, return_counts=True)
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    need = np.stack([size, np.ones(len(size)), size.astype(float) ** 2], 1)
    if len(size) and np.any(need > full):
        raise ValueError(f"a piece of {int(size[-1])} tokens exceeds a sequence's capacities")
    weights = np.asarray(capacity.weights) / full**2
    left, opened = len(lengths), 0
    while left:
        rest = full.copy()
        while True:
            fits = (count > 0) & (need <= rest).all(1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, need @ (rest * weights), -1.0)))
            count[k] -= 1
            i = order[first[k] + count[k]]
            bins[i], offsets[i] = opened, int(full[0] - rest[0])
            rest -= need[k]
            left -= 1
        opened += 1
    return bins, offsets


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces; a document longer than ``size`` is cut, its first piece shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return [(s, (first if s == 0 and first else size)) for s in starts]


def _pieces(path: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        part = TaskContext.get().partitionId()
        seen = 0
        for batch in batches:
            source, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, ids in enumerate(encoder.ids(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(piece_bounds(len(ids), size)):
                    own = ids[at : at + n]
                    source.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        kept.append(own.astype(np.int32))
            order = np.arange(seen, seen + len(source), dtype=np.uint64) + (np.uint64(part) << np.uint64(40))
            seen += len(source)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(source, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "slot": pa.array(mix(order + np.uint64(1)).view(np.int64)),
            }
            if with_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _pack_group(capacity: Capacity):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "slot"], ascending=[False, True], ignore_index=True)
        bins, offsets = pack_vectors(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["bin_group"].astype("int64") * (1 << 32) + bins, offset=offsets)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` on request).

    A null or empty text is the end token alone; repeated rows are packed each; a null id stays null; an empty table
    gives an empty result; other columns are ignored, whatever their names. Equal lengths are taken in an arbitrary
    but fixed order.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, slot long" + (", ids array<int>" if with_ids else "")
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(docs.mapInArrow(tidy(_pieces(tokenizer_path, end_id, capacity.tokens, with_ids)), shape), "pieces")
    groups = max(1, math.ceil(pieces.count() / GROUP))
    dealt = pieces.withColumn("bin_group", F.pmod("slot", F.lit(groups)))
    packed = dealt.groupBy("bin_group").applyInPandas(tidy_group(_pack_group(capacity)), f"{shape}, bin_group long, sequence_id long, offset long")
    return packed.drop("slot", "bin_group")
