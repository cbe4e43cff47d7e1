"""Near-duplicate documents by HyperMinHash.

A document is the set of its 5-word shingles. A sketch has ``REGISTERS`` buckets; each keeps, of the smallest hash that
fell into it, the count of leading zeros and ``MANTISSA`` bits. Bands of registers (empty ones filled from other
buckets of the same sketch) propose pairs; the registers' Jaccard estimate, corrected for chance collisions, discards
the hopeless ones; the full sets decide.

Documents with equal sets are one class, so copies cost one row each. Large groups never spread into all their pairs:
first every class of a bucket is compared with the bucket's leader, and the links found are contracted to components.
What is left of buckets whose classes are still in different components is dealt into blocks of bounded size; blocks
that share a bucket meet, and within such a pair of blocks classes of different components are compared: sizes, then
estimates, then sets. A pair within one component needs no comparison, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.textkernel import is_space, lower_ascii, mix, runs, shingles, slices, tidy, tidy_group, word_hashes

WORDS = 5
#: Links need SHARE_OF * intersection >= SHARE * union.
SHARE, SHARE_OF = 75, 100
REGISTERS, MANTISSA, ROWS = 128, 10, 4
#: Standard deviations by which an estimate may fall short of the threshold.
SIGMAS = 5.0
#: Shingles of a block; one class with more is a block of its own.
BLOCK_SHINGLES = 1 << 15
#: Classes of one component that stand in blocks of their own, which need not meet each other.
LARGE = 64
#: Parts into which the classes of one home are dealt where they meet facts about it, as one home may have most of them.
SALTS = 64
_CHANCE = 4 * 0.17 / (1 << MANTISSA)
_BUCKET_BITS = REGISTERS.bit_length() - 1


def registers(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS registers of ordered distinct hashes, 0 where a bucket is empty."""
    out = np.zeros((n, REGISTERS), np.uint16)
    if not len(values):
        return out
    bucket = (values >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
    place = owner * REGISTERS + bucket
    first = np.concatenate([[True], place[1:] != place[:-1]])
    rest = values[first] << np.uint64(_BUCKET_BITS)
    top = rest >> np.uint64(11)
    zeros = (53 - np.frexp(top.astype(np.float64))[1]).astype(np.uint64)
    zeros = np.where(top == 0, np.uint64(53), zeros)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[place[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def _donors(tries: int = 256) -> np.ndarray:
    return (mix(np.arange(tries * REGISTERS, dtype=np.uint64) + np.uint64(977)) % np.uint64(REGISTERS)).astype(np.int64).reshape(tries, REGISTERS)


def bands(regs: np.ndarray) -> np.ndarray:
    """Keys of the bands; an empty register takes the value of the first filled one on its own fixed path."""
    filled = regs > 0
    full = regs.astype(np.uint64)
    open_ = np.flatnonzero(filled.any(1) & ~filled.all(1))
    todo = ~filled[open_]
    part, have = full[open_], filled[open_]
    for path in _donors():
        if not todo.any():
            break
        take = todo & have[:, path]
        part = np.where(take, part[:, path] | np.uint64(1 << 32), part)  # a taken value is told from an own one only by the path
        todo &= ~take
    part &= np.uint64(0xFFFFFFFF)
    full[open_] = part
    grouped = full.reshape(len(regs), REGISTERS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(REGISTERS // ROWS, dtype=np.uint64) + np.uint64(1), grouped.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[float, int]:
    """Jaccard estimate of two sketches, less the registers expected to agree by chance, and the registers it rests on.

    Independent minima of na and nb values agree in a register with probability of about 0.17 / 2^MANTISSA times
    4 (na / nb) / (1 + na / nb)^2.
    """
    used = int(((a > 0) | (b > 0)).sum())
    if not used:
        return 0.0, 0
    same = int(((a == b) & (a > 0)).sum())
    ratio = na / nb
    chance = _CHANCE * ratio / (1 + ratio) ** 2 * used
    return max(0.0, (same - chance) / used), used


def hopeful(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> bool:
    j, used = estimate(a, b, na, nb)
    goal = SHARE / SHARE_OF
    return SHARE_OF * min(na, nb) >= SHARE * max(na, nb) and j + SIGMAS * (goal * (1 - goal) / max(used, 1)) ** 0.5 >= goal


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ordered distinct sets reach the similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE_OF * common >= SHARE * (len(a) + len(b) - common)


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of texts: the ordered distinct shingle hashes of all its texts, and their bounds."""
    for piece in slices(column):
        data = lower_ascii(piece.data)
        words = runs(~is_space(data), piece.offsets)
        values, bounds = shingles(word_hashes(data, words.start, words.end), words.bounds, WORDS)
        sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        yield (np.concatenate(sets) if sets else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def _digest(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes(), usedforsecurity=False).digest()


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for flat, bounds in shingle_sets(batch.column("text")):
            n = len(bounds) - 1
            sizes = np.diff(bounds)
            regs = registers(flat, np.repeat(np.arange(n), sizes), n)
            keys = bands(regs)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(at, n),
                "n_shingles": pa.array(sizes),
                "digest": pa.array([_digest(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1))),
                "regs": pa.array([r.tobytes() for r in regs], pa.binary()),
            })
            at += n


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for flat, bounds in shingle_sets(batch.column("text")):
            own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([_digest(s) for s in own], pa.binary()), "members": pa.array([s.tobytes() for s in own], pa.binary())})


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {k: batch.column(k) for k in ("regs_a", "regs_b", "members_a", "members_b")}
        keep = []
        for i in range(len(batch)):
            a, b = (np.frombuffer(col[f"members_{s}"][i].as_py(), np.uint64) for s in "ab")
            ra, rb = (np.frombuffer(col[f"regs_{s}"][i].as_py(), np.uint16) for s in "ab")
            keep.append(hopeful(ra, rb, len(a), len(b)) and linked(a, b))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def connected_components(links: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the components of undirected links, by contraction.

    Every round each node joins its smallest neighbour and edges are rewritten to the joined nodes; nodes are named by
    digests, whose order is random, so the number of edges shrinks by a constant share a round. Rows of a hub are
    aggregated before they are shuffled.
    """
    edges = scratch.keep(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), f"{name}-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    step = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        down = scratch.keep(both.groupBy(F.col("a").alias("from")).agg(F.least(F.min("b"), F.col("from")).alias("to")), f"{name}-down{step}")
        roots = scratch.keep(roots.join(down, roots["root"] == down["from"], "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-roots{step}")
        left, right = down.select(F.col("from").alias("a"), F.col("to").alias("x")), down.select(F.col("from").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = scratch.keep(moved.filter("a <> b").distinct(), f"{name}-edges{step}")
        step += 1
    return roots


def _near(regs: np.ndarray, sizes: np.ndarray, i: int) -> np.ndarray:
    """Later classes, in order of size, whose sketches do not rule out a link with class i."""
    stop = int(np.searchsorted(sizes * SHARE, sizes[i] * SHARE_OF, side="right"))  # sizes grow, so partners are a run
    if stop <= i + 1:
        return np.zeros(0, np.int64)
    goal, rest = SHARE / SHARE_OF, slice(i + 1, stop)
    filled = (regs[rest] > 0) | (regs[i] > 0)
    used = filled.sum(1)
    same = ((regs[rest] == regs[i]) & filled).sum(1)
    ratio = sizes[i] / sizes[rest]
    guess = (same - _CHANCE * ratio / (1 + ratio) ** 2 * used) / np.maximum(used, 1)
    return np.flatnonzero(guess + SIGMAS * np.sqrt(goal * (1 - goal) / np.maximum(used, 1)) >= goal) + i + 1


def _sorted_block(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    group = group.drop_duplicates("node").sort_values("n", ignore_index=True)
    return group, group["n"].to_numpy(), np.stack([np.frombuffer(r, np.uint16) for r in group["regs"]])


def _screen_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Classes of a pair of blocks with a partner of another component that their sketches allow; only their sets are needed."""
    pair = group["pair"].iloc[0]
    group, sizes, regs = _sorted_block(group)
    root = group["root"].to_numpy()
    wanted = np.zeros(len(group), bool)
    for i in range(len(group)):
        near = _near(regs, sizes, i)
        near = near[root[near] != root[i]]
        if len(near):
            wanted[i] = wanted[near] = True
    return pd.DataFrame({"pair": pair, "node": group["node"][wanted]})


def _compare_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Links between classes of different components in a pair of blocks; a link joins them for what follows."""
    group, sizes, regs = _sorted_block(group)
    sets: dict[int, np.ndarray] = {}
    members = group["members"].to_list()
    root = group["root"].to_numpy().copy()
    found = []
    for i in range(len(group)):
        for j in _near(regs, sizes, i):
            if root[i] == root[j]:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = np.frombuffer(members[k], np.uint64)
            if linked(sets[i], sets[j]):
                found.append((group["node"][i], group["node"][j]))
                root[root == root[j]] = root[i]
    return pd.DataFrame(found, columns=["a", "b"])


def _blocks(mixed: DataFrame) -> DataFrame:
    """node, root, block: classes of similar sizes and a common leader, in blocks of bounded size.

    Large components stand apart from the rest, so that blocks of one component do not meet.
    """
    nodes = mixed.groupBy("node").agg(F.min("leader").alias("home"), F.first("root").alias("root"), F.first("n").alias("n"))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))

    def salted(facts: DataFrame) -> DataFrame:
        """One row of each salt; facts are only of groups that are large, so their rows stay fewer than the classes'."""
        return facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    weights = nodes.groupBy("home", "root").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= LARGE).select("home", "root", F.lit(True).alias("large"))
    tagged = nodes.join(salted(weights), ["home", "root", "salt"], "left").withColumn("part", F.when(F.col("large"), F.hex("root")).otherwise("")).withColumn("size", F.floor(F.log(F.col("n")) / F.log(F.lit(SHARE_OF / SHARE))))
    group = ["home", "part", "size"]
    slots = tagged.groupBy(*group).agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("slots")).filter("slots > 1")
    placed = tagged.join(salted(slots), [*group, "salt"], "left").withColumn("slot", F.pmod(F.xxhash64("node", F.lit("slot")), F.coalesce("slots", F.lit(1))))
    return placed.select("node", "root", "n", "part", "size", F.struct(*group, "slot").alias("block"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest id reachable by links) and kept.

    A null, empty or blank text has no shingles and is a component of its own. Rows of one id and text share a
    component, repeated or not; a null id has no place in the order, so its row is linked with nothing, has a null
    component and is kept. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketches = scratch.keep(docs.mapInArrow(tidy(_sketch), f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, regs binary"), "sketches")
    usable = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.keep(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "classes")
    chosen = usable.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    rows = chosen.select("digest", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), F.col("digest").alias("node"))
    shared = rows.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last").select("key", "leader")
    members = scratch.keep(rows.join(shared, "key"), "members")

    needed = members.select("node").distinct()
    needed = scratch.keep(needed.join(classes, needed["node"] == classes["digest"]).select("node", "rep", "n"), "needed")
    texts = docs.join(needed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(tidy(_sets), "digest binary, members binary")
    own = chosen.select(F.col("digest").alias("node"), "regs").join(needed.select("node"), "node", "left_semi").dropDuplicates(["node"])
    full = scratch.keep(sets.withColumnRenamed("digest", "node").dropDuplicates(["node"]).join(own, "node"), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        sides = [full.select(F.col("node").alias(s), F.col("regs").alias(f"regs_{s}"), F.col("members").alias(f"members_{s}")) for s in "ab"]
        joined = pairs.join(sides[0], "a").join(sides[1], "b")
        return scratch.keep(joined.select("a", "b", "regs_a", "regs_b", "members_a", "members_b").mapInArrow(tidy(_verify), "a binary, b binary"), name)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()

    stars = scratch.keep(ordered(members.select(F.col("leader").alias("a"), F.col("node").alias("b"))), "stars")
    links = verified(stars, "star-links")
    roots = connected_components(links, scratch, "first")
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
    mixed = scratch.keep(placed.join(split, "key", "left_semi").join(needed.select("node", "n"), "node"), "mixed")
    blocks = scratch.keep(_blocks(mixed), "blocks")
    at = scratch.keep(mixed.select("key", "node").join(blocks.select("node", "part", "size", "block"), "node").select("key", "part", "size", "block").distinct(), "block-keys")
    one, two = at.alias("one"), at.alias("two")
    meet = (F.col("one.key") == F.col("two.key")) & (F.col("one.block") <= F.col("two.block")) & ((F.col("one.part") != F.col("two.part")) | (F.col("one.part") == "")) & (F.abs(F.col("one.size") - F.col("two.size")) <= 1)
    pairs = scratch.keep(one.join(two, meet).select(F.col("one.block").alias("x"), F.col("two.block").alias("y")).distinct(), "block-pairs")
    sides = pairs.select(F.xxhash64("x", "y").alias("pair"), F.explode(F.array("x", "y")).alias("block")).distinct()
    # Sketches travel first; the sets follow only for classes that they leave in doubt.
    stored = scratch.keep(blocks.select("node", "root", "n", "block").join(full.select("node", "regs"), "node"), "stored")
    sketched = sides.join(stored, "block").select("pair", "node", "root", "n", "regs")
    wanted = scratch.keep(sketched.groupBy("pair").applyInPandas(tidy_group(_screen_blocks), "pair long, node binary"), "wanted")
    dealt = wanted.join(full, "node").join(stored.select("node", "root", "n"), "node").select("pair", "node", "root", "n", "regs", "members")
    links = links.union(scratch.keep(dealt.groupBy("pair").applyInPandas(tidy_group(_compare_blocks), "a binary, b binary"), "block-links"))
    roots = connected_components(links, scratch, "last")
    grouped = classes.join(roots, classes["digest"] == roots["node"], "left").select("digest", "rep", F.coalesce("root", "digest").alias("root"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(grouped.join(least, "root").select("digest", "component_id"), "components")
    scratch.keep_only("sketches", "components")
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
