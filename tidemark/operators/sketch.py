"""Correlation sketches: the rows of an aggregated table with the k smallest key hashes.

Tables that share keys keep the same ones, so sketches join into a sample of the join. A sketch of keys is all that is
needed to merge: the k smallest of two sketches' keys are the sketch of both tables together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
#: The golden ratio.
GOLDEN = 1.6180339887498949025


def _times(a: Column, c: int) -> Column:
    """a * c modulo 2^32; the halves of c keep every product within a long."""
    return (a * (c & 0xFFFF) + (((a * (c >> 16)).bitwiseAND(0xFFFF)) * 65536)).bitwiseAND(_MASK)


def _turned(a: Column, r: int) -> Column:
    return F.shiftleft(a, r).bitwiseOR(F.shiftright(a, 32 - r)).bitwiseAND(_MASK)


def _word(digits: Column, at: Column | int, n: int) -> Column:
    """n bytes of a hexadecimal text from byte ``at`` on, the first the lowest."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.concat(*(F.substr(digits, 2 * (start + i) + 1, F.lit(2)) for i in reversed(range(n)))), 16, 10).cast("long")


def _let(x: Column, f) -> Column:
    """f(x) with x taken once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _folded(shift: int, factor: int):
    return lambda x: _times(x.bitwiseXOR(F.shiftright(x, shift)), factor)


def murmur3(val: Column) -> Column:
    """The signed 32-bit Murmur3 hash, seed 0, of a text's UTF-8 bytes, as column arithmetic; Spark's own ``hash`` treats seeds and ends otherwise."""
    digits = F.hex(val.cast("binary"))
    size = F.octet_length(val)
    blocks = F.floor(size / 4).cast("int")
    scramble = lambda k: _times(_let(_times(k, 0xCC9E2D51), lambda x: _turned(x, 15)), 0x1B873593)
    places = F.filter(F.sequence(F.lit(0), blocks), lambda i: i < blocks)
    step = lambda h, i: (_times(_let(h.bitwiseXOR(scramble(_word(digits, i * 4, 4))), lambda x: _turned(x, 13)), 5) + 0xE6546B64).bitwiseAND(_MASK)
    h = F.aggregate(places, F.lit(0).cast("long"), step)
    rest = size % 4
    tail = F.coalesce(*(F.when(rest == n, _word(digits, blocks * 4, n)) for n in (1, 2, 3)), F.lit(0).cast("long"))
    mixed = _let(h, lambda x: x.bitwiseXOR(scramble(tail)).bitwiseXOR(size.cast("long")))
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        mixed = _let(mixed, _folded(shift, factor))
    return _let(_let(mixed, lambda x: x.bitwiseXOR(F.shiftright(x, 16))), lambda x: F.when(x >= 2**31, x - 2**32).otherwise(x)).cast("int")


def unit_hash(val: Column) -> Column:
    """A key's place in [0, 1): the fraction of its hash plus one times the golden ratio."""
    x = (murmur3(val) + 1).cast("double") * GOLDEN
    return x - F.floor(x)


def _smallest(hashed: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("agg").orderBy("place", "val")
    return hashed.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k).select("agg", "val", "place")


def key_sketch(keys: DataFrame, k: int = 256) -> DataFrame:
    """agg, val, place: each table's k keys that come first by ``unit_hash``; equal places go by the key.

    Ranking drops all but k keys a table in every task before the shuffle, so no table is gathered whole.
    """
    return _smallest(keys.select("agg", "val", unit_hash(F.col("val")).alias("place")), k)


def unite(*sketches: DataFrame, k: int = 256) -> DataFrame:
    """The sketch of all rows behind stored sketches (agg, val, place), from these alone; a key of several stands once."""
    together = sketches[0]
    for s in sketches[1:]:
        together = together.unionByName(s)
    return _smallest(together.select("agg", "val", "place").distinct(), k)


def estimate_keys(sketch_keys: DataFrame, k: int = 256) -> DataFrame:
    """agg, n_keys: distinct keys of each table, exact below k, else (k - 1) / the largest place."""
    n = F.count(F.lit(1))
    return sketch_keys.groupBy("agg").agg(F.when(n < k, n.cast("double")).otherwise((k - 1) / F.max("place")).alias("n_keys"))


def sketch(long: DataFrame, k: int = 256) -> DataFrame:
    """The long form cut to each table's k first keys."""
    keys = key_sketch(long.filter(F.col("var") == "count").select("agg", "val"), k)
    return long.join(keys.select("agg", "val"), ["agg", "val"], "left_semi")


def sketch_correlations(long: DataFrame, pairs: DataFrame, k: int = 256) -> DataFrame:
    """Correlations of the joined sketches that have at least three rows."""
    from tidemark.operators.correlate import pearson_pairs

    return pearson_pairs(sketch(long, k), pairs).filter("n >= 3")
