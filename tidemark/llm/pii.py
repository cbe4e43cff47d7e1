"""Personal data by pattern, checksum and context, as DataFrame functions only.

A regular expression proposes spans of a kind, leftmost first and without overlap; a validator (Luhn, mod 97, number
ranges, digit counts) confirms them; words near a span raise its score. Kinds whose pattern alone says little are kept
only from a score that context must lift them to.

The patterns are written so that Java's matcher takes time linear in the text: a run of characters is entered only at
its start (or where the last match ended), and is never given back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """ISO 7064 over the rotated number, letters counting as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    signs = F.filter(turned, lambda c: c != "")
    return F.length(plain).between(15, 34) & (F.aggregate(signs, F.lit(0), add) == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    context: str  # words that lift the score by LIFT if they stand within NEAR characters
    base: bool = True


LIFT, NEAR, THRESHOLD = 0.3, 40, 0.6

#: In the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.7, "e-?mail|contact|write|mailto"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), 0.6, r"\bip\b|address|host|server|login"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++", lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)), 0.6, "card|visa|mastercard|credit|payment|expir"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), 0.6, r"phone|mobile|\btel\b|call|fax|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _mod97, 0.6, "iban|account|konto|bank|compte|cuenta", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", None, 0.35, r"\bssn\b|social security", base=False),
    Kind("tel", r"(?<![0-9+.)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", None, 0.35, r"phone|mobile|\btel\b|call|fax|whatsapp", base=False),
)


#: Elements of an array that are folded in one go. Prefixes are taken block by block, and of the blocks' totals likewise,
#: so that no step copies more than one block.
_BLOCK = 64
#: Code points of the pieces that a text is cut into once, so that a stretch is found without reading what precedes it.
_PIECE = 1024


def _blocks(values: Column) -> Column:
    """Numbers of the blocks of an array, from 0."""
    n = F.ceil(F.size(values) / _BLOCK).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _block(values: Column, i: Column) -> Column:
    places = F.sequence(i * _BLOCK, F.least((i + 1) * _BLOCK, F.size(values)) - 1)
    return F.transform(places, lambda j: F.get(values, j))  # slice() reads all that precedes


Fold = Callable[[Column, Column], Column]


def _totals(values: Column, fold: Fold) -> Column:
    return F.transform(_blocks(values), lambda i: F.aggregate(_block(values, i), F.lit(0).cast("long"), fold))


def _within(block: Column, base: Column, fold: Fold) -> Column:
    """What precedes each element of one block, from ``base`` on."""
    start = F.struct(base.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(block, start, lambda acc, x: F.struct(fold(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def _spread(values: Column, bases: Column, fold: Fold) -> Column:
    # Zipped, as the optimiser would move an array that is named once into the function, to be made again for each element.
    return F.flatten(F.transform(F.arrays_zip(_blocks(values).alias("i"), bases.alias("base")), lambda x: _within(_block(values, x["i"]), x["base"], fold)))


def with_prefixes(frame: DataFrame, name: str, values: str, fold: Fold = lambda a, b: a + b) -> DataFrame:
    """Add for an array of non-negative longs a column of what ``fold`` makes of the elements before each one.

    Three levels of blocks: the work is linear up to millions of elements.
    """
    step = [f"{name}_{k}" for k in "abcd"]
    frame = frame.withColumn(step[0], _totals(F.col(values), fold))
    frame = frame.withColumn(step[1], _totals(F.col(step[0]), fold))
    frame = frame.withColumn(step[2], _within(F.col(step[1]), F.lit(0).cast("long"), fold))
    frame = frame.withColumn(step[3], _spread(F.col(step[0]), F.col(step[2]), fold))
    return frame.withColumn(name, _spread(F.col(values), F.col(step[3]), fold)).drop(*step)


def cut(text: Column) -> Column:
    """A text's pieces of ``_PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def stretch(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text that was cut into ``pieces``."""
    first = F.floor(start / _PIECE).cast("int")
    held = F.array_join(F.transform(F.sequence(first, F.floor((end - 1) / _PIECE).cast("int")), lambda j: F.get(pieces, j)), "")
    return F.when(end > start, F.substr(held, (start - first.cast("long") * _PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def _of_kind(k: Column, values: list[Column]) -> Column:
    """The value of the kind numbered ``k``; only that one is computed."""
    out = values[-1]
    for i in range(len(values) - 2, -1, -1):
        out = F.when(k == i, values[i]).otherwise(out)
    return out


def find_spans(docs: DataFrame, text_col: str = "text", prefix: str = "__pii") -> DataFrame:
    """Add ``<prefix>_spans``: kind (its place in ``KINDS``), start, end (code points of the whole text) and score, by kind, then start.

    ``<prefix>_pieces`` holds the text's pieces where anything matched, else null. All steps are linear in the text and
    in the number of its matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda step: f"{prefix}_{step}"
    matches, gaps = ([name(f"{k.name}_{s}") for k in KINDS] for s in "mg")
    out = docs.withColumns({m: F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k, m in zip(KINDS, matches)})
    # What lies between the matches tells where they are.
    out = out.withColumns({g: F.when(F.size(m) > 0, F.split(text, k.pattern, -1)) for k, m, g in zip(KINDS, matches, gaps)})

    def listed(i: int) -> Column:
        paired = F.arrays_zip(F.col(matches[i]).alias("m"), F.slice(F.coalesce(gaps[i], F.array().cast("array<string>")), 1, F.size(matches[i])).alias("g"))
        return F.transform(paired, lambda x, j: F.struct(F.lit(i).alias("kind"), j.alias("j"), F.length(x["g"]).cast("long").alias("gap"), x["m"].alias("value")))

    out = out.withColumn(name("all"), F.concat(*map(listed, range(len(KINDS)))))
    out = out.withColumns({
        name("z"): F.transform(name("all"), lambda x: x["gap"] + F.length(x["value"])),
        name("n"): F.array(*(F.size(m) for m in matches)),
        name("pieces"): F.when(F.size(name("all")) > 0, cut(text)),
        name("length"): F.length(text).cast("long"),
    }).drop(*matches, *gaps)
    out = with_prefixes(out, name("s"), name("z"))
    before = F.aggregate(F.slice(name("n"), 1, len(KINDS) - 1), F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    out = out.withColumn(name("f"), before)  # where each kind's matches begin in the list

    def placed(x: Column) -> Column:
        first = F.get(name("f"), x["kind"])
        start = F.get(name("s"), first + x["j"]) - F.get(name("s"), first) + x["gap"]
        return F.struct(x["kind"].alias("kind"), start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

    sure = F.filter(name("all"), lambda x: _of_kind(x["kind"], [F.lit(True) if k.valid is None else k.valid(x["value"]) for k in KINDS]))
    out = out.withColumn(name("l"), F.transform(sure, placed))
    pieces, length = F.col(name("pieces")), F.col(name("length"))

    def rate(s: Column) -> Column:
        left = stretch(pieces, F.greatest(s["start"] - NEAR, F.lit(0).cast("long")), s["start"])
        right = stretch(pieces, s["end"], F.least(s["end"] + NEAR, length))
        near = F.lower(F.concat(left, F.lit(" "), right))
        context = F.element_at(F.array(*(F.lit(k.context) for k in KINDS)), s["kind"] + 1)
        score = F.element_at(F.array(*(F.lit(k.score) for k in KINDS)), s["kind"] + 1) + F.when(F.regexp(near, context), LIFT).otherwise(0.0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    out = out.withColumn(name("r"), F.transform(name("l"), rate))
    base = F.array(*(F.lit(k.base) for k in KINDS))
    out = out.withColumn(name("spans"), F.filter(name("r"), lambda s: F.element_at(base, s["kind"] + 1) | (s["score"] >= THRESHOLD)))
    return out.drop(*map(name, ("all", "z", "n", "s", "f", "l", "r", "length")))


_NAMES = [k.name for k in KINDS]


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _NAMES)), kind + 1)


def _list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, the number of spans of each kind, ``base_sha256``, ``spans`` and their scores.

    ``spans`` lists kind:start:end, by kind, then start; ``base_sha256`` hashes that list of the four base kinds. A
    null or empty text has none; repeated rows each give a row; a null id stays null; an empty table gives an empty
    result; other columns are ignored. Spans of different kinds may overlap.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, spans = find_spans(docs), F.col("__pii_spans")
    base = [i for i, k in enumerate(KINDS) if k.base]
    return found.select(
        "doc_id",
        *(_count(spans, i).alias(f"n_{k}") for i, k in enumerate(_NAMES)),
        F.sha2(_list(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _list(spans).alias("spans"),
        F.round(F.array_max(F.transform(spans, lambda s: s["score"])), 2).alias("top_score"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by ``[KIND]``; a text without spans, or null, stays as it is.

    Of overlapping spans the first gives the name, and all their text goes.
    """
    before = docs.columns
    found = find_spans(docs)
    text, spans = F.col(text_col), F.col("__pii_all")
    # In order of start, the longest first, then by kind.
    found = found.withColumn("__pii_all", F.array_sort(F.transform("__pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))))
    found = found.withColumn("__pii_ends", F.transform(spans, lambda s: -s["back"]))
    found = with_prefixes(found, "__pii_seen", "__pii_ends", lambda a, b: F.greatest(a, b))  # how far the spans before each one reach

    def piece(s: Column, i: Column) -> Column:
        seen = F.get("__pii_seen", i)
        return F.when(s["start"] >= seen, F.concat(stretch(F.col("__pii_pieces"), seen, s["start"]), F.lit("["), F.upper(_name(s["kind"])), F.lit("]"))).otherwise("")

    length = F.length(text).cast("long")
    joined = F.concat(F.array_join(F.transform(spans, piece), ""), stretch(F.col("__pii_pieces"), F.array_max("__pii_ends"), length))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, joined).otherwise(text)).select(*before)
