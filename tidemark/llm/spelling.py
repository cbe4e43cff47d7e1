"""Spelling variants: words one edit apart from a far more frequent one, found by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Words that share a key meet in an equi-join, their
distance is verified to be exactly one, each word's best neighbour becomes its form, and forms are followed to a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Letters of a word, and the 26 that are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 6, 5, 5


def _without(word: Column, at: Column) -> Column:
    """A word without its code point ``at`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flaw_every: int | None = 199, least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per word of at least ``least_length`` code points in the texts: word.

    With ``flaw_every`` a run whose checksum with its document's id is a multiple of it loses one letter, a stand-in for
    typing errors that tests can recompute. A null text has no words; a null id counts as an empty one.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run")).filter(F.length("run") >= least_length)
    lowered = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if flaw_every:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        marked = lowered.select("word", h.alias("h"))
        flawed = _without(F.col("word"), F.pmod(F.col("h"), F.length("word").cast("long")).cast("int"))
        lowered = marked.select(F.when(F.col("h") % flaw_every == 0, flawed).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_length)
    return lowered.select("word")


def count_words(found: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that occur at least so often; occurrences are added up before they are shuffled."""
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def deletion_keys(vocabulary: DataFrame) -> DataFrame:
    """word, n, key, first, last: the word itself (first null), and each distinct single deletion with the range of places that give it.

    Dropping any letter of a run of equal letters gives the same key; the range is that run.
    """
    word = F.col("word")
    letter = lambda i: F.substr(word, i, F.lit(1))
    starts = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: (i == 1) | (letter(i) != letter(i - 1)))
    ends = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: (i == F.length(word)) | (letter(i) != letter(i + 1)))
    none = F.lit(None).cast("int")
    itself = F.array(F.struct(word.alias("key"), none.alias("first"), none.alias("last")))
    cut = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.struct(_without(word, r["s"] - 1).alias("key"), r["s"].alias("first"), r["e"].alias("last")))
    return vocabulary.select("word", "n", F.inline(F.concat(itself, cut)))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, other, n_other: each ordered pair of words exactly one inserted, deleted or replaced code point apart, once.

    Two deletions of a key are one replacement apart if their ranges of places meet, which the join itself tests; a word
    and a deletion that equals it are one letter apart. So no pair leaves the join that is not a neighbour, and a key
    of k letters holds at most one word for each place and letter, however many rows the corpus has.
    """
    keys = deletion_keys(vocabulary)
    one = keys.select("key", "word", "n", "first", "last")
    two = keys.select(F.col("key").alias("key2"), F.col("word").alias("other"), F.col("n").alias("n_other"), F.col("first").alias("first2"), F.col("last").alias("last2"))
    meets = F.col("first").isNull() | F.col("first2").isNull() | ((F.col("first") <= F.col("last2")) & (F.col("first2") <= F.col("last")))
    met = one.join(two, (F.col("key") == F.col("key2")) & (F.col("word") != F.col("other")) & meets)
    return met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "n_other")


def forms(vocabulary: DataFrame, least_ratio: int = LEAST_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: how many words are near, and the commonest of them where it is ``least_ratio`` times as frequent.

    Of equally frequent neighbours the smallest in code-point order counts; without such a neighbour the form is null.
    """
    best = F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("other")))
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= F.col("n") * least_ratio
    joined = vocabulary.join(near, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))


def roots(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for the words that have a form: forms are followed to the last by joining roots with roots.

    Each round doubles the steps that are covered. A form is ``LEAST_RATIO`` times as frequent as its word, so the
    longest chain, and with it the number of rounds, grows with the logarithm of a count.
    """
    found = scratch.keep(linked.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots0")
    turn = 0
    while found.join(found.select(F.col("word").alias("root")), "root", "left_semi").limit(1).count():
        turn += 1
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = scratch.keep(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots{turn}")
        scratch.drop(f"roots{turn - 1}")
    return found


def group_variants(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of a table of distinct words with their counts n (other columns are ignored).

    Words without a form are their own root; an empty vocabulary gives no rows.
    """
    scratch = Scratch(vocabulary.sparkSession, "spelling")
    kept = scratch.keep(vocabulary.select("word", "n"), "vocabulary")
    linked = scratch.keep(forms(kept), "forms")
    rooted = linked.join(roots(linked, scratch), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of whole texts. Null and empty texts have no words; repeated rows count each time;
    other columns, whatever their names, are ignored; an empty table gives no rows."""
    return group_variants(count_words(words(docs, id_col, text_col)))
