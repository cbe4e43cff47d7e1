"""URL filters: a rule list, and logistic regression on hashed character n-grams where no rule fits.

Everything that touches the table is a DataFrame function. The weights come from a small table of labelled URLs, whose
features the same expressions compute; only those few rows reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets of n-grams, and their sizes.
BUCKETS, SIZES = 4096, (3, 4)
#: Rows of the labelled table that the driver takes at most.
MAX_LABELLED = 2000

#: Verdict, host, path. A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Words of hosts and paths that corpora shun (gambling, drugs, sex, loans, pirated software, adverts, spam) and of
#: ordinary sites; ``labelled_table`` makes the labelled URLs of them by a rule.
UNWANTED = (
    "casino poker roulette blackjack jackpot slots bingo lottery betting bookmaker sportsbook wager pills viagra cialis pharmacy steroids tramadol xanax meds porn xxx "
    "sex nude erotic escort camgirls hentai milf fetish payday loans lender creditfix debt forex binary bitcoinx crack keygen warez torrent serialz cracked nulled "
    "adserver adclick banner popunder tracker clickfraud affiliate sponsor pixel retarget spam spammer backlinks linkfarm doorway replica counterfeit malware phishing trojan"
).split()
WANTED = (
    "news science museum library university college hospital weather recipes garden history music theatre cinema travel railway airport council parliament court "
    "school teacher physics chemistry biology algebra geography poetry novel painting sculpture architecture football cycling hiking climbing swimming chess gallery archive journal "
    "encyclopedia dictionary manual docs forum wiki blog community software compiler database network research institute society charity church festival market"
).split()


def labelled_table(unwanted=UNWANTED, wanted=WANTED) -> list[tuple[str, float, bool]]:
    """(url, 1 for unwanted, held out): each word on hosts of four shapes with words of its own kind; one row in five is held out."""
    shapes = ("www.{a}{b}.example/{c}", "{a}-{b}.example/{c}/{n}", "m.{b}.{a}.example/{c}.html", "best{a}.example/{b}/{c}")
    plain = ("www.{a}.example/{b}/{c}", "{a}.{b}.example/{c}/{n}", "m.{a}.example/{b}-{c}.html", "the{a}.example/{b}/{n}")
    rows = []
    for y, words, forms in ((1.0, unwanted, shapes), (0.0, wanted, plain)):
        for i, a in enumerate(words):
            for k, form in enumerate(forms):
                b, c = words[(7 * i + 3 * k + 1) % len(words)], words[(11 * i + 5 * k + 2) % len(words)]
                rows.append(("http://" + form.format(a=a, b=b, c=c, n=37 * i % 1000), y, (i + k) % 5 == 0))
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    known = F.coalesce(at > 0, F.lit(False))
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def ngram_buckets(text: Column) -> Column:
    """Hash buckets of the character n-grams of ``text``."""

    def of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(places, lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.concat(*(of(n) for n in SIZES))


def _shown(host: Column, path: Column) -> Column:
    return F.concat(F.lit("^"), host, path, F.lit("$"))


def labelled_urls(spark: SparkSession, held_out: bool = False) -> DataFrame:
    """url and unwanted of the rows to train on, or of those held out."""
    return spark.createDataFrame([(u, y) for u, y, h in labelled_table() if h == held_out], "url string, unwanted double")


def train(labelled: DataFrame, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, by gradient ascent over at most ``MAX_LABELLED`` rows (url, unwanted)."""
    host, path = split_url(F.col("url"))
    rows = labelled.select(ngram_buckets(_shown(host, path)).alias("b"), F.col("unwanted").cast("double").alias("y")).orderBy("url").limit(MAX_LABELLED).collect()
    weights, intercept = [0.0] * BUCKETS, 0.0
    if not rows:
        return weights, intercept
    for _ in range(rounds):
        slope: dict[int, float] = {}
        bias = 0.0
        for r in rows:
            z = intercept + sum(weights[b] for b in r.b)
            miss = r.y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += miss
            for b in r.b:
                slope[b] = slope.get(b, 0.0) + miss
        for b, g in slope.items():
            weights[b] += rate * (g / len(rows) - ridge * weights[b])
        intercept += rate * bias / len(rows)
    return weights, intercept


def score(text: Column, weights: list[float], intercept: float) -> Column:
    table = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")
    z = F.aggregate(ngram_buckets(text), F.lit(float(intercept)), lambda acc, b: acc + F.get(table, b))
    return 1 / (1 + F.exp(-z))


def judge(pages: DataFrame, weights: list[float], intercept: float, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row: page_id, host, path, rule (like ``net/``, else null), verdict and the method's score.

    The longest fitting rule decides, otherwise a score of 0.5 blocks. A null url has empty host and path and is
    judged by the method alone; repeated rows each give a row; a null id stays null; an empty table gives an empty
    result; other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.endswith("host", F.lit(f".{rule_host}"))) & F.startswith("path", F.lit(rule_path))
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    rated = parts.withColumn("score", score(_shown(F.col("host"), F.col("path")), weights, intercept))
    return rated.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
