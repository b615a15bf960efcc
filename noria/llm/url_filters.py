"""URL filters in built-in functions only: rules first, then logistic regression.

The model sums weights of hashed character n-grams of host and path. It is trained on a small
labelled URL table (at most MAX_EXAMPLES rows, ``labelled_urls`` by default): Spark turns its URLs
into buckets by the same expression that scores the corpus, and gradient descent on these few rows
gives the weights, which go into the query as a literal of BUCKETS numbers. Scoring is one narrow
projection without shuffle, Python or broadcast join.

A null url, or one without ``://``, has an empty host and path; no rule fits it and the model judges
it by its intercept. Ties between rules of equal length go to the one given first. Empty tables
give empty results; extra columns are not read; repeated rows are judged each.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import clean_input

BUCKETS, SIZES = 4096, (3, 4)
MAX_EXAMPLES, MAX_RULES = 2_000, 500


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? or #."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def buckets(host: Column, path: Column) -> Column:
    """Hash buckets of all n-grams of host and path; a gram knows which of the two it is from."""

    def grams(text: Column, mark: str, n: int) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, n)), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[grams(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in SIZES])


#: Words of hosts to block, by family.
JUNK = {
    "gambling": ("casino", "bet", "bets", "betting", "poker", "slots", "jackpot", "roulette", "lotto", "wager"),
    "prizes": ("win", "winner", "prize", "prizes", "free", "bonus", "giveaway", "lucky"),
    "adult": ("adult", "xxx", "porn", "sex", "cams", "escort", "nude"),
    "spam": ("spam", "seo", "backlinks", "links", "farm", "clickbait", "traffic"),
    "ads": ("ads", "adserver", "click", "banner", "track", "tracker", "popunder"),
    "drugs": ("pills", "pill", "cheap", "viagra", "pharma", "meds", "discount"),
    "piracy": ("crack", "keygen", "torrent", "warez", "serial"),
    "loans": ("loan", "loans", "payday", "credit", "crypto", "forex"),
}
_GOOD = "www blog docs news wiki library museum school city garden travel history science health music weather review daily forum press journal gallery kitchen sports open river mountain house green book art data".split()
_SYLLABLES = "ba de ka lo mi no pu ri so ta ve zu el an or in un est ol th er en ing tion ent and ble st re ha ch ma ter al ons ess the".split()
_FRONTS = ("", "www.", "blog.", "m.")
_PATHS = ("/", "/en/825", "/fr/25930", "/de/5099", "/es/26123/", "/en/2728.html", "/articles/history-of-science", "/wiki/Main_Page", "/2024/05/a-long-read", "/docs/guide/index.html", "/about", "/index.php?id=7")
_JUNK_PATHS = ("/casino/free-spins", "/porn/video", "/viagra-cheap", "/adserver/click", "/crack/keygen", "/free-prizes/win", "/login/redirect", "/cart/checkout", "/cgi-bin/track.gif")


def labelled_urls() -> list[tuple[str, int]]:
    """The default table: (url, 1 to allow, 0 to block), made by rule from words that hosts and paths carry.

    Hosts to block are pairs of words of a family, mostly with the same ordinary paths as the others, so that the
    host has to tell. The hosts are of no given table.
    """
    tops, rows = (".com", ".org", ".net"), []
    for words in JUNK.values():
        for i, a in enumerate(words):
            for n, step in enumerate((1, 2, 3)):
                b = words[(i + step) % len(words)]
                host = (f"{a}-{b}", f"{a}{b}", f"{a}-{b}")[n] + (".example" if n else "") + tops[(i + n) % 3]
                host = _FRONTS[(i + n) % len(_FRONTS)] + host
                rows += [(f"https://{host}{_PATHS[(i * 3 + n * 4 + m) % len(_PATHS)]}", 0) for m in range(4)]
                rows.append((f"https://{host}{_JUNK_PATHS[(i + n) % len(_JUNK_PATHS)]}", 0))
    for i, a in enumerate(_GOOD):
        for n, step in enumerate((1, 5, 11)):
            b = _GOOD[(i + step) % len(_GOOD)]
            host = (f"{a}-{b}", f"{a}{b}", f"{a}.{b}")[n] + (".example" if n else "") + tops[(i + n) % 3]
            host = _FRONTS[(i + n) % len(_FRONTS)] + host
            rows += [(f"https://{host}{_PATHS[(i + n * 5 + m) % len(_PATHS)]}", 1) for m in range(4)]
    # names without a known word are no reason to block
    for i in range(400):
        name = "".join(_SYLLABLES[(i * k + i // m) % len(_SYLLABLES)] for k, m in ((1, 1), (7, 3), (11, 5))[: 2 + i % 2])
        host = _FRONTS[i % len(_FRONTS)] + name + (".example" if i % 3 else "") + tops[i % 7 % 3]
        rows.append((f"https://{host}{_PATHS[i * 5 % len(_PATHS)]}", 1))
    # mixed, as descent takes the rows in turn
    return sorted(rows, key=lambda r: zlib.crc32(r[0].encode()))


def train(spark: SparkSession, examples: Sequence[tuple[str, int]] | None = None, rounds: int = 60, rate: float = 4.0, decay: float = 1e-4) -> tuple[float, list[float]]:
    """(intercept, weight per bucket) from at most MAX_EXAMPLES labelled URLs."""
    rows = labelled_urls() if examples is None else list(examples)
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"at most {MAX_EXAMPLES} labelled URLs")
    table = spark.createDataFrame(rows or [("", 1)], "url string, label int")
    host, path = host_and_path(F.col("url"))
    data = [(r["b"], r["label"]) for r in table.select(buckets(host, path).alias("b"), "label").collect()]
    weights, intercept = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        for grams, label in data:
            share = 1 / max(1, len(grams))
            z = intercept + share * sum(weights[g] for g in grams)
            error = label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            intercept += 0.02 * rate * error
            for g in grams:
                weights[g] += rate * error * share - decay * weights[g] * share
    return intercept, weights


def score(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """The model's log-odds to allow."""
    weights = F.lit(model[1])
    grams = buckets(host, path)
    total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.element_at(weights, g + 1))
    return F.lit(model[0]) + total / F.greatest(F.size(grams), F.lit(1))


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. rules: (verdict, 'host/path')."""
    rules = sorted(rules, key=lambda r: -len(r[1]))
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in reversed(rules):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], model: tuple[float, list[float]] | None = None, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict and the model's p_allow for every row with a ``url`` column."""
    model = train(pages.sparkSession) if model is None else model
    host, path = host_and_path(F.col("url"))
    rows = clean_input(pages, key, "url").select(key, host.alias("host"), path.alias("path"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("by_rule", verdict).withColumn("p_allow", 1 / (1 + F.exp(-score(F.col("host"), F.col("path"), model))))
    return rows.select(key, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")).alias("verdict"), "p_allow")
