"""URL filter: rules first, then logistic regression on hashed character n-grams.

A rule is ``host/path``; it fits its host and all subdomains if the path of the URL starts
with the rule's path, and the longest rule that fits decides. Other URLs are judged by a
model of character n-grams of host and path, trained from a small table of labelled URLs.

NULL, or no ``://``: host and path are empty, no rule fits, and the model's intercept decides.
Repeated rows and NULL ids are judged row by row. Only the id and the URL are read. A table
without labels of both kinds cannot train a model and raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.llm.ragged import blocks

ALLOW, BLOCK = "allow", "block"
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
PRIOR = 0.1  # share of unwanted URLs expected before looking at one
MAX_LABELLED = 20_000  # rows of the labelled table that are used, the first by digest of the URL
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Labelled URLs: words of unwanted sites by category and of ordinary ones by subject, each
# word in several hosts; affixes, subdomains, domains and paths are the same on both sides and
# tell nothing. No host name, or word of one, of the given tables is among them: those stay unseen.
UNWANTED: dict[str, tuple[str, ...]] = {
    "gambling": (
        "poker", "roulette", "blackjack", "jackpot", "slots", "gambling", "betting", "sportsbook", "bookmaker", "wager",
        "lottery", "bingo", "baccarat", "craps", "keno", "scratchcard", "highroller", "freespins", "tipster", "parlay",
    ),
    "pharmacy": (
        "viagra", "cialis", "levitra", "pharmacy", "tramadol", "xanax", "valium", "ambien", "steroids", "rxmeds",
        "slimming", "weightloss", "antidepressant", "painkillers", "supplements", "testosterone", "modafinil", "generics", "nootropics", "enlargement",
    ),
    "adult": (
        "porn", "porno", "sexy", "sexcam", "webcamgirls", "escort", "hentai", "xxx", "nude", "naked",
        "erotic", "milf", "fetish", "hookup", "strip", "camgirl", "lesbian", "swinger", "playmate", "lingerie",
    ),
    "advertising": (
        "adserver", "adclick", "popunder", "banner", "doubleclick", "clickbait", "affiliate", "impression", "retarget", "adsense",
        "telemetry", "pixel", "beacon", "analytics", "sponsored", "traffic", "leadgen", "cpm", "adnetwork", "redirect",
    ),
    "fraud": (
        "payday", "loans", "fastcash", "getrich", "millionaire", "forex", "binary", "replica", "fake", "counterfeit",
        "phishing", "giveaway", "prize", "winner", "bitcoin", "doubler", "pyramid", "mlm", "inheritance", "creditfix",
    ),
    "warez": (
        "warez", "crack", "keygen", "serial", "torrent", "pirate", "nulled", "malware", "trojan", "exploit",
        "botnet", "rootkit", "hacktool", "cheats", "ddos", "stresser", "downloader", "unlocker", "activator", "bypass",
    ),
    "linkspam": (
        "backlinks", "linkbuilding", "seorank", "articlespinner", "doorway", "bulkmail", "emailblast", "followers", "likes", "clickfarm",
        "parked", "directorysubmit", "autopost", "guestpost", "scraper", "blackhat", "pagerank", "linkwheel", "massmail", "traffichub",
    ),
}
ORDINARY: dict[str, tuple[str, ...]] = {
    "press": (
        "news", "journal", "gazette", "herald", "tribune", "magazine", "weekly", "radio", "press", "chronicle",
        "zeitung", "noticias", "nachrichten", "presse", "diario", "courier", "bulletin", "reporter", "editor", "observer",
    ),
    "learning": (
        "library", "school", "university", "college", "science", "physics", "history", "museum", "archive", "biology",
        "chemistry", "institute", "academy", "research", "lexicon", "grammar", "bibliothek", "escuela", "ecole", "geology",
    ),
    "public": (
        "council", "city", "parliament", "ministry", "court", "police", "hospital", "clinic", "church", "charity",
        "weather", "railway", "airport", "harbour", "embassy", "village", "county", "gemeinde", "mairie", "senate",
    ),
    "home": (
        "kitchen", "garden", "recettes", "cocina", "rezepte", "baking", "knitting", "furniture", "family", "parents",
        "bakery", "gardening", "flowers", "cottage", "bicycle", "hiking", "camping", "fishing", "birds", "dogs",
    ),
    "culture": (
        "music", "theatre", "cinema", "poetry", "opera", "orchestra", "painting", "gallery", "books", "novel",
        "literature", "choir", "festival", "ballet", "sculpture", "drama", "author", "bookshop", "concert", "heritage",
    ),
    "technology": (
        "software", "linux", "database", "compiler", "python", "network", "hardware", "electronics", "robotics", "engineering",
        "opensource", "developer", "statistics", "astronomy", "telescope", "solar", "battery", "mathematics", "algebra", "printing",
    ),
    "business": (
        "insurance", "bank", "lawyer", "accounting", "consulting", "logistics", "builder", "plumber", "dentist", "architect",
        "brewery", "vineyard", "hotel", "restaurant", "travel", "motors", "textile", "timber", "steel", "furnace",
    ),
}
_AFFIXES = ("", "the-", "my", "-online", "-world", "247")
_HEADS, _TAILS = ("", "www.", "shop.", "forum."), (".com", ".net", ".org", ".info", ".co.uk")
_PATHS = ("/", "/index.html", "/about/us", "/2019/07/a-day-out.html", "/category/page-3", "/item.php")


def labelled_hosts(words: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(word, host): each word alone and with each affix. Subdomains and domains are dealt by
    the positions of word and affix, so that both sides get the same."""
    hosts = []
    for n, word in enumerate(w for group in words.values() for w in group):
        for i, affix in enumerate(_AFFIXES):
            name = word + affix if affix.startswith("-") or affix.isdigit() else affix + word
            hosts.append((word, _HEADS[(n + i) % len(_HEADS)] + name + _TAILS[(n + 2 * i) % len(_TAILS)]))
    return hosts


SEED_URLS: list[tuple[str, str]] = [
    (f"http://{host}{_PATHS[(n + 3 * m) % len(_PATHS)]}", verdict)
    for verdict, words in ((BLOCK, UNWANTED), (ALLOW, ORDINARY))
    for n, (_, host) in enumerate(labelled_hosts(words))
    for m in (0, 1)
]


class Rule(NamedTuple):
    verdict: str
    rule: str  # host and path, such as ``example.com/en/``


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); NULL if none does. Of equally
    long ones the one with the longer host, then block."""
    def order(r: Rule) -> tuple:
        return -len(r.rule), -len(r.rule.partition("/")[0]), r.verdict != BLOCK

    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=order, reverse=True):
        name, slash, rest = r.rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def features(texts: pa.Array) -> Iterable[np.ndarray]:
    """Distinct buckets of the character n-grams of each text."""
    for block in blocks(texts):
        starts = np.flatnonzero((block.buf & 0xC0) != 0x80)  # code points
        points = np.append(starts, len(block.buf))
        owner = np.searchsorted(block.starts, starts, side="right") - 1
        own_buckets: list[list[np.ndarray]] = [[] for _ in range(len(block))]
        for n in GRAMS:
            if len(starts) < n:
                continue
            s, e = points[: len(points) - n], points[n:]
            inside = e <= block.ends[owner[: len(s)]]
            s, e, who = s[inside], e[inside], owner[: len(s)][inside]
            bucket = (block.hashes(s, e) % np.uint64(BUCKETS)).astype(np.int64)
            cuts = np.searchsorted(who, np.arange(len(block) + 1))
            for i in range(len(block)):
                own_buckets[i].append(bucket[cuts[i] : cuts[i + 1]])
        for parts in own_buckets:
            yield np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


class UrlModel(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Chance of ``block``; features have the length 1 together."""
        raw = [self.weights[f].sum() / np.sqrt(max(1, len(f))) for f in features(texts)]
        return 1 / (1 + np.exp(-(np.array(raw, float) + self.bias)))


def fit(
    texts: Sequence[str], blocked: Sequence[bool], prior: float = PRIOR, l2: float = 3e-6, steps: int = 600, rate: float = 4.0
) -> UrlModel:
    """Logistic regression by accelerated full gradient steps; the classes weigh as the prior says. The
    intercept is that of the prior, so what resembles no label is judged by it, and what both
    classes share need not make up for it."""
    y = np.array(blocked, float)
    if not 0 < y.sum() < len(y):
        raise ValueError("labels of both kinds are needed")
    rows = list(features(pa.array(texts, pa.string())))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows]))[owner]
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    w, bias = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    ahead = w
    for step in range(steps):
        z = np.bincount(owner, value * ahead[flat], len(rows)) + bias
        slope = weight * (1 / (1 + np.exp(-z)) - y)
        last, w = w, ahead - rate * (np.bincount(flat, value * slope[owner], BUCKETS) + l2 * ahead)
        ahead = w + step / (step + 3) * (w - last)
    return UrlModel(w, bias)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "verdict", rows: int = MAX_LABELLED) -> UrlModel:
    """From a table of URLs with a verdict; at most ``rows`` distinct URLs, the least digests."""
    url = F.col(url_col).cast("string")
    text = F.concat(url_host(url), url_path(url)).alias("t")
    some = labelled.filter(url.isNotNull() & F.col(label_col).isin(ALLOW, BLOCK)).select(text, F.col(label_col).alias("v"))
    taken = some.dropDuplicates().orderBy(F.md5("t"), "t", "v").limit(rows).toArrow()
    return fit(taken["t"].to_pylist(), [v == BLOCK for v in taken["v"].to_pylist()])


def seed_table(spark) -> DataFrame:
    """The labelled URLs of this module."""
    return spark.createDataFrame(SEED_URLS, "url string, verdict string")


def filter_urls(
    df: DataFrame,
    rules: Iterable[Rule],
    labelled: DataFrame | None = None,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Per row: id, host, path, deciding rule (or NULL), verdict, and the model's score."""
    model = df.sparkSession.sparkContext.broadcast(train(seed_table(df.sparkSession) if labelled is None else labelled))

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.score(texts), pa.float64())

    url = F.col(url_col).cast("string")
    split = df.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    judged = split.select("*", scored(F.concat("host", "path")).alias("score"), longest_rule(F.col("host"), F.col("path"), rules).alias("r"))
    by_model = F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_model).alias("verdict"), "score")
