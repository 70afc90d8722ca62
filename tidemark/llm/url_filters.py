"""URL verdicts: host rules first, then naive Bayes over words that host names are cut into."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log10

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import ascii_lower, fresh

#: Words that mark a url as unwanted when no one has labelled any (fixed list).
BLOCK_WORDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "malware", "phishing",
    "pills", "poker", "porn", "slots", "spam", "viagra", "xxx",
)
LONGEST = 24  # letters of a word that segmentation looks for


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(*lines: str) -> list[Rule]:
    """Rules from lines such as 'block example.net/en/'."""
    out = []
    for line in lines:
        verdict, where = line.split(" ", 1)
        host, slash, path = where.partition("/")
        out.append(Rule(verdict, host, slash + path))
    return out


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path; both empty if there is no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, given: Sequence[Rule]) -> Column:
    """The longest rule (ties: the first in text order) that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(given, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, count) of all letter runs in the visible text of all pages, plus the marked words
    with one ten-thousandth of all occurrences each, so that names made of them are cut."""
    text = ascii_lower(F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " "))
    found = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1)).alias("word")).groupBy("word").count()
    counts = materialised(found)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    seeds = counts.sparkSession.createDataFrame([(w, total // 10_000 + 1) for w in BLOCK_WORDS], "word string, count long")
    return counts.unionByName(seeds).groupBy("word").agg(F.sum("count").alias("count"))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable cut of ``name`` into words under a unigram model; an unseen word of n
    letters has probability 10 / (total * 10**n). Of equal cuts the one whose last word is longest wins."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            seen = counts.get(word)
            p = log10(seen / total) if seen else 1 - log10(total) - len(word)
            options.append((best[start][0] + p, -start))
        p, start = max(options)
        best.append((p, -start))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct names of letters.

    Only the counts of a name's own substrings are brought to it, so that the word list is never
    held whole anywhere; that is at most LONGEST of them per letter."""
    total = max(counts.agg(F.sum("count")).first()[0] or 0, 1)
    start = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("s"))
    size = F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("s") + 1))
    parts = start.select("name", "s", F.explode(size).alias("n")).select("name", F.col("name").substr(F.col("s"), F.col("n")).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list("word").alias("ws"), F.collect_list("count").alias("cs"))

    @F.pandas_udf("array<string>")
    def cut(name: pd.Series, ws: pd.Series, cs: pd.Series) -> pd.Series:
        none: list = []
        return pd.Series([viterbi(n, dict(zip(none if w is None else w, none if c is None else c, strict=True)), total) for n, w, c in zip(name, ws, cs, strict=True)])

    return names.join(known, "name", "left").select("name", cut("name", "ws", "cs").alias("words"))


def judge(pages: DataFrame, given: Sequence[Rule], marked: Sequence[str] = BLOCK_WORDS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, log_odds.

    Reads page_id, url and html. Without a fitting rule a page is blocked if its host's words and
    path tokens are likelier under the blocked class: multinomial naive Bayes with add-one
    smoothing, learned from all pages, where a url with a marked word stands for the blocked
    class and any other for the allowed one. Numbers count as one token. Urls that are null or
    lack :// have empty host and path and are scored by the prior; an empty table gives an empty
    result. Work is done per distinct host and path shape, however many pages share one.
    """
    host, path = parsed(F.col("url"))
    rows = materialised(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("shape", F.regexp_replace("path", r"\p{N}+", "0")))
    shapes = materialised(rows.groupBy("host", "shape").count())
    names = shapes.select(F.explode(F.regexp_extract_all("host", F.lit(r"(\p{L}+)"), 1)).alias("name")).distinct()
    cut = segmented(names, word_counts(pages))
    at = shapes.select("host").distinct().select("host", F.explode(F.regexp_extract_all("host", F.lit(r"(\p{L}+|\p{N}+)"), 1)).alias("name"))
    from_host = at.join(cut, "name", "left").groupBy("host").agg(F.flatten(F.collect_list(F.coalesce("words", F.array(F.lit("0"))))).alias("hw"))
    from_path = F.regexp_extract_all(ascii_lower(F.col("shape")), F.lit(r"(\p{L}+|\p{N}+)"), 1)
    whole = shapes.join(from_host, "host", "left").select(
        "host", "shape", "count", F.concat(F.coalesce("hw", F.array().cast("array<string>")), from_path).alias("tokens")
    )
    whole = materialised(whole.withColumn("bad", F.arrays_overlap("tokens", F.array(*map(F.lit, marked)))))
    bad, good = F.when(F.col("bad"), F.col("count")).otherwise(0), F.when(F.col("bad"), 0).otherwise(F.col("count"))
    tokens = materialised(
        whole.select("bad", "count", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum(bad).alias("b"), F.sum(good).alias("g"))
    )
    zero = F.lit(0)
    nb, ng, v = tokens.agg(F.coalesce(F.sum("b"), zero), F.coalesce(F.sum("g"), zero), F.count("*")).first()
    pb, pg = whole.agg(F.coalesce(F.sum(bad), zero), F.coalesce(F.sum(good), zero)).first()
    prior = log10((pb + 1) / (pg + 1))
    weight = F.log10((F.col("b") + 1) / (nb + v + 1)) - F.log10((F.col("g") + 1) / (ng + v + 1))
    scores = (
        whole.select("host", "shape", F.explode("tokens").alias("token"))
        .join(tokens.select("token", weight.alias("w")), "token")
        .groupBy("host", "shape")
        .agg(F.sum("w").alias("w"))
    )
    odds = F.coalesce("w", F.lit(0.0)) + prior
    rule = matching_rule(F.col("host"), F.col("path"), given)
    by_method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return (
        rows.join(scores, ["host", "shape"], "left")
        .select("page_id", "host", "path", rule.alias("r"), odds.alias("log_odds"))
        .select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_method).alias("verdict"), "log_odds")
    )


def allowed(pages: DataFrame, given: Sequence[Rule]) -> DataFrame:
    """``pages``, all columns, whose verdict is allow; repeated page ids need all their rows allowed."""
    (flag,) = fresh(pages, "blocked_page")
    bad = judge(pages, given).where("verdict = 'block'").select(F.col("page_id").alias(flag)).distinct()
    return pages.join(bad, pages["page_id"] == bad[flag], "left_anti")
