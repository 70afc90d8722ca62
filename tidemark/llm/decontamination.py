"""Benchmark decontamination through a distributed positional inverted index.

Postings (term, text, position) of the training texts are kept for the terms that test items are
found by: in every window the two rarest ones. Their lists are intersected after each position
is moved back by the term's offset in the item, so what is left is a text, an item and a
diagonal (text position of the item's first word). Diagonals are then checked word by word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .common import ascii_lower, small, text_key

WINDOW = 10
#: A list of terms is broadcast up to this many rows (some tens of MB), beyond it the join shuffles.
BROADCAST_TERMS = 500_000


def words(text: Column) -> Column:
    """Runs of characters outside ASCII that are not [0-9a-z], after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


@dataclass
class Index:
    """What is known of the training texts: postings of some terms, and the texts themselves."""

    postings: DataFrame  # term, k1, k2, pos
    texts: DataFrame  # k1, k2, words


def item_words(items: DataFrame) -> DataFrame:
    """item (a row number is not needed: equal ids are kept apart by their words), words, n."""
    return materialised(
        items.select(F.col("item_id"), words(F.col("text")).alias("ws"))
        .where(F.size("ws") > 0)
        .distinct()
        .select("item_id", "ws", F.xxhash64("item_id", "ws").alias("item"), F.size("ws").alias("n"))
    )


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, count) over all tokens of the training texts, for the given terms; absent ones are missing."""
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term"))
    return materialised(tokens.join(small(terms, BROADCAST_TERMS), "term", "left_semi").groupBy("term").count())


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The two rarest positions of every window that can occur: item, p1, t1, p2, t2.

    Windows that share both are one row. A window with a term of no postings is left out. A
    window of one word has the same position twice.
    """
    at = items.select("item", "n", F.posexplode("ws").alias("p", "term")).join(counts, "term", "left")
    ranked = at.groupBy("item", "n").agg(
        F.array_sort(F.collect_list(F.struct("p", F.coalesce("count", F.lit(0)).alias("count"), "term"))).alias("at")
    )
    length = F.least("n", F.lit(window))
    each = ranked.select("item", "at", length.alias("len"), F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("s"))
    rarest = F.array_sort(F.transform(F.slice("at", F.col("s") + 1, F.col("len")), lambda x: F.struct(x["count"].alias("count"), x["p"].alias("p"), x["term"].alias("term"))))
    pair = each.select("item", rarest[0].alias("a"), F.coalesce(F.get(rarest, F.lit(1)), rarest[0]).alias("b"))
    return materialised(
        pair.where("a.count > 0")
        .select("item", F.col("a.p").alias("p1"), F.col("a.term").alias("t1"), F.col("b.p").alias("p2"), F.col("b.term").alias("t2"))
        .distinct()
    )


def build_index(docs: DataFrame, terms: DataFrame) -> Index:
    """Postings of the given terms over all distinct texts. Copies of a text have one list."""
    texts = docs.where("text is not null").select(*text_key(F.col("text")), words(F.col("text")).alias("ws"))
    tokens = texts.select("k1", "k2", F.posexplode("ws").alias("pos", "term"))
    postings = tokens.join(small(terms, BROADCAST_TERMS), "term", "left_semi").distinct()
    return Index(materialised(postings), texts)


def diagonals(index: Index, anchored: DataFrame) -> DataFrame:
    """(k1, k2, item, diag) where both rarest terms of some window lie at their offsets."""
    one = index.postings.select("k1", "k2", F.col("term").alias("t1"), F.col("pos").alias("q1"))
    two = index.postings.select("k1", "k2", F.col("term").alias("t2"), F.col("pos").alias("q2"))
    found = anchored.join(one, "t1").select("k1", "k2", "item", "t2", "p2", (F.col("q1") - F.col("p1")).alias("diag"))
    found = found.select("*", (F.col("diag") + F.col("p2")).alias("q2")).distinct()
    return found.join(two, ["k1", "k2", "t2", "q2"], "left_semi").select("k1", "k2", "item", "diag").distinct()


def phrase_matches(index: Index, items: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact windows along each diagonal: k1, k2, item_id, spans (first and last text word of
    each occurring window).

    Only the stretch of the text that the item covers is carried to the check.
    """
    wanted = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "diag")).alias("d"))
    lengths = items.select("item", "n", "ws")
    per = index.texts.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    rows = (
        per.join(wanted, ["k1", "k2"])
        .select("k1", "k2", "ws", F.explode("d").alias("d"))
        .select("k1", "k2", "d.item", "d.diag", F.col("ws").alias("tw"))
        .join(small(lengths.select("item", "n"), BROADCAST_TERMS), "item")
    )
    low = F.greatest("diag", F.lit(0))
    cut = F.slice("tw", low + 1, F.least(F.col("n") + F.least("diag", F.lit(0)), F.size("tw") - low))
    rows = rows.where(F.col("diag") < F.size("tw")).select("k1", "k2", "item", "diag", (low - F.col("diag")).alias("skip"), cut.alias("tw"))
    both = rows.join(lengths, "item").join(items.select("item", "item_id"), "item")
    same = F.transform("ws", lambda w, i: F.coalesce(F.get("tw", i - F.col("skip")) == w, F.lit(False)))
    length = F.least("n", F.lit(window))
    # ends[i]: how many words in a row match up to word i, so a window ends where that reaches its length.
    runs = F.aggregate(
        "same",
        F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("ends"), F.lit(0).alias("i")),
        lambda acc, x: F.struct(
            F.when(x, acc["run"] + 1).otherwise(0).alias("run"),
            F.when(x & (acc["run"] + 1 >= F.col("len")), F.concat(acc["ends"], F.array(acc["i"]))).otherwise(acc["ends"]).alias("ends"),
            (acc["i"] + 1).alias("i"),
        ),
    )["ends"]
    checked = both.select("k1", "k2", "item_id", "diag", same.alias("same"), length.alias("len"))
    ends = checked.select("k1", "k2", "item_id", "diag", "len", runs.alias("ends")).where(F.size("ends") > 0)
    spans = F.transform("ends", lambda e: F.struct((F.col("diag") + e - F.col("len") + 1).alias("first"), (F.col("diag") + e).alias("last")))
    return ends.select("k1", "k2", "item_id", spans.alias("spans"))


def covered(spans: Column) -> Column:
    """How many positions lie in the union of sorted spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["last"]).alias("end"),
            (acc["n"] + F.greatest(x["last"] - F.greatest(acc["end"], x["first"] - 1), F.lit(0))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = 3, slop: int = 20) -> DataFrame:
    """(k1, k2, item_id, first, last): the ``terms`` rarest distinct words of an item within
    ``slop`` words of each other in a text, in any order. Items with fewer distinct words need
    all of theirs."""
    its = item_words(items)
    counts = term_counts(docs, its.select(F.explode("ws").alias("term")).distinct())
    rare = its.select("item", "item_id", F.explode(F.array_distinct("ws")).alias("term")).join(counts, "term", "left")
    rare = rare.groupBy("item", "item_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "term"))), 1, terms).alias("r")
    )
    need = rare.select("item", "item_id", F.size("r").alias("need"), F.explode("r.term").alias("term"))
    index = build_index(docs, need.select("term").distinct())
    hits = index.postings.join(need, "term").groupBy("k1", "k2", "item", "item_id", "need").agg(
        F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("at")
    )
    # A narrowest stretch starts at some posting: all terms must occur up to slop words after it.
    starts = hits.select("*", F.explode("at.pos").alias("first"))
    within = F.filter("at", lambda x: (x["pos"] >= F.col("first")) & (x["pos"] < F.col("first") + slop))
    full = starts.select("*", within.alias("w")).where(F.size(F.array_distinct("w.term")) == F.col("need"))
    return full.groupBy("k1", "k2", "item_id").agg(F.min("first").alias("first"), F.max(F.array_max("w.pos")).alias("last"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact window matches of all benchmark items: k1, k2, item_id, spans."""
    items = item_words(benchmark)
    counts = term_counts(docs, items.select(F.explode("ws").alias("term")).distinct())
    anchored = anchors(items, counts, window)
    terms = anchored.select(F.col("t1").alias("term")).union(anchored.select("t2")).distinct()
    index = build_index(docs, terms)
    return phrase_matches(index, items, materialised(diagonals(index, anchored)), window)


def per_text(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1, k2, n_hit and the sorted ids (as strings) of items with an occurring window, for
    texts that have any."""
    return (
        matches(docs, benchmark, window)
        .groupBy("k1", "k2")
        .agg(
            covered(F.array_sort(F.flatten(F.collect_list("spans")))).alias("n_hit"),
            F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"),
        )
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Only doc_id, text and item_id, text are read. A null or empty text has no words and no
    hits; an item without words is never found. A document word is hit if an occurrence of
    ``window`` consecutive words of an item (of the whole item, if shorter) covers it. Items
    of one id count once; an item with a null id marks words but has no id to list. Without
    items the digest is that of the empty string.
    """
    keyed = docs.select("doc_id", *text_key(F.coalesce("text", F.lit(""))), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return keyed.join(per_text(docs, benchmark, window), ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, without the documents that hold an exact window of an item."""
    hit = per_text(docs, benchmark, window).select("k1", "k2")
    one, two = text_key(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, (one == hit.k1) & (two == hit.k2), "left_anti")
