"""Line deduplication by a log-template tree.

A line's way through the tree is its token count and its first tokens; tokens with a digit are
a wildcard. Lines in one leaf are generalised position by position: a token shared there by
about as many texts as the rest of the line is constant, any other is a field that varies. A line's template
is its constants and wildcards, and templates that recur across documents are dropped.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialised
from . import near_duplicates
from .common import fresh, small, text_key

WILD = "<*>"
#: The list of busy leaves is broadcast up to this many rows (8 MB), beyond it the join shuffles.
BROADCAST_LEAVES = 500_000
#: The same for the texts that may be copies.
BROADCAST_TEXTS = 500_000


def masked(line: Column) -> Column:
    """The line lower-cased, tokens with a digit as wildcards."""
    low = F.lower(line)
    return F.when(low.rlike("[0-9]"), F.regexp_replace(low, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", WILD)).otherwise(low)


def cut(line: Column) -> Column:
    """Tokens of a line, cut at white space; a cut at one character is the cheaper one."""
    parts = F.when(line.rlike(r"[\t-\r]"), F.split(line, r"\s+")).otherwise(F.split(line, " "))
    return F.array_remove(parts, "")


def lines_of(docs: DataFrame, depth: int) -> DataFrame:
    """k1, k2, filled (lines of the text that have a token), pos, n (tokens), leaf, line, exact, body (the masked line)
    for every line of every row that has a token. exact stands for the tokens with their digits, for lines that are too much of
    numbers for a template."""
    # Keys are taken once a text, before its lines part, and blank lines go by their own look: a filter on the
    # tokens would make them twice. No split is empty, so the outer form only spares a filter on its size.
    keyed = docs.where("text is not null").select(*text_key(F.col("text")), F.split("text", "\n").alias("raws"))
    keyed = keyed.select("k1", "k2", F.size(F.filter("raws", lambda x: x.rlike(r"\S"))).alias("filled"), "raws")
    each = keyed.select("k1", "k2", "filled", F.posexplode_outer("raws").alias("pos", "raw")).where(F.col("raw").rlike(r"\S"))
    toks = each.select("k1", "k2", "filled", "pos", "raw", masked(F.col("raw")).alias("body")).withColumn("toks", cut(F.col("body")))
    wild = F.col("body").contains(WILD)
    numbers = F.when(wild, F.size(F.filter("toks", lambda t: t == WILD))).otherwise(0)
    exact = F.when(wild & F.col("raw").rlike("[0-9]") & (2 * numbers > F.size("toks")), F.xxhash64(cut(F.lower("raw"))))
    path = F.xxhash64(F.size("toks"), F.slice("toks", 1, depth))
    return toks.select("k1", "k2", "filled", "pos", F.size("toks").alias("n"), path.alias("leaf"), F.xxhash64("toks").alias("line"), exact.alias("exact"), "body")


def shared(lines: DataFrame, by: list[str], min_docs: int) -> DataFrame:
    """The values of ``by`` in at least ``min_docs`` different texts (k1, k2). Whether there are two is seen from
    the extremes of the keys, in one exchange of partial results; more are counted."""
    if min_docs == 2:
        ends = [f(k).alias(f"{k}_{i}") for k in ("k1", "k2") for i, f in enumerate((F.min, F.max))]
        return lines.groupBy(*by).agg(*ends).where("k1_0 <> k1_1 or k2_0 <> k2_1").select(*by)
    return lines.select(*by, "k1", "k2").distinct().groupBy(*by).count().where(F.col("count") >= min_docs).select(*by)


def templates(lines: DataFrame, min_docs: int, constant: float, share: float) -> DataFrame:
    """(leaf, line, template) of ``lines`` (leaf, line, body, texts: distinct texts that have the line).

    The support of a token is the number of texts of the leaf with it at that position. The level
    of a line is what ``constant`` of its tokens without a digit reach: about how many texts
    have its template, whatever else the leaf holds. A token with less than ``share`` of the
    level, or than ``min_docs``, is a field. So a value that recurs in a field stays a value
    however large the corpus gets. Lines that are not constant enough have no template.
    """
    word = F.posexplode(cut(F.col("body"))).alias("p", "word")
    at = lines.select("leaf", "line", "texts", word).select("leaf", "line", "texts", "p", F.xxhash64("word").alias("tok"), (F.col("word") == WILD).alias("number"))
    support = at.where("not number").groupBy("leaf", "p", "tok").agg(F.sum("texts").alias("support")).where(F.col("support") >= min_docs)
    marked = at.join(support, ["leaf", "p", "tok"], "left")
    held = F.when(F.col("number"), F.lit(-1)).otherwise(F.coalesce("support", F.lit(1)))
    found = marked.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("p", "tok", held.alias("s")))).alias("at"))
    words = F.filter("at", lambda x: x["s"] >= 0)
    found = found.withColumn("levels", F.sort_array(F.transform(words, lambda x: x["s"]), asc=False)).where(F.size("levels") > 0)
    level = F.try_element_at("levels", F.greatest(F.lit(1), F.ceil(F.lit(constant) * F.size("levels")).cast("int")))
    floor = F.greatest(F.lit(float(min_docs)), F.lit(share) * level)

    def formed(least):
        fixed = F.transform("at", lambda x: F.when(x["s"] >= least, x["tok"]))
        return F.struct(F.size(F.array_compact(fixed)).alias("fixed"), F.xxhash64(fixed, F.transform(fixed, lambda t: t.isNull())).alias("template"))

    # As a variable of a lambda the floor is computed once a line, not once a token.
    found = found.select("leaf", "line", F.transform(F.array(floor), formed)[0].alias("f"), F.size("levels").alias("words"), F.size("at").alias("n"))
    # Tokens with a digit are fields by their form; of the others enough must be constant.
    found = found.where((F.col("f.fixed") >= F.lit(constant) * F.col("words")) & (2 * F.col("f.fixed") >= F.col("n")))
    return found.select("leaf", "line", F.col("f.template").alias("template"))


def recurring_lines(seen: DataFrame, min_docs: int, constant: float, share: float) -> DataFrame:
    """(leaf, line, template) of the lines of ``seen`` (see lines_of) whose template occurs in
    ``min_docs`` different texts or more.

    Leaves with fewer texts are cut off first, and equal lines are one row from then on, with the
    number of texts they are in; a line that a third of the corpus has is as cheap as any.
    """
    leaves = materialised(shared(seen, ["leaf"], min_docs))
    busy = seen.join(small(leaves, BROADCAST_LEAVES), "leaf", "left_semi").select("leaf", "line", "body", "k1", "k2").distinct()
    lines = materialised(busy.groupBy("leaf", "line", "body").agg(F.count("*").alias("texts")))
    formed = materialised(templates(lines, min_docs, constant, share))
    # A text counts once for a template, whichever of its lines have it.
    pairs = seen.select("leaf", "line", "k1", "k2").join(formed, ["leaf", "line"]).select("leaf", "template", "k1", "k2")
    often = shared(pairs, ["leaf", "template"], min_docs)
    out = materialised(formed.join(often, ["leaf", "template"], "left_semi").select("leaf", "line", "template"))
    discard(leaves, lines, formed)
    return out


def dropped_lines(docs: DataFrame, depth: int = 3, min_docs: int = 2, constant: float = 0.75, most: float = 0.5, share: float = 0.5) -> DataFrame:
    """k1, k2, drop (positions of dropped lines), whole (recurring lines found, none dropped), for
    texts with a recurring line.

    A template needs constants in half of its tokens and in ``constant`` of those without a digit;
    lines with fewer recur if they are equal, digits included. ``share``: see templates.

    A text with more than ``most`` of its words in recurring lines may be a copy of another. If it
    shares more than ``most`` of them with one other such text, and the two have the similarity at
    which near-duplicate removal connects, both are left whole for it, so that one copy
    survives; the others lose their recurring lines like any text. See copies.
    """
    seen = materialised(lines_of(docs, depth))
    hit = recurring_lines(seen, min_docs, constant, share)
    narrow = seen.select("k1", "k2", "filled", "pos", "n", "leaf", "line", "exact")
    marked = narrow.join(hit, ["leaf", "line"], "left")
    # Lines with an exact hash have no template, so no line is counted twice.
    equal = narrow.where("exact is not null")
    often = shared(equal, ["exact"], min_docs)
    numbers = equal.join(often, "exact", "left_semi").select("k1", "k2", "filled", "pos", "n", F.lit(0).alias("own"), F.col("exact").alias("template"))
    marked = marked.select("k1", "k2", "filled", "pos", "n", F.lit(1).alias("own"), "template").union(numbers)
    # Equal texts are one: their rows differ in nothing. Only found lines are gathered; the words of all lines are a
    # sum, as many times those of the text as it has copies, and so are its lines.
    lines = F.sort_array(F.collect_set(F.when(F.col("template").isNotNull(), F.struct("pos", "n", "template"))))
    words, filled = F.sum(F.col("own") * F.col("n")), F.sum("own")
    per = marked.groupBy("k1", "k2").agg(lines.alias("found"), words.alias("all"), filled.alias("rows"), F.max("filled").alias("filled"))
    per = per.where(F.size("found") > 0).select("k1", "k2", "found", F.expr("`all` div (`rows` div filled)").cast("int").alias("words"))
    total = F.aggregate("found", F.lit(0), lambda a, x: a + x["n"])
    per = materialised(per.withColumn("mostly", total > F.lit(most) * F.col("words")))
    of = copies(docs, per.where("mostly"), most).withColumn("copy", F.lit(True))
    whole, none = F.coalesce("copy", F.lit(False)), F.array().cast("array<int>")
    dropped = per.select("k1", "k2", F.transform("found", lambda x: x["pos"]).alias("found")).join(of, ["k1", "k2"], "left")
    out = materialised(dropped.select("k1", "k2", F.when(whole, none).otherwise(F.col("found")).alias("drop"), whole.alias("whole")))
    discard(seen, hit, per, of)
    return out


def copies(docs: DataFrame, texts: DataFrame, most: float, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(k1, k2) of those of ``texts`` (k1, k2, found, words) that are near copies of another of them.

    Every template has one owner among the texts of about one size, the one of the least key. Sizes
    are classed twice, half a class apart, so two texts of sizes within ``similarity`` share a class.
    An owner of more than ``most`` of a text's words is compared with it, shingle by shingle. A
    text meets at most one owner a classing, so work grows with the lines and not with the
    pairs of a group.
    """
    step = math.log(similarity) * -2
    size = F.log(F.greatest(F.col("words"), F.lit(1))) / step
    held = texts.select("k1", "k2", "words", F.explode(F.array(F.floor(size) * 2, F.floor(size + 0.5) * 2 + 1)).alias("class"), "found")
    held = held.select("k1", "k2", "words", "class", F.explode("found").alias("x")).select("k1", "k2", "words", "class", F.col("x.n").alias("n"), F.col("x.template").alias("t"))
    owner = held.groupBy("t", "class").agg(F.min(F.struct("k1", "k2")).alias("o"))
    owned = held.join(owner, ["t", "class"]).where("k1 <> o.k1 or k2 <> o.k2")
    shared = owned.groupBy("k1", "k2", "words", "class", "o").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(most) * F.col("words"))
    pairs = materialised(shared.select("k1", "k2", F.col("o.k1").alias("o1"), F.col("o.k2").alias("o2")).distinct())
    ends = pairs.select("k1", "k2").union(pairs.select("o1", "o2")).distinct()

    def run(batches):
        for b in batches:
            sets = [near_duplicates.shingle_set(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(sets, pa.list_(pa.int64()))], names=["k1", "k2", "h"])

    keyed = docs.where("text is not null").select(*text_key(F.col("text")), F.col("text").cast("string").alias("text"))
    asked = keyed.join(small(materialised(ends), BROADCAST_TEXTS), ["k1", "k2"], "left_semi")
    sets = materialised(asked.mapInArrow(run, "k1 long, k2 long, h array<long>").dropDuplicates(["k1", "k2"]))
    both = pairs.join(sets, ["k1", "k2"]).join(sets.toDF("o1", "o2", "g"), ["o1", "o2"])
    common = F.size(F.array_intersect("h", "g"))
    alike = both.where(common >= F.lit(similarity) * (F.size("h") + F.size("g") - common) - 1e-9)
    out = materialised(alike.select(F.explode(F.array(F.struct("k1", "k2"), F.struct(F.col("o1").alias("k1"), F.col("o2").alias("k2")))).alias("x")).select("x.*").distinct())
    discard(pairs, sets)
    return out


def _joined(docs: DataFrame, names: list[str], **how) -> DataFrame:
    a, b, drop, whole = names
    one, two = text_key(F.col("text"))
    found = dropped_lines(docs, **how).toDF(a, b, drop, whole)
    return docs.join(found, (one == F.col(a)) & (two == F.col(b)), "left")


def _kept(drop: str) -> Column:
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(drop), i))
    return F.when(F.size(drop) > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))


def deduplicate_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs``, all columns, with the dropped lines cut out of ``text`` (and ``n_chars``, if there
    is such a column, counted again). Documents of which nothing but white space is left are
    removed; those that had none before stay, null texts too. ``how``: see dropped_lines."""
    names = fresh(docs, "k1_", "k2_", "drop_", "whole_")
    drop = names[2]
    out = _joined(docs, names, **how).withColumn(names[3], F.size(drop) > 0).withColumn("text", _kept(drop))
    out = out.where(~F.coalesce(names[3], F.lit(False)) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(names[3]), length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, left_whole (a copy: recurring lines found, none dropped), text (cleaned).

    Reads doc_id and text. Line ends are \\n. Blank lines are kept and not counted in n_lines; a
    null text has no lines and stays null; equal texts have equal results; repeated rows are
    returned each; an empty table gives an empty result. ``how``: see dropped_lines."""
    rows = docs.select("doc_id", "text")
    names = fresh(rows, "k1", "k2", "drop", "whole")
    drop, whole = names[2], names[3]
    blank = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    return _joined(rows, names, **how).select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(blank)).alias("n_lines"),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).alias("n_dropped"),
        F.coalesce(F.col(whole), F.lit(False)).alias("left_whole"),
        _kept(drop).alias("text"),
    )
