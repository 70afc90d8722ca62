"""The corpus operators over their whole tables, as the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import collocations, decontamination, embeddings, language_model, line_dedup, near_duplicates, packing, pieces, quality, runs, sharding, token_counts, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *byte_bpe())


def byte_bpe() -> tuple[str, str, dict[str, int]]:
    """The vocabulary of byte_bpe_50k.json as ranks, its pattern and its special string."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", near_duplicates.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = url_filters.rules("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")
    return url_filters.judge(table(spark, sf_dir, "pages"), given)


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op10_decontamination"] = r"""
with dw as (select row_number() over () as row_id, doc_id, [x for x in regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from documents),
     iw as (select item_id, [x for x in regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from benchmark),
     win as (select distinct item_id, least(len(w), 10) as n,
                    array_to_string(w[s : s + least(len(w), 10) - 1], ' ') as phrase
             from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from iw where len(w) > 0)),
     pos as (select row_id, n, s, array_to_string(w[s : s + n - 1], ' ') as phrase
             from (select row_id, w, n, unnest(range(1, len(w) - n + 2)) as s
                   from dw, (select distinct n from win) where len(w) >= n)),
     hit as (select row_id, s, n, item_id from pos join win using (n, phrase)),
     covered as (select row_id, count(distinct p) as n_hit
                 from (select row_id, unnest(range(s, s + n)) as p from hit) group by row_id),
     items as (select row_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
               from (select distinct row_id, cast(item_id as varchar) as id from hit) group by row_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (row_id) left join items using (row_id)
"""


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    done = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model).select("doc_id", "ids"), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).withColumnRenamed("group", "lang")


SQL["op12_collocations"] = r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[.,;:!?\x0A-\x0D]')) as t from documents),
     w as (select lang, [x for x in regexp_extract_all(t, '[^\x20\x09]+') if x <> ''] as w from piece),
     total as (select lang, sum(len(w))::hugeint as n from w group by lang),
     f as (select lang, phrase, m, count(*)::hugeint as f
           from (select lang, m, array_to_string(w[s : s + m - 1], ' ') as phrase
                 from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as s from w, range(1, 6) as sizes(m) where len(w) >= m))
           group by lang, phrase, m having count(*) >= 100),
     cand as (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from f where m > 1),
     inner_ as (select lang, array_to_string(w[s : s + m2 - 1], ' ') as phrase, max(a) as longer
                from (select lang, w, a, m2, unnest(range(1, m - m2 + 2)) as s from cand, range(2, 5) as sizes(m2) where m2 < m)
                group by all),
     free as (select c.* from cand c left join inner_ i using (lang, phrase) where i.longer is null or 100 * i.longer < 100 * c.a),
     cut as (select lang, phrase, m, a, k, array_to_string(w[1 : k], ' ') as head, array_to_string(w[k + 1 : m], ' ') as rest
             from (select *, unnest(range(1, m)) as k from free)),
     scored as (select c.lang, c.phrase, a, k, l.f as l, r.f as r, n, (1000 * a * n) // (l.f * r.f) as score
                from cut c join f l on l.lang = c.lang and l.phrase = c.head join f r on r.lang = c.lang and r.phrase = c.rest
                join total on total.lang = c.lang),
     best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase,
       a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from best qualify rank <= 2000
"""


def partly_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which by the checksum of the id a tenth of the texts repeat a stretch of their words up to the end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.when(n > 0, F.concat(F.slice(words, F.lit(1), a), tail)).otherwise(words), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    bound = F.element_at(F.transform(F.array(words), repeated), 1)  # the words are taken once
    return docs.select("doc_id", F.when(h % 10 == 0, bound).otherwise(F.col("text")).alias("text"))


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(partly_periodic(table(spark, sf_dir, "documents")))
    larger = lambda best, r: best.isNull() | (r["length"].cast("long") * best["period"] > best["length"].cast("long") * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:int,length:int,period:int>"), lambda b, r: F.when(larger(b, r), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").cast("long").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length").cast("long") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)
