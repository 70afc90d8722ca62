"""Keyword classification of news and announcements, as column expressions over whole texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import c, one_if, tiers
from ..functions.words import NEWS_TIERS, RISK_LABELS


def any_keyword(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words))


def classify_text(text, levels: Sequence[tuple[str, Sequence[str]]] = NEWS_TIERS) -> Column:
    """First tier with a keyword in the text, else neutral."""
    return tiers([(any_keyword(c(text), words), label) for label, words in levels], "neutral")


def classify_title(title, labels: Sequence[tuple[str, str]] = RISK_LABELS) -> Column:
    """Label of the first listed keyword found in the title; NULL without any."""
    return tiers([(c(title).contains(word), label) for word, label in labels], None)


def news_summary(news: DataFrame, by: Sequence[str], top: int = 3) -> DataFrame:
    """Counts and shares per class, mood level, and the leading negative and positive titles.

    ``news``: (by..., id, title, mood). Top titles are kept by a bounded ranking.
    """
    by = list(by)
    neg, pos = F.col("mood").isin("negative", "panic"), F.col("mood").isin("positive", "excited")
    agg = news.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_news"),
        F.sum(one_if(neg)).alias("negative_count"), F.sum(one_if(F.col("mood") == "panic")).alias("panic_count"),
        F.sum(one_if(pos)).alias("positive_count"), F.sum(one_if(F.col("mood") == "excited")).alias("excited_count"),
    )
    agg = agg.withColumns({
        "negative_pct": F.col("negative_count") / F.col("total_news") * 100,
        "positive_pct": F.col("positive_count") / F.col("total_news") * 100,
    })
    level = tiers(
        [
            (F.col("panic_count") > 2, "panic"), (F.col("excited_count") > 3, "excited"),
            (F.col("negative_pct") > 30, "negative"), (F.col("positive_pct") > 30, "positive"),
            (F.col("negative_pct") > 15, "mild_negative"), (F.col("positive_pct") > 15, "mild_positive"),
        ],
        "calm",
    )
    rk = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    heads = news.where(neg).withColumn("_k", rk).where(F.col("_k") <= top)
    heads = heads.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "title"))), lambda s: s["title"]), " | ").alias("top_negative"))
    return agg.withColumn("level", level).join(heads, by, "left")


def confidence_overlay(warning: Column, news: Column) -> dict[str, Column]:
    """Adjustment and advice from the warning level crossed with the news level."""
    weak, panic = warning.isin("warning", "danger"), news == "panic"
    overlay = tiers([(panic & (weak | (warning == "caution")), "elevated"), ((news == "negative") & weak, "elevated")], "normal")
    advice = tiers(
        [
            (panic & weak, "reduce_strictly"), (panic & (warning == "caution"), "tighten_position"), (panic, "watch_panic"),
            ((news == "negative") & weak, "reduce"), (news == "negative", "watch"),
            ((news == "excited") & weak, "mood_gap"), (news == "excited", "overheated"),
        ],
        None,
    )
    return {"overlay": overlay, "suggestion": advice}


def event_warnings(events: DataFrame, today: Column, max_days: int = 90, keep: int = 3) -> DataFrame:
    """Newest classified announcements per code within the window; those of the last week are marked."""
    d = events.where(F.col("event_type").isNotNull() & (F.col("event_date") >= F.date_sub(today, max_days)) & (F.col("event_date") <= today))
    d = d.withColumn("days_ago", F.datediff(today, F.col("event_date")))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("event_date"), F.desc("event_id"))))
    counts = d.groupBy("code").agg(F.count(F.lit(1)).alias("n_events"), F.max("event_date").alias("last_event"))
    tag = F.when(F.col("days_ago") <= 7, F.concat("event_type", F.lit(" recent"))).otherwise(F.col("event_type"))
    text = d.where(F.col("_k") <= keep).groupBy("code").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", tag.alias("t")))), lambda s: s["t"]), " | ").alias("warnings")
    )
    return counts.join(text, "code")
