"""Complaint categories, feature requests and the insight summary."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.functions.rounding import rounded_ratio
from plaudit.functions.text import snippet
from plaudit.operators.sentiment import is_negative, score_sentiment, sentiment_label
from plaudit.rules import (
    CATEGORY_KEYWORDS,
    COMPLAINT_CATEGORIES,
    DEFAULT_CATEGORY,
    DEFAULT_SENTIMENT,
    REQUEST_MARKERS,
    SNIPPET_CHARS,
    SentimentRules,
)

KeywordGroups = Sequence[tuple[str, Sequence[str]]]


def _has_any(text: Column, words: Sequence[str]) -> Column:
    """False for an empty list, and null for a null text."""
    if not words:
        return F.when(text.isNotNull(), False)
    return F.regexp_like(text, F.lit("|".join(re.escape(w) for w in words)))


def complaint_category(
    text: Column, groups: KeywordGroups = CATEGORY_KEYWORDS, default: str = DEFAULT_CATEGORY
) -> Column:
    """Category of the first keyword group with a substring hit."""
    lower = F.lower(text)
    category = F.when(F.lit(False), default)
    for name, words in groups:
        category = category.when(_has_any(lower, words), name)
    return category.otherwise(default)


def is_feature_request(text: Column, markers: Sequence[str] = REQUEST_MARKERS) -> Column:
    return _has_any(F.lower(text), markers)


def category_rank(category: Column, order: Sequence[str] = COMPLAINT_CATEGORIES) -> Column:
    """Position in the category list, for breaking ties."""
    return F.array_position(F.array(*[F.lit(c) for c in order]), category).cast("int")


def scored_reviews(
    reviews: DataFrame,
    lexicon: DataFrame | None = None,
    rules: SentimentRules = DEFAULT_SENTIMENT,
    groups: KeywordGroups = CATEGORY_KEYWORDS,
    default: str = DEFAULT_CATEGORY,
    markers: Sequence[str] = REQUEST_MARKERS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One narrow row per review: sentiment, category, request flag and snippet.

    Category, flag and snippet are taken before the sentiment aggregate, so the
    full text never enters a shuffle.
    """
    text = F.col("review_text")
    tagged = reviews.select(
        "review_id", "review_text", *keep,
        snippet(text, SNIPPET_CHARS).alias("snippet"),
        complaint_category(text, groups, default).alias("category"),
        is_feature_request(text, markers).alias("is_request"),
    )
    return score_sentiment(tagged, lexicon, rules, keep=[*keep, "snippet", "category", "is_request"])


def insight_summary(scored: DataFrame) -> DataFrame:
    """Total, share of negative reviews as text, mean compound; zeros on no rows."""
    ten_thousandths = F.round(F.col("compound") * 10_000).cast("bigint")
    sums = scored.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(is_negative(F.col("compound"))).alias("_neg"),
        F.coalesce(F.sum(ten_thousandths), F.lit(0)).alias("_sum"),
    )
    n = F.col("total_reviews")
    share = F.when(n == 0, 0.0).otherwise(rounded_ratio("cast(_neg AS DECIMAL(20, 0)) * 100", "total_reviews", 1, wide=True))
    return sums.select(
        "total_reviews",
        F.format_string("%.1f%%", share).alias("negative_review_percentage"),
        mean_compound("_sum", "total_reviews").alias("average_sentiment"),
    )


def mean_compound(total: str, n: str) -> Column:
    """Mean of 4-decimal scores, summed in 1e-4 units, rounded to 4 decimals."""
    size = rounded_ratio(f"abs({total})", f"cast(greatest({n}, 1) AS DECIMAL(20, 0)) * 10000", 4, wide=True)
    return F.when(F.col(n) == 0, 0.0).when(F.col(total) < 0, -size).otherwise(size)


def complaint_breakdown(scored: DataFrame, order: Sequence[str] = COMPLAINT_CATEGORIES, examples: int = 2) -> DataFrame:
    """Count and first examples per category of negative reviews, most frequent first.

    Counting and the example window both reduce inside each task, so one
    category holding most reviews costs no more than a small one.
    """
    negative = scored.filter(is_negative(F.col("compound")))
    counts = negative.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    first = W.partitionBy("category").orderBy("review_id")
    picked = (
        negative.select("category", "review_id", "snippet")
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= examples)
        .groupBy("category")
        .agg(F.sort_array(F.collect_list(F.struct("_r", "snippet"))).alias("_x"))
        .select("category", F.transform("_x", lambda x: x["snippet"]).alias("examples"))
    )
    return (
        counts.join(picked, "category")
        .withColumn("_rank", category_rank(F.col("category"), order))
        .orderBy(F.desc("count"), "_rank", "category")
        .select("category", "count", "examples")
    )


def feature_requests(scored: DataFrame, limit: int = 10) -> DataFrame:
    """The first requests in input order, numbered from 1."""
    first = scored.filter("is_request").select("review_id", "snippet").orderBy("review_id").limit(limit)
    number = F.row_number().over(W.orderBy("review_id")).cast("bigint")
    return first.select(number.alias("ordinal"), "review_id", F.col("snippet").alias("request"))


def sentiment_distribution(scored: DataFrame) -> DataFrame:
    """Counts of the three labels, zeros included."""
    label = sentiment_label(F.col("compound"))
    row = scored.agg(
        *[F.count_if(label == name).alias(name) for name in ("Positive", "Neutral", "Negative")]
    )
    return row.unpivot([], ["Positive", "Neutral", "Negative"], "label", "reviews")


def sentiment_overview(scored: DataFrame) -> DataFrame:
    """Mean compound with 4 decimals; the label comes from the unrounded mean."""
    sums = scored.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.coalesce(F.sum(F.round(F.col("compound") * 10_000).cast("bigint")), F.lit(0)).alias("_sum"),
    )
    n = F.col("reviews")
    raw = F.when(n == 0, 0.0).otherwise(F.col("_sum") / n / 10_000)
    return sums.select(
        "reviews", mean_compound("_sum", "reviews").alias("average_compound"), sentiment_label(raw).alias("overall_label")
    )
