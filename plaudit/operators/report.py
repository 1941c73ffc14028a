"""Summaries and report rows of scored reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions.rounding import rounded_ratio
from plaudit.functions.text import latin1_only, snippet
from plaudit.operators.insights import mean_compound
from plaudit.operators.sentiment import sentiment_label
from plaudit.rules import REPORT_CHARS, REPORT_ROWS


def result_summary(scored: DataFrame) -> DataFrame:
    """Totals, split, mean confidence and mean sentiment with its label, in one pass.

    ``scored`` has prediction, confidence and sentiment_compound of four
    decimals; they are summed as integers, so the means do not depend on order.
    """
    units = lambda name: F.sum(F.round(F.col(name) * 10_000).cast("bigint"))
    sums = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("prediction") == "Genuine").alias("genuine"),
        F.count_if(F.col("prediction") == "Fake").alias("fake"),
        F.coalesce(units("confidence"), F.lit(0)).alias("_conf"),
        F.coalesce(units("sentiment_compound"), F.lit(0)).alias("_comp"),
    )
    n = F.col("total")
    raw = F.when(n == 0, 0.0).otherwise(F.col("_comp") / n / 10_000)
    return sums.select(
        "total", "genuine", "fake",
        mean_compound("_conf", "total").alias("mean_confidence"),
        mean_compound("_comp", "total").alias("mean_compound"),
        sentiment_label(raw).alias("sentiment"),
    )


def confidence_bin(confidence: Column, bins: int = 20) -> Column:
    """Equal bins on [0, 1]; 1.0 belongs to the last."""
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("bigint")


def confidence_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """(prediction, bin, reviews) of the non-empty bins."""
    binned = scored.select("prediction", confidence_bin(F.col("confidence"), bins).alias("bin"))
    return binned.groupBy("prediction", "bin").agg(F.count(F.lit(1)).alias("reviews"))


def _two_decimals(name: str) -> Column:
    """A four-decimal value printed with two."""
    return F.format_string("%.2f", rounded_ratio(f"round({name} * 10000)", "10000", 2))


def signed_score(score: Column) -> Column:
    """A score printed with its sign and four decimals."""
    return F.format_string("%+.4f", score)


def report_rows(scored: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    """The first rows in id order, formatted for a printed table."""
    first = scored.orderBy("review_id").limit(rows)
    return first.select(
        "review_id",
        latin1_only(snippet(F.col("review_text"), REPORT_CHARS)).alias("review"),
        "prediction",
        F.format_string("%.0f%%", F.bround(F.col("confidence") * 100)).alias("confidence"),
        _two_decimals("genuine_probability").alias("genuine_probability"),
        _two_decimals("fake_probability").alias("fake_probability"),
    )


def preview(df: DataFrame, rows: int = 5, by: str = "review_id") -> DataFrame:
    return df.orderBy(by).limit(rows)


def summary_lines(summary: DataFrame) -> DataFrame:
    """The heading lines of the report, one row each."""
    return summary.select(
        F.explode(
            F.array(
                F.format_string("Total Reviews: %d", "total"),
                F.format_string("Genuine: %d   Fake: %d", "genuine", "fake"),
                F.format_string("Overall Sentiment: %s", "sentiment"),
            )
        ).alias("line")
    )
