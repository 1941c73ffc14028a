"""The insight job: one scoring pass, then summary, complaints and requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.operators import insights as ins
from plaudit.rules import CATEGORY_KEYWORDS, DEFAULT_CATEGORY, DEFAULT_SENTIMENT, REQUEST_MARKERS, SentimentRules


@dataclass(frozen=True)
class Insights:
    scored: DataFrame
    summary: DataFrame
    complaints: DataFrame
    requests: DataFrame

    def close(self) -> None:
        """Release the kept rows; call it once the reports have been read."""
        self.scored.unpersist()


def generate_insights(
    reviews: DataFrame,
    lexicon: DataFrame | None = None,
    rules: SentimentRules = DEFAULT_SENTIMENT,
    groups: ins.KeywordGroups = CATEGORY_KEYWORDS,
    default: str = DEFAULT_CATEGORY,
    markers: Sequence[str] = REQUEST_MARKERS,
) -> Insights:
    """Score once; the narrow scored rows are kept for the three reports."""
    scored = ins.scored_reviews(reviews, lexicon, rules, groups, default, markers)
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    return Insights(scored, ins.insight_summary(scored), ins.complaint_breakdown(scored), ins.feature_requests(scored))


def insight_report(reviews: DataFrame, *args, **kwargs) -> DataFrame:
    """All three reports as one table of (section, place, name, n, detail)."""
    found = generate_insights(reviews, *args, **kwargs)
    return report_rows(found)


def report_rows(found: Insights) -> DataFrame:
    text = F.lit(None).cast("string")
    order = W.orderBy(F.desc("count"), ins.category_rank(F.col("category")))
    summary = found.summary.select(
        F.lit("summary").alias("section"), F.lit(1).cast("bigint").alias("place"), text.alias("name"),
        F.col("total_reviews").alias("n"),
        F.format_string("%s %.4f", "negative_review_percentage", "average_sentiment").alias("detail"),
    )
    complaints = found.complaints.select(
        F.lit("complaint"), F.row_number().over(order).cast("bigint"), "category", "count",
        F.array_join("examples", " | "),
    )
    requests = found.requests.select(F.lit("request"), "ordinal", text, "review_id", "request")
    return summary.union(complaints).union(requests)
