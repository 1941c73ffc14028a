"""Sentiment folded inside the row against the join job, and the plan of the batch job."""

from __future__ import annotations

from collections import Counter

import pytest

from plaudit.catalog import opinion
from plaudit.catalog.common import reviews
from plaudit.operators import sentiment
from plaudit.operators.model import AuthenticityModel, FeatureModel, TrainConfig, VoteModel
from plaudit.operators.logistic import Linear
from plaudit.operators.tfidf import Vocabulary
from plaudit.plans.scoring import score_batch
from plaudit.rules import DEFAULT_SENTIMENT
from plaudit.sources.readers import from_texts, small_table

import numpy as np

SF = "/root/testdata/sf0.001"
TEXTS = [
    "Not very good, but the SERVICE was great!!!", "never so bad", "kind of nice", "", " ", "It isn't great? No? really??",
    "without doubt the best", "least helpful ever", "at least it is good", "no bad thing or good", "GOOD good GOOD", "don't love it's awful",
    "the bomb", "hardly a disappointing day", "x " * 3000 + "terrible", "😀 good ’ quote's",
]


def rows_of(df):
    return Counter(tuple(r) for r in df.select("review_id", "positive", "neutral", "negative", "compound", "label").collect())


def test_same_as_join_on_english(spark):
    data = from_texts(spark, TEXTS).unionByName(small_table(spark, {"review_id": [99], "review_text": [None]}, "review_id bigint, review_text string"))
    assert rows_of(sentiment.sentiment_in_row(data)) == rows_of(sentiment.score_sentiment(data))


def test_same_as_join_on_tables(spark):
    data, words = reviews(spark, SF), opinion.lexicon(spark)
    assert rows_of(sentiment.sentiment_in_row(data, words, opinion.RULES)) == rows_of(sentiment.score_sentiment(data, words, opinion.RULES))


@pytest.mark.parametrize("values", [500, 0])
def test_other_lexicons_take_the_join(spark, values):
    words = small_table(spark, {"token": [f"w{i}" for i in range(values)], "valence": [i / 7 for i in range(values)]}, "token string, valence double")
    assert sentiment.sentiment_in_row(from_texts(spark, ["w1"]), words, DEFAULT_SENTIMENT) is None


def test_batch_job_moves_no_text(spark):
    vocabulary = Vocabulary(("good", "bad"), (1, 1), 2, True)
    model = AuthenticityModel(FeatureModel(TrainConfig(), vocabulary), VoteModel({"lr": Linear(np.zeros(9), 0.5)}))
    plan = score_batch(reviews(spark, SF), model, opinion.lexicon(spark), opinion.RULES)._jdf.queryExecution().executedPlan().toString()
    # The local session deals a one-row-group file over the cores; nothing else may move.
    assert plan.count("Exchange") == plan.count("Exchange RoundRobinPartitioning") and plan.count("Scan parquet") == 1
    assert "Join" not in plan


def test_steps_make_numbers_only(spark):
    """No step builds the structs of all hits again."""
    found = sentiment.sentiment_in_row(reviews(spark, SF), opinion.lexicon(spark), opinion.RULES)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("zip_with(") > len(sentiment._steps(opinion.RULES))
