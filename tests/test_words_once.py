"""Words taken before serve vocabulary and vectors; a join by review shuffles vectors, not terms."""

from pyspark.sql import functions as F

from plaudit.operators import tfidf
from plaudit.operators import themes as th
from plaudit.operators.model import WORDS, TrainConfig, feature_tokens, fit_features

TEXTS = ["Good battery, good screen", "The battery died", None, "", "screens crack; good battery good", "good " * 9]
CONFIG = TrainConfig(max_features=6)


def _reviews(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "review_id bigint, review_text string")


def test_words_taken_before_give_the_same_features(spark):
    plain = _reviews(spark)
    once = plain.withColumn(WORDS, feature_tokens(CONFIG)).cache()
    models = [fit_features(df, CONFIG) for df in (plain, once)]
    assert models[0].vocabulary == models[1].vocabulary
    tables = [m.transform(df) for m, df in zip(models, (plain, once))]
    assert tables[1].columns == tables[0].columns
    found = [{r["review_id"]: r["features"] for r in t.select("review_id", "features").collect()} for t in tables]
    assert found[0] == found[1]
    # The words are not made from the text again.
    assert "http" not in models[1].transform(once).select("features")._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_centroids_shuffle_vectors_and_sort_nothing(spark):
    reviews = _reviews(spark)
    tokens = feature_tokens(CONFIG)
    vocabulary = tfidf.fit_vocabulary(reviews, tokens, 2, 6)
    members = spark.createDataFrame([(i, f"c{i % 2}") for i in range(6)] + [(0, "c1")], "review_id bigint, cluster string")
    rows = {dealt: tfidf.tfidf_rows(reviews, tokens, 2, vocabulary, dealt=dealt) for dealt in (False, True)}
    found = {
        dealt: {(r["cluster"], r["term"]): round(r["weight"], 9) for r in th.centroid_terms(part, members).collect()}
        for dealt, part in rows.items()
    }
    assert found[True] == found[False] and found[True]
    weights = {(r["review_id"], r["term"]): r["weight"] for r in rows[True].collect()}
    groups = [(i, f"c{i % 2}") for i in range(6)] + [(0, "c1")]
    for (cluster, term), weight in found[True].items():
        own = [i for i, c in groups if c == cluster]
        assert abs(weight - sum(weights.get((i, term), 0) for i in own) / len(own)) < 1e-8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = th.centroid_terms(rows[True], members)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin [review_id" in plan and "SortMergeJoin [review_id" not in plan
    assert plan.index("Generate") < plan.index("REPARTITION_BY_COL")  # terms are made above the exchange
    assert "Exchange" not in plan[plan.index("ShuffledHashJoin") : plan.index("Generate")]
