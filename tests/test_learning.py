from __future__ import annotations

import hashlib
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plaudit.operators import themes as th
from plaudit.operators.metrics import binary_metrics, class_report
from plaudit.operators.model import AuthenticityModel, TrainConfig, score_text
from plaudit.operators.neighbours import exact_neighbours
from plaudit.operators.oversample import balance_classes, synthetic_rows
from plaudit.operators.scoring import prediction_columns
from plaudit.operators.splits import largest_remainder, plain_split, stratified_folds, stratified_split
from plaudit.plans.scoring import BATCH_COLUMNS, analyse_feedback, feedback_rows, score_batch
from plaudit.plans.training import train
from plaudit.sources.readers import SourceError, from_texts, small_table
from plaudit.sources.writers import append_run_log

TINY = TrainConfig(max_features=60, lr_iterations=10, trees=3, tree_depth=3, rounds=2, round_depth=2, folds=2)


def corpus(spark, genuine=70, fake=20):
    good = [f"The kettle number {i} boils water in {i % 7} minutes and feels sturdy" for i in range(genuine)]
    bad = [f"BUY NOW!!! best deal {i} ever!!! limited offer" for i in range(fake)]
    return small_table(
        spark,
        {"review_id": range(genuine + fake), "review_text": good + bad, "label": ["genuine"] * genuine + ["fake"] * fake},
        "review_id bigint, review_text string, label string",
    )


@pytest.fixture(scope="module")
def trained(spark):
    return train(corpus(spark), TINY, "t1")


def order(ids):
    return sorted(ids, key=lambda i: hashlib.md5(f"42{i}".encode()).hexdigest())


def test_splits_are_exact(spark):
    df = spark.range(1003).selectExpr("id AS review_id", "IF(id % 10 < 3, 0, 1) AS label")
    rows = stratified_split(df).collect()
    labels = {v: [r["review_id"] for r in rows if r["label"] == v] for v in (0, 1)}
    train_rows = largest_remainder({v: len(x) for v, x in labels.items()}, 1003 - math.ceil(1003 * 0.2))
    for v in (0, 1):
        test = {r["review_id"] for r in rows if r["label"] == v and r["is_test"]}
        assert test == set(order(labels[v])[: len(labels[v]) - train_rows[v]])
    plain = {r["review_id"] for r in plain_split(df).collect() if r["is_test"]}
    assert plain == set(order(range(1003))[: math.ceil(1003 * 0.2)])


def test_folds_cover_each_label_evenly(spark):
    df = spark.range(503).selectExpr("id AS review_id", "IF(id % 50 = 0, 0, IF(id = 7, 2, 1)) AS label")
    rows = stratified_folds(df).collect()
    for label in (0, 1, 2):
        sizes = [sum(r["label"] == label and r["fold"] == f for r in rows) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    whole = [sum(r["fold"] == f for r in rows) for f in range(5)]
    assert max(whole) - min(whole) <= 1
    again = {r["review_id"]: r["fold"] for r in stratified_folds(df.repartition(5)).collect()}
    assert again == {r["review_id"]: r["fold"] for r in rows}


def points(spark, matrix):
    df = small_table(
        spark, {"pid": range(len(matrix)), "values": [list(map(float, r)) for r in matrix]}, "pid bigint, values array<double>"
    )
    return df.select("pid", "values", F.sequence(F.lit(0), F.size("values") - 1).alias("indices"), F.col("values")[0].alias("proj"))


@pytest.mark.parametrize("block_rows", [7, 40, 1000])
def test_neighbours_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(120, 4)) * [3, 1, 1, 1], 2)
    x[30:70, 0] = 1.0  # a third of the points share one projection
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = exact_neighbours(points(spark, x), 3, block_rows).orderBy("pid", "rank").collect()
    assert len(got) == 360
    for i in range(120):
        best = sorted((round(float(d[i, j]), 12), j) for j in range(120) if j != i)[:3]
        mine = [(round(r["distance"], 12), r["nid"]) for r in got if r["pid"] == i]
        assert mine == best


def test_synthetic_rows_with_a_third_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    x[:14] = x[0]
    rows = points(spark, x).select(F.col("pid").cast("string").alias("row_key"), array_to_vector("values").alias("features"))
    made = synthetic_rows(rows, 1003)
    from pyspark.ml.functions import vector_to_array

    out = made.select("row_key", vector_to_array("features").alias("v")).collect()
    assert len(out) == 1003 == len({r["row_key"] for r in out})
    base = np.unique(x, axis=0)
    for row in out[::40]:
        v = np.array(row["v"])
        # On a segment between two distinct minority points: |a-v| + |v-b| = |a-b|.
        gaps = [abs(np.linalg.norm(a - v) + np.linalg.norm(v - b) - np.linalg.norm(a - b)) for a in base for b in base]
        assert min(gaps) < 1e-9
    again = {r["row_key"]: tuple(r["v"]) for r in synthetic_rows(rows.repartition(3), 1003).select(
        "row_key", vector_to_array("features").alias("v")).collect()}
    assert again == {r["row_key"]: tuple(r["v"]) for r in out}


def test_balance_reaches_parity(spark):
    rng = np.random.default_rng(1)
    rows = points(spark, rng.normal(size=(50, 3))).select(
        F.col("pid").cast("string").alias("row_key"), F.expr("IF(pid < 9, 0, 1)").alias("label"),
        array_to_vector("values").alias("features"),
    )
    counts = {r["label"]: r["count"] for r in balance_classes(rows).groupBy("label").count().collect()}
    assert counts == {0: 41, 1: 41}


def test_training(spark, trained, tmp_path):
    values = trained.metrics.first().asDict()
    assert values["accuracy"] == 1.0
    run = {r["key"]: r["value"] for r in trained.run.collect()}
    assert run["smote_applied"] == "True" and run["tfidf_max_features"] == "60" and "cv_f1_std" in run
    assert trained.cv.count() == 2
    append_run_log(trained.run, str(tmp_path / "log"))
    append_run_log(trained.run, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2 * trained.run.count()


def test_fit_scope_all(spark):
    done = train(corpus(spark, 30, 8), replace(TINY, fit_scope="all", members=("lr",), folds=0), "all")
    assert {r["key"]: r["value"] for r in done.run.collect()}["n_samples"] == "60"


def test_save_load_score(spark, trained, tmp_path):
    path = str(tmp_path / "model")
    trained.model.save(spark, path)
    loaded = AuthenticityModel.load(spark, path)
    data = corpus(spark, 5, 5).drop("label")
    assert sorted(map(str, loaded.score(data).collect())) == sorted(map(str, trained.model.score(data).collect()))
    with pytest.raises(SourceError, match="MODEL_NOT_FOUND"):
        AuthenticityModel.load(spark, str(tmp_path / "missing"))
    one = score_text(loaded, spark, "BUY NOW!!! best deal ever!!!").first()
    assert one["prediction"] == "Fake" and one["behavioral_signals"]["exclamation_count"] == 6.0
    with pytest.raises(SourceError, match="EMPTY_TEXT"):
        score_text(loaded, spark, "  ")
    assert loaded.score(data.filter("false")).count() == 0


def test_batch_and_feedback(spark, trained):
    data = corpus(spark, 12, 4).drop("label")
    batch = score_batch(data, trained.model)
    assert batch.columns == ["review_id", *BATCH_COLUMNS] and batch.count() == 16
    done = analyse_feedback(data, trained.model)
    assert tuple(done.totals.first()) == (16, 12, 4) and done.status == "ok"
    assert sum(r["size"] for r in done.themes.collect()) == 12
    assert feedback_rows(done).filter("section = 'totals'").count() == 3


def test_feedback_without_genuine_reviews(spark, trained):
    fakes = corpus(spark, 0, 5).drop("label")
    done = analyse_feedback(fakes, trained.model)
    assert done.status == "All reviews classified as Fake."
    assert tuple(done.totals.first()) == (5, 0, 5)
    assert done.themes.count() == 0 and done.insights.summary.first()["total_reviews"] == 0


def test_themes(spark):
    texts = ["battery life short"] * 5 + ["screen flickers dim"] * 4 + ["delivery box late"] * 3
    rows = th.find_themes(from_texts(spark, texts), replace(th.ThemeConfig(), clusters=3)).collect()
    assert sum(r["size"] for r in rows) == 12
    assert [r["size"] for r in rows] == sorted((r["size"] for r in rows), reverse=True)
    assert all(1 <= len(r["representative_examples"]) <= 3 and len(r["key_terms"]) <= 8 for r in rows)
    one = th.find_themes(from_texts(spark, ["only one"])).first()
    assert (one["cluster_id"], one["key_terms"], one["size"]) == (1, [], 1)
    assert th.find_themes(from_texts(spark, ["x"]).filter("false")).count() == 0
    assert th.find_themes(from_texts(spark, ["the of", "and to"])).first()["key_terms"] == []
    assert th.topic_lines(from_texts(spark, ["a b"])).first()["topic"] == th.NO_CLUSTERS
    lines = th.topic_lines(from_texts(spark, texts)).collect()
    assert [r["topic"].split(":")[0] for r in lines] == ["Cluster 1", "Cluster 2", "Cluster 3"]


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert tuple(binary_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)
    assert class_report(df).count() == 5


def test_scores_without_probability(spark):
    df = spark.createDataFrame([(1,), (0,)], "c int")
    rows = prediction_columns(df, F.col("c")).orderBy("c").collect()
    assert [(r["prediction"], r["confidence"], r["fake_probability"]) for r in rows] == [("Fake", 1.0, 1.0), ("Genuine", 1.0, 0.0)]
