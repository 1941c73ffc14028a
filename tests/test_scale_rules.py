"""Answers that must not depend on sizes, and sums of very many rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plaudit.functions.rounding import rounded_ratio
from plaudit.operators import insights as ins
from plaudit.operators.lookup import Lookup


@pytest.mark.parametrize("limit", [1_000, 0])
def test_repeated_keys_give_one_row_in_either_plan(spark, limit):
    table = spark.createDataFrame(
        [("good", 1.0, 0.2), ("good", 3.0, 0.1), ("bad", -1.0, 0.5), (None, 9.0, 9.0), ("good", 3.0, 0.05)],
        "token string, valence double, weight double",
    )
    lookup = Lookup(table, "token", max_rows=limit)
    assert lookup.small == (limit > 0)
    words = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "none"), (4, None)], "id int, w string")
    found = lookup.join(words, F.col("w"), {"valence": "v", "weight": "x"}, F.col("id"))
    assert {(r.id, r.v, r.x) for r in found.collect()} == {(1, 3.0, 0.1), (2, -1.0, 0.5), (3, None, None), (4, None, None)}


def test_means_of_a_million_million_rows(spark):
    rows = [(9 * 10**15, 10**12, 0.9), (-3 * 10**15, 10**12, -0.3), (0, 0, 0.0), (12_345, 2, 0.6172)]
    df = spark.createDataFrame(rows, "t long, n long, wanted double")
    assert all(r.m == r.wanted for r in df.select("wanted", ins.mean_compound("t", "n").alias("m")).collect())


def test_wide_ratio_rounds_like_the_narrow_one(spark):
    pairs = spark.range(1, 300).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(60))))
    differ = rounded_ratio("a", "id", 4) != rounded_ratio("a", "id", 4, wide=True)
    assert not pairs.filter(differ).count()


def test_empty_word_lists_match_nothing(spark):
    df = spark.createDataFrame([("any text",)], "t string")
    row = df.select(
        ins.is_feature_request(F.col("t"), ()).alias("r"),
        ins.complaint_category(F.col("t"), (("first", ()), ("second", ("text",))), "rest").alias("c"),
    ).first()
    assert (row.r, row.c) == (False, "second")


def test_projection_tables_find_nearly_all_neighbours(spark):
    """Recall of at least 0.9 against brute force on clustered and on dense points, with equal projections among them."""
    from plaudit.operators.neighbours import exact_neighbours, near_neighbours, projection_leaves
    from plaudit.sources.readers import small_table
    from pyspark.sql import functions as F
    import numpy as np

    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 20)) * 3
    x = np.concatenate([centres[draw.integers(0, 40, 1500)] + draw.normal(size=(1500, 20)), np.zeros((300, 20))])
    x[1500:, 0] = np.arange(300) % 2  # two spots, each of many points
    df = small_table(spark, {"pid": range(len(x)), "values": x.tolist()}, "pid bigint, values array<double>")
    df = df.select("pid", "values", F.sequence(F.lit(0), F.size("values") - 1).alias("indices"), F.col("values")[0].alias("proj"))
    leaves = projection_leaves(df, 200, 8, 42)
    assert leaves.groupBy("tab", "leaf").count().agg(F.max("count")).first()[0] <= 200
    found = {(r["pid"], r["rank"]): r["distance"] for r in near_neighbours(df, 5, leaf_rows=200).collect()}
    again = {(r["pid"], r["rank"]): r["distance"] for r in near_neighbours(df.repartition(3), 5, leaf_rows=200).collect()}
    wanted = {(r["pid"], r["rank"]): r["distance"] for r in exact_neighbours(df, 5).collect()}
    assert found == again and set(found) == set(wanted)
    assert sum(found[key] <= wanted[key] + 1e-9 for key in wanted) >= 0.9 * len(wanted)


def test_neighbour_of_many_points_is_split(spark, monkeypatch):
    from plaudit.operators import oversample
    from pyspark.sql import functions as F

    monkeypatch.setattr(oversample, "HUB_ROWS", 7)
    near = spark.range(1, 60).selectExpr("id AS pid", "1 AS rank", "IF(id < 50, 0L, 1L) AS nid")
    ends = spark.range(2).selectExpr("id AS nid", "id * 10 AS n_copies")
    found = oversample._with_ends(near, ends)
    assert sorted((r["pid"], r["n_copies"]) for r in found.collect()) == [(i, 0 if i < 50 else 10) for i in range(1, 60)]
    assert found.filter("nid = 0").select("salt").distinct().count() == 7
