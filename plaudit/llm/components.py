"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import stage

FILE_EDGES = 1_000_000


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Every vertex has one smaller neighbour at most, and those have none."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                             F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")
    per = edges.select(ends).select("e.*").groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.filter("up > 1 or up + down > 1").limit(1).count()


def _written(edges: DataFrame, files: int | None = None) -> DataFrame:
    """Edges once each, in as many files as their number asks for."""
    once = edges.filter("a <> b").distinct()
    return stage(once.coalesce(files) if files else once)


def connected(edges: DataFrame) -> DataFrame:
    """(a, b): every vertex but the smallest of its component, with that smallest one.

    Kiveris et al. 2014. A round links all larger neighbours of each vertex, then all
    smaller ones, with its smallest neighbour; minima are combined before the shuffle,
    so hubs do not gather their neighbours. Rounds are written to the shared folder;
    their number is logarithmic in practice.
    """
    now = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    files = 1 + now.count() // FILE_EDGES
    while not _is_forest_of_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        small = large.join(lower, "a").select(F.explode(pairs).alias("e")).select("e.*")
        now = _written(small, files)
    return now
