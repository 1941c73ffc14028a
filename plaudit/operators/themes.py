"""Themes: k-means over TF-IDF, with key terms and example reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.functions.text import clean_tokens, drop_stop_words, english_stop_words, vectorizer_tokens
from plaudit.operators import tfidf
from plaudit.rules import SEED
from plaudit.session import cut_lineage
from plaudit.sources.readers import small_table

NO_CLUSTERS = "No significant clusters"
BETWEEN = "\x01"  # between words that are kept in a string
SCHEMA = "cluster_id int, key_terms array<string>, representative_examples array<string>, size bigint"


@dataclass(frozen=True)
class ThemeConfig:
    clusters: int = 4
    max_features: int = 2000
    max_n: int = 2
    cleaned: bool = True
    top_terms: int = 8
    examples: int = 3
    seed: int = SEED
    iterations: int = 300
    stop_words: tuple[str, ...] | None = None  # of the cleaning; None: the English list
    vectorizer_stop_words: tuple[str, ...] | None = None  # of the term weights, after the lemmas; None: the same list
    lemmas: tuple[tuple[str, str], ...] = ()  # (form, lemma), before the noun endings


LEGACY_THEMES = ThemeConfig(clusters=3, max_features=1000, max_n=1, cleaned=False, top_terms=5)


def theme_tokens(config: ThemeConfig):
    """Words that terms are made of: cleaned, lemmatised, then filtered by the vectorizer's own list."""
    stop = english_stop_words() if config.stop_words is None else config.stop_words
    own = stop if config.vectorizer_stop_words is None else config.vectorizer_stop_words
    text = F.col("review_text")
    if config.cleaned:
        return drop_stop_words(clean_tokens(text, stop, lemmas=config.lemmas), own)
    return vectorizer_tokens(text, own)


@dataclass(frozen=True)
class Clustering:
    members: DataFrame  # review_id, review_text, cluster
    terms: DataFrame  # cluster, rank, term, weight


def _assign(reviews: DataFrame, config: ThemeConfig, k: int) -> Clustering | None:
    """Cluster number per review and top terms per centre; None without any term."""
    spark = reviews.sparkSession
    # Texts are read and cleaned once; kept rather than staged, as k-means starts from the order of the rows.
    # They are kept on disk, a string a review: the heap is left to the vectors.
    cleaned = reviews.select("review_id", theme_tokens(config).alias("words"))
    line = F.when(F.size("words") > 0, F.array_join("words", BETWEEN)).alias("line")
    kept = cleaned.select("review_id", line).persist(StorageLevel.DISK_ONLY)
    words = kept.select("review_id", F.coalesce(F.split("line", BETWEEN), F.array().cast("array<string>")).alias("words"))
    vocabulary = tfidf.fit_vocabulary(words, F.col("words"), config.max_n, config.max_features)
    if not vocabulary.terms:
        kept.unpersist()
        return None
    vectors = tfidf.tfidf_vectors(words, F.col("words"), config.max_n, vocabulary, "features")
    vectors = vectors.select("review_id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    vectors.count()
    kept.unpersist()
    # The row solver suits sparse vectors and accepts fewer distinct points than k.
    means = KMeans(
        k=k, seed=config.seed, maxIter=config.iterations, solver="row", featuresCol="features", predictionCol="cluster"
    )
    model = means.fit(vectors)
    # At most k * max_features numbers.
    rows = [
        (c, float(w), t)
        for c, centre in enumerate(model.clusterCenters())
        for t, w in zip(vocabulary.terms, centre.tolist())
    ]
    cells = small_table(
        spark,
        {"cluster": [r[0] for r in rows], "term": [r[2] for r in rows], "weight": [r[1] for r in rows]},
        "cluster int, term string, weight double",
    )
    # Only ids and numbers are kept; texts are looked up for the examples.
    members = cut_lineage(model.transform(vectors).select("review_id", "cluster"))
    vectors.unpersist()
    return Clustering(members, top_terms_of(cells, config.top_terms))


def top_terms_of(cells: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest terms of every cluster: (cluster, rank, term, weight)."""
    order = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("weight"), "term"))
    return cells.withColumn("rank", order).filter(F.col("rank") <= n).select("cluster", "rank", "term", "weight")


def _in_order(value: str, output: str):
    return F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(output)


def _single(reviews: DataFrame, size: int, examples: int) -> DataFrame:
    first = reviews.orderBy("review_id").limit(examples)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("review_id", "review_text"))), lambda x: x["review_text"])
    return first.agg(
        F.lit(1).alias("cluster_id"), F.array().cast("array<string>").alias("key_terms"),
        ordered.alias("representative_examples"), F.lit(size).cast("bigint").alias("size"),
    )


def find_themes(reviews: DataFrame, config: ThemeConfig = ThemeConfig()) -> DataFrame:
    """(cluster_id, key_terms, representative_examples, size), largest first.

    Fewer than two reviews give one cluster without terms; none give no rows.
    """
    spark = reviews.sparkSession
    first = reviews.select("review_id").take(config.clusters)
    k = min(config.clusters, len(first))
    if k == 0:
        return spark.createDataFrame([], SCHEMA)
    if k < 2:
        return _single(reviews, 1, 2)
    found = _assign(reviews, config, k)
    if found is None:
        return _single(reviews, reviews.count(), config.examples)
    return theme_rows(reviews, found.members, found.terms, config.examples)


def theme_rows(reviews: DataFrame, members: DataFrame, top: DataFrame, n_examples: int) -> DataFrame:
    """One row per cluster of any clustering (review_id, cluster), largest first."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    terms = top.groupBy("cluster").agg(_in_order("term", "key_terms"))
    order = F.row_number().over(W.partitionBy("cluster").orderBy("review_id"))
    # At most clusters * examples ids, so the text scan is joined to a small table.
    picked = members.withColumn("rank", order).filter(F.col("rank") <= n_examples)
    examples = (
        reviews.join(picked, "review_id")
        .groupBy("cluster")
        .agg(_in_order("review_text", "representative_examples"))
    )
    table = sizes.join(terms, "cluster", "left").join(examples, "cluster")
    return table.select(
        (F.col("cluster") + 1).alias("cluster_id"),
        F.coalesce("key_terms", F.array().cast("array<string>")).alias("key_terms"), "representative_examples", "size",
    ).orderBy(F.desc("size"), "cluster_id")


def topic_lines(reviews: DataFrame, config: ThemeConfig = LEGACY_THEMES) -> DataFrame:
    """Older form: one line of top terms per cluster, or a note for too few reviews."""
    spark = reviews.sparkSession
    if len(reviews.select("review_id").take(config.clusters)) < config.clusters:
        return small_table(spark, {"cluster_id": [0], "topic": [NO_CLUSTERS]}, "cluster_id int, topic string")
    found = _assign(reviews, config, config.clusters)
    if found is None:
        return small_table(spark, {"cluster_id": [0], "topic": [NO_CLUSTERS]}, "cluster_id int, topic string")
    return theme_lines(found.terms)


def theme_lines(top: DataFrame) -> DataFrame:
    """"Cluster i: a, b, ..." for every cluster of (cluster, rank, term)."""
    terms = top.groupBy("cluster").agg(_in_order("term", "key_terms"))
    number = F.col("cluster") + 1
    line = F.concat(F.lit("Cluster "), number.cast("string"), F.lit(": "), F.array_join("key_terms", ", "))
    return terms.select(number.alias("cluster_id"), line.alias("topic")).orderBy("cluster_id")


def centroid_terms(postings: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, term, weight): mean weight per cluster, absent terms count as 0.

    ``members`` is the side that is hashed, so postings are not sorted; those that lie by
    review (``tfidf_rows`` with ``dealt``) are not shuffled either.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = postings.join(members.hint("shuffle_hash"), "review_id").groupBy("cluster", "term").agg(F.sum("weight").alias("s"))
    return sums.join(sizes, "cluster").select("cluster", "term", (F.col("s") / F.col("n")).alias("weight"))
