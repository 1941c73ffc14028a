"""Models, oversampling, neighbours and themes.

Queries run with the operators' own defaults (``TrainConfig``, ``ThemeConfig``) on all
labelled rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.catalog.common import Query, labelled, reviews, table
from plaudit.catalog import opinion
from plaudit.catalog.text import DICTIONARY, STOP_WORDS, dictionary
from plaudit.operators import themes as th
from plaudit.operators import tfidf as tf
from plaudit.operators.model import (
    LEGACY_CONFIG,
    WORDS,
    AuthenticityModel,
    TrainConfig,
    cross_validate,
    feature_tokens,
    fit_features,
    fit_vote,
)
from plaudit.operators.lemmas import lemma_pairs
from plaudit.operators.neighbours import exact_neighbours
from plaudit.operators.oversample import balance_classes
from plaudit.operators.splits import stratified_folds
from plaudit.plans.scoring import analyse_feedback, feedback_rows, score_batch
from plaudit.plans.training import feature_table, train
from plaudit.session import staged
from plaudit.operators.report import result_summary, signed_score
from plaudit.rules import SIGNAL_COLUMNS

TRAINING = TrainConfig()
THEMES = th.ThemeConfig()
# The name by which the SQL below reads the vocabulary size.
SMALL = TRAINING


def _features(spark, sf, config=TRAINING):
    # Reviews and labels are joined, and texts cleaned, once.
    data = staged(labelled(spark, sf).withColumn(WORDS, feature_tokens(config)))
    model = fit_features(data, config)
    return model, feature_table(data, model)


_fitted: dict = {}


def _model(spark, sf) -> AuthenticityModel:
    """The vote, trained once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        model, rows = _features(spark, sf)
        _fitted[key] = AuthenticityModel(model, fit_vote(rows, TRAINING))
    return _fitted[key]


def q_features(spark, sf, config=TRAINING):
    """Non-zero cells of the feature matrix: TF-IDF cells, then the raw signals."""
    data = labelled(spark, sf)
    rows = fit_features(data, config).transform(data).select("review_id", F.unwrap_udt("features").alias("v"))
    dense = F.when(F.col("v.indices").isNull(), F.sequence(F.lit(0), F.size("v.values") - 1)).otherwise(F.col("v.indices"))
    cells = F.filter(F.arrays_zip(dense.alias("i"), F.col("v.values").alias("x")), lambda e: e["x"] != 0)
    return rows.select("review_id", F.explode_outer(cells).alias("e")).filter("e is not null").select(
        "review_id", F.col("e.i").cast("bigint").alias("idx"), F.round("e.x", 6).alias("value")
    )


def q_features_dictionary(spark, sf):
    """The feature matrix with a lemma table and a stop list of the caller's."""
    pairs = lemma_pairs(dictionary(spark))
    return q_features(spark, sf, replace(TRAINING, stop_words=STOP_WORDS, lemmas=pairs))


def _member(name: str):
    def query(spark, sf):
        _, rows = _features(spark, sf)
        vote = fit_vote(rows, replace(TRAINING, members=(name,)))
        return vote.transform(rows).select("row_key", "label", "predicted", F.round("genuine", 6).alias("genuine"))

    return query


def q_vote(spark, sf):
    model = _model(spark, sf)
    scored = model.vote.transform(model.features.transform(labelled(spark, sf)))
    return scored.select("review_id", "label", "predicted", F.round("genuine", 6).alias("genuine"))


def q_predict_batch(spark, sf):
    scored = _model(spark, sf).score(reviews(spark, sf))
    return scored.select(
        "review_id", "prediction", "confidence", "genuine_probability", "fake_probability", "behavioral_signals.*"
    )


def q_smote(spark, sf):
    """Labelled reviews raised to class parity; the synthetic rows are marked."""
    _, rows = _features(spark, sf)
    return balance_classes(rows).select("row_key", "label", F.startswith("row_key", F.lit("new-")).alias("synthetic"))


def q_class_parity(spark, sf):
    return q_smote(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("reviews"))


def q_neighbours(spark, sf):
    """Five nearest vectors of every vector in the embeddings table."""
    points = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("values")
    )
    first = F.get("values", F.lit(0))
    placed = points.select("pid", "values", F.sequence(F.lit(0), F.size("values") - 1).alias("indices"), first.alias("proj"))
    return exact_neighbours(placed, 5, block_rows=128).select(
        F.col("pid").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.col("nid").alias("neighbour"),
        F.round("distance", 6).alias("distance"),
    )


def q_cross_validate(spark, sf):
    _, rows = _features(spark, sf)
    return cross_validate(stratified_folds(rows, "label", "row_key", TRAINING.folds), TRAINING)


def q_train_evaluate(spark, sf):
    """The whole training job with its run log."""
    return train(labelled(spark, sf), TRAINING, "catalogue").run


def q_train_legacy(spark, sf):
    return train(labelled(spark, sf), LEGACY_CONFIG, "legacy").report


def q_kmeans_themes(spark, sf):
    return th.find_themes(reviews(spark, sf), THEMES)


def q_topics_legacy(spark, sf):
    return th.topic_lines(reviews(spark, sf), th.LEGACY_THEMES)


def q_centroids(spark, sf):
    """Mean term weight per document source, from long-form weights."""
    # Texts are read and cleaned once.
    data, tokens = staged(reviews(spark, sf).select("review_id", th.theme_tokens(THEMES).alias("words"))), F.col("words")
    vocabulary = tf.fit_vocabulary(data, tokens, THEMES.max_n, THEMES.max_features)
    weights = tf.tfidf_rows(data, tokens, THEMES.max_n, vocabulary, dealt=True)
    members = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), F.col("source").alias("cluster"))
    found = th.centroid_terms(weights, members)
    return found.select("cluster", "term", F.round("weight", 6).alias("weight"))


def _given_clusters(spark, sf):
    """Every document in the cluster of its source, and the clusters' mean weights."""
    found = q_centroids(spark, sf)
    number = F.regexp_extract("cluster", r"(\d+)$", 1).cast("int")
    cells = found.select(number.alias("cluster"), "term", "weight")
    source = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), source.alias("cluster")), cells


def q_given_themes(spark, sf):
    """Theme report of a given clustering: sizes, top terms, first reviews, place by size."""
    members, cells = _given_clusters(spark, sf)
    rows = th.theme_rows(reviews(spark, sf), members, th.top_terms_of(cells, 8), 3)
    place = F.row_number().over(W.orderBy(F.desc("size"), "cluster_id")).cast("bigint")
    return rows.select(
        place.alias("place"), "cluster_id", "size", F.array_join("key_terms", "|").alias("key_terms"),
        F.array_join(F.slice("key_terms", 1, 4), ", ").alias("first_terms"),
        F.array_join("representative_examples", "|").alias("examples"),
    )


def q_given_topics(spark, sf):
    _, cells = _given_clusters(spark, sf)
    return th.theme_lines(th.top_terms_of(cells, 5))


def q_predict_signals(spark, sf):
    """Every scored review: its signals, and whether shares, confidence and label fit together."""
    rows = q_predict_batch(spark, sf)
    fake, genuine = F.col("fake_probability"), F.col("genuine_probability")
    return rows.select(
        "review_id", *SIGNAL_COLUMNS,
        (F.abs(fake + genuine - 1) < 1e-9).alias("shares_sum"),
        (F.col("confidence") == F.greatest(fake, genuine)).alias("confidence_fits"),
        F.col("prediction").isin("Genuine", "Fake").alias("label_known"),
        ((F.col("prediction") == "Genuine") | (genuine <= 0.5)).alias("label_fits"),
    )


def q_batch_tone(spark, sf):
    """The batch job's rows: id, text length and sentiment columns."""
    return q_batch_score(spark, sf).select(
        "review_id", F.length("review_text").cast("bigint").alias("chars"), "sentiment_label", "sentiment_compound",
        signed_score(F.col("sentiment_compound")).alias("signed"),
    )


def q_batch_score(spark, sf):
    return score_batch(reviews(spark, sf), _model(spark, sf), opinion.lexicon(spark), opinion.RULES)


def q_batch_summary(spark, sf):
    return result_summary(q_batch_score(spark, sf))


def q_feedback_job(spark, sf):
    done = analyse_feedback(
        reviews(spark, sf), _model(spark, sf), opinion.lexicon(spark), opinion.RULES,
        opinion.GROUPS, opinion.DEFAULT, opinion.MARKERS, THEMES,
    )
    return feedback_rows(done)


def queries() -> dict[str, Query]:
    found = {name: value for name, value in globals().items() if name.startswith("q_")}
    return found | {
        "q_logistic": _member("lr"),
        "q_forest": _member("rf"),
        "q_boosted": _member("gbt"),
    }


def oracle_sql() -> dict[str, str]:
    from plaudit.catalog.common import quoted, sql_clean_tokens
    from plaudit.catalog.sqlsentiment import sentiment_sql
    from plaudit.functions.text import english_stop_words

    stop = quoted(english_stop_words())
    tokens = f"list_filter({sql_clean_tokens('review_text', english_stop_words())}, lambda w: length(w) > 1 AND w NOT IN ({stop}))"
    from plaudit.catalog.text import signals_sql, sql_grams
    from plaudit.rules import SIGNAL_COLUMNS

    documents = "SELECT doc_id AS review_id, text AS review_text FROM documents"
    corpus = "SELECT d.doc_id AS review_id, d.text AS review_text FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
    signals = signals_sql(f"SELECT review_id, review_text AS t FROM ({corpus})", "review_id")
    cells = " UNION ALL ".join(
        f"SELECT review_id, (SELECT count(*) FROM vocab) + {i} AS idx, {c} AS value FROM signals"
        for i, c in enumerate(SIGNAL_COLUMNS)
    )
    def features(grams: str) -> str:
        return f"""
      WITH tf AS (SELECT review_id, term, count(*) AS tf FROM ({grams}) GROUP BY ALL),
      vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS idx FROM (
        SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT {SMALL.max_features})),
      raw AS (SELECT review_id, idx, (1 + ln(tf)) * (ln(((SELECT count(*) FROM ({corpus})) + 1)::DOUBLE / (df + 1)::DOUBLE) + 1) AS w
              FROM tf JOIN vocab USING (term)),
      signals AS ({signals})
      SELECT review_id, idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY review_id)), 6) AS value FROM raw
      UNION ALL SELECT review_id, idx, round(value, 6) FROM ({cells}) WHERE value <> 0"""

    own = f"list_filter({sql_clean_tokens('review_text', STOP_WORDS, DICTIONARY)}, lambda w: length(w) > 1)"
    centroids = f"""
          WITH tf AS (SELECT review_id AS doc_id, term, count(*) AS tf FROM ({sql_grams(documents, tokens=tokens)}) GROUP BY ALL),
          vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT {THEMES.max_features}),
          raw AS (SELECT doc_id, d.source, tf.term, tf * (ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)::DOUBLE) + 1) AS w
                  FROM tf JOIN vocab USING (term) JOIN documents d USING (doc_id)),
          unit AS (SELECT source, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)
          SELECT source AS cluster, term, round(sum(w) / any_value(n), 6) AS weight
          FROM unit JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source) GROUP BY ALL"""
    number = "regexp_extract({}, '([0-9]+)$', 1)::INTEGER + 1"
    ranked = f"""
      SELECT {number.format('cluster')} AS cluster_id, term, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS r
      FROM ({centroids})"""
    sentiment = sentiment_sql("SELECT doc_id AS id, text AS t FROM documents", opinion.LEXICON, opinion.RULES)
    return {
        "q_given_themes": f"""
          WITH terms AS (
            SELECT cluster_id, string_agg(term, '|' ORDER BY r) AS key_terms, string_agg(term, ', ' ORDER BY r) FILTER (r <= 4) AS first_terms
            FROM ({ranked}) WHERE r <= 8 GROUP BY cluster_id),
          placed AS (SELECT {number.format('source')} AS cluster_id, doc_id, text,
                     row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
          sizes AS (SELECT cluster_id, count(*) AS size, string_agg(text, '|' ORDER BY r) FILTER (r <= 3) AS examples FROM placed GROUP BY cluster_id)
          SELECT row_number() OVER (ORDER BY size DESC, cluster_id) AS place, cluster_id, size, key_terms, first_terms, examples
          FROM sizes JOIN terms USING (cluster_id)""",
        "q_given_topics": f"""
          SELECT cluster_id, 'Cluster ' || cluster_id || ': ' || string_agg(term, ', ' ORDER BY r) AS topic
          FROM ({ranked}) WHERE r <= 5 GROUP BY cluster_id""",
        "q_predict_signals": f"""
          SELECT *, true AS shares_sum, true AS confidence_fits, true AS label_known, true AS label_fits
          FROM ({signals_sql('SELECT doc_id AS review_id, text AS t FROM documents', 'review_id')})""",
        "q_batch_tone": f"""
          SELECT s.id AS review_id, length(d.text)::BIGINT AS chars, label AS sentiment_label, compound AS sentiment_compound,
                 CASE WHEN compound < 0 THEN '' ELSE '+' END || printf('%.4f', compound) AS signed
          FROM ({sentiment}) s JOIN documents d ON d.doc_id = s.id""",
        "q_features": features(sql_grams(corpus)),
        "q_features_dictionary": features(sql_grams(corpus, tokens=own)),
        "q_neighbours": """
          SELECT vec_id, rank, neighbour, distance FROM (
            SELECT a.vec_id, b.vec_id AS neighbour, round(list_distance(a.e, b.e), 6) AS distance,
                   row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
            FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a
            JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE rank <= 5""",
        "q_class_parity": """
          SELECT label, max(n) OVER () AS reviews FROM (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality)""",
        "q_centroids": centroids,
    }
