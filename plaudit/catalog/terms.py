"""Vocabulary, TF-IDF, stop words and lemmas in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit.catalog.common import Query, reviews, sql_normalise, sql_words, table
from plaudit.catalog.text import DOCUMENTS, sql_grams
from plaudit.functions import text as tx
from plaudit.operators import tfidf as tf
from plaudit.operators.lemmas import lemmatise, without_stop_words
from plaudit.sources.readers import small_table

MAX_FEATURES = 8000
# (form, lemma) pairs over frequent words of the tables.
LEMMAS = {"tion": "tio", "eaux": "eau", "heit": "hei", "ments": "ment", "les": "le", "des": "de", "nd": "nde"}


def _tokens(column: str = "review_text"):
    return tx.clean_tokens(F.col(column), tx.english_stop_words())


def _statistics(spark, sf):
    return tf.corpus_terms(reviews(spark, sf), _tokens(), 2)


def q_term_counts(spark, sf):
    """Corpus frequency and review frequency of every 1- and 2-gram."""
    return _statistics(spark, sf)


def q_vocab_topk(spark, sf):
    return tf.top_terms(_statistics(spark, sf), MAX_FEATURES)


def _weights(spark, sf, postings, sublinear):
    data = reviews(spark, sf)
    vocabulary = tf.top_terms(_statistics(spark, sf), MAX_FEATURES)
    weights = tf.weigh_postings(postings, vocabulary, F.lit(data.count()), sublinear)
    return weights.withColumn("weight", F.round("weight", 6))


def q_tfidf(spark, sf):
    """Sublinear 1- and 2-gram TF-IDF over 8,000 terms, unit length per review."""
    data = reviews(spark, sf)
    vocabulary = tf.fit_vocabulary(data, _tokens(), 2, MAX_FEATURES, sublinear=True)
    return tf.tfidf_rows(data, _tokens(), 2, vocabulary).withColumn("weight", F.round("weight", 6))


def q_tfidf_transform(spark, sf):
    """User turns weighted by the vocabulary fitted on reviews; unknown terms vanish."""
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("review_id"), "text"
    )
    return _weights(spark, sf, tf.posting_rows(turns, _tokens("text"), 2), False)


def q_tfidf_vectors(spark, sf):
    """The vector form of the same weights, read back as (index, weight) rows."""
    data = reviews(spark, sf)
    vocabulary = tf.fit_vocabulary(data, _tokens(), 2, MAX_FEATURES, sublinear=True)
    vectors = tf.tfidf_vectors(data, _tokens(), 2, vocabulary).select("review_id", F.unwrap_udt("tfidf").alias("v"))
    rows = vectors.select("review_id", F.explode(F.arrays_zip("v.indices", "v.values")).alias("e"))
    return rows.select(
        "review_id", F.col("e.indices").cast("bigint").alias("idx"), F.round("e.values", 6).alias("weight")
    )


def _words(spark, sf):
    words = tx.word_tokens(tx.normalise_text(F.col("review_text")))
    rows = reviews(spark, sf).select("review_id", F.posexplode_outer(words).alias("pos", "token"))
    return rows.filter(F.col("token").isNotNull())


def q_stopword_anti(spark, sf):
    """Words per review that are no stop words, by anti-join to a list."""
    stop = small_table(spark, {"token": tx.english_stop_words()}, "token string")
    kept = without_stop_words(_words(spark, sf), stop)
    return kept.groupBy("review_id").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("token")).alias("letters"))


def q_lemma_join(spark, sf):
    """Words replaced by a lemma dictionary and put together again in order."""
    pairs = small_table(spark, {"form": list(LEMMAS), "lemma": list(LEMMAS.values())}, "form string, lemma string")
    words = tx.word_tokens(tx.normalise_text(F.col("review_text")))
    return lemmatise(reviews(spark, sf), words, pairs)


def queries() -> dict[str, Query]:
    return {
        "q_term_counts": q_term_counts,
        "q_vocab_topk": q_vocab_topk,
        "q_tfidf": q_tfidf,
        "q_tfidf_transform": q_tfidf_transform,
        "q_tfidf_vectors": q_tfidf_vectors,
        "q_stopword_anti": q_stopword_anti,
        "q_lemma_join": q_lemma_join,
    }


def oracle_sql() -> dict[str, str]:
    grams = sql_grams(DOCUMENTS)
    stats = f"SELECT term, count(DISTINCT review_id) AS df, count(*) AS cf FROM ({grams}) GROUP BY term"
    vocab = f"SELECT * FROM ({stats}) ORDER BY cf DESC, term LIMIT {MAX_FEATURES}"

    def weights(source: str, tf_expr: str) -> str:
        return f"""
          SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM (
            SELECT review_id, g.term, ({tf_expr})
                   * (ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (v.df + 1)::DOUBLE) + 1) AS w
            FROM (SELECT review_id, term, count(*) AS tf FROM ({source}) GROUP BY ALL) g
            JOIN ({vocab}) v ON v.term = g.term)"""

    turns = "SELECT conv_id || '-' || turn AS review_id, text AS review_text FROM conversations"
    words = f"""
      SELECT review_id, unnest({sql_words(sql_normalise('review_text'))}) AS token FROM ({DOCUMENTS})"""
    stop = ", ".join(f"('{w}')" for w in tx.english_stop_words())
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEMMAS.items())
    return {
        "q_term_counts": stats,
        "q_vocab_topk": vocab,
        "q_tfidf": f"SELECT review_id, term, round(weight, 6) AS weight FROM ({weights(grams, '1 + ln(tf)')})",
        "q_tfidf_transform": f"""
          SELECT review_id, term, round(weight, 6) AS weight FROM ({weights(sql_grams(turns), 'tf::DOUBLE')})""",
        "q_tfidf_vectors": f"""
          SELECT review_id, v.idx, round(weight, 6) AS weight FROM ({weights(grams, '1 + ln(tf)')}) w
          JOIN (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM ({vocab})) v ON v.term = w.term""",
        "q_stopword_anti": f"""
          SELECT review_id, count(*) AS words, sum(length(token))::BIGINT AS letters FROM ({words}) w
          WHERE NOT EXISTS (SELECT 1 FROM (VALUES {stop}) s(token) WHERE s.token = w.token) GROUP BY review_id""",
        "q_lemma_join": f"""
          SELECT review_id, array_to_string(list_transform({sql_words(sql_normalise('review_text'))},
                 lambda w: CASE w {cases} ELSE w END), ' ') AS cleaned_review FROM ({DOCUMENTS})""",
    }
