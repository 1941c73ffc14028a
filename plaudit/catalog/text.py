"""Cleaning, signals, tokens and n-grams over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit.catalog.common import (
    Query,
    reviews,
    sql_class_count,
    sql_clean_tokens,
    sql_is_blank,
    sql_normalise,
    sql_words,
    sql_words_count,
    table,
)
from plaudit.functions import text as tx
from plaudit.functions.rounding import rounded_ratio_sql
from plaudit.functions.signals import DIGIT_CLASS, with_signals
from plaudit.operators import tfidf as tf
from plaudit.operators.preprocess import process_reviews
from plaudit.rules import SIGNAL_COLUMNS
from plaudit.sources.readers import small_table


def signals_sql(source: str, key: str, extra: str = "") -> str:
    blank = sql_is_blank("t")
    chars, words = "length(t)::BIGINT", sql_words_count("t")
    counts = f"""
      SELECT {key}, {extra} {blank} AS b, {chars} AS c, {words} AS w,
             {sql_class_count('t', '!')} AS e, {sql_class_count('t', '[' + chr(92) + 'p{Lu}]')} AS u,
             {sql_class_count('t', '[' + tx.SPACE_CLASS + ']')} AS s,
             {sql_class_count('t', '[[:punct:]]')} AS p, {sql_class_count('t', '[' + DIGIT_CLASS + ']')} AS d
      FROM ({source})"""
    values = {
        "review_length": "c::DOUBLE",
        "word_count": "w::DOUBLE",
        "exclamation_count": "e::DOUBLE",
        "caps_ratio": rounded_ratio_sql("u", "c"),
        "avg_word_length": rounded_ratio_sql("c - s", "w"),
        "punctuation_density": rounded_ratio_sql("p", "c"),
        "digit_ratio": rounded_ratio_sql("d", "c"),
    }
    columns = ", ".join(f"CASE WHEN b THEN 0.0 ELSE {values[c]} END AS {c}" for c in SIGNAL_COLUMNS)
    more = "cleaned_review, " if extra else ""
    return f"SELECT {key}, {more}{columns} FROM ({counts})"


def q_clean_text(spark, sf):
    stop = tx.english_stop_words()
    return reviews(spark, sf).select(
        "review_id", tx.clean_text(F.col("review_text"), stop).alias("cleaned_review")
    )


def q_clean_pages(spark, sf):
    """Links and tags stripped from raw HTML, before words are dropped."""
    return table(spark, sf, "pages").select("page_id", tx.normalise_text(F.col("html")).alias("normalised"))


def q_word_tokens(spark, sf):
    words = tx.word_tokens(tx.normalise_text(F.col("text")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(words, "|").alias("words"), F.size(words).cast("bigint").alias("n_words")
    )


def q_signals(spark, sf):
    return with_signals(reviews(spark, sf)).drop("review_text")


def q_blank_defaults(spark, sf):
    """Signals when a text may be missing: unlabelled documents lose theirs."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), "toxic")
    blanked = reviews(spark, sf).join(labels, "review_id", "left").select(
        "review_id",
        F.when(F.col("toxic").isNull(), F.lit(None))
        .when(F.col("toxic") == 1, F.lit(" \t "))
        .otherwise(F.col("review_text"))
        .alias("review_text"),
    )
    return with_signals(blanked).drop("review_text")


def q_process_table(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return process_reviews(turns, "text").drop("text")


# A dictionary and stop words over frequent words of the tables.
DICTIONARY = {"tion": "tio", "eaux": "eau", "heit": "hei", "ments": "mentum", "les": "le", "des": "de", "nd": "nde", "ing": "ingen"}
STOP_WORDS = ("the", "of", "and", "der", "die", "und", "de", "la", "el", "en")


def dictionary(spark):
    return small_table(spark, {"form": list(DICTIONARY), "lemma": list(DICTIONARY.values())}, "form string, lemma string")


def q_process_dictionary(spark, sf):
    """Preprocessing with a lemma table and a stop list of the caller's."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return process_reviews(turns, "text", STOP_WORDS, dictionary(spark)).drop("text")


def q_ngrams(spark, sf):
    """Every 1- and 2-gram of cleaned words with its count per review."""
    return tf.posting_rows(reviews(spark, sf), tx.clean_tokens(F.col("review_text"), tx.english_stop_words()), 2)


def sql_grams(source: str, key: str = "review_id", text: str = "review_text", tokens: str | None = None) -> str:
    """(key, term) rows of 1- and 2-grams in DuckDB."""
    tokens = tokens or sql_clean_tokens(text, tx.english_stop_words())
    return f"""
      SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)),
             lambda i: t[i] || ' ' || t[i + 1]))) AS term
      FROM (SELECT {key}, {tokens} AS t FROM ({source}))"""


DOCUMENTS = "SELECT doc_id AS review_id, text AS review_text FROM documents"


def queries() -> dict[str, Query]:
    return {
        "q_clean_text": q_clean_text,
        "q_clean_pages": q_clean_pages,
        "q_word_tokens": q_word_tokens,
        "q_signals": q_signals,
        "q_blank_defaults": q_blank_defaults,
        "q_process_table": q_process_table,
        "q_process_dictionary": q_process_dictionary,
        "q_ngrams": q_ngrams,
    }


def oracle_sql() -> dict[str, str]:
    stop = tx.english_stop_words()
    blanked = """
      SELECT d.doc_id AS review_id, CASE WHEN l.toxic IS NULL THEN NULL
             WHEN l.toxic = 1 THEN ' ' || chr(9) || chr(160) ELSE d.text END AS t
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
    return {
        "q_clean_text": f"""
          SELECT review_id, array_to_string({sql_clean_tokens('review_text', stop)}, ' ') AS cleaned_review
          FROM ({DOCUMENTS})""",
        "q_clean_pages": f"SELECT page_id, {sql_normalise('html')} AS normalised FROM pages",
        "q_word_tokens": f"""
          SELECT conv_id, turn, array_to_string(w, '|') AS words, len(w)::BIGINT AS n_words
          FROM (SELECT conv_id, turn, {sql_words(sql_normalise('text'))} AS w FROM conversations)""",
        "q_signals": signals_sql("SELECT doc_id AS review_id, text AS t FROM documents", "review_id"),
        "q_blank_defaults": signals_sql(blanked, "review_id"),
        "q_process_table": signals_sql(
            "SELECT conv_id, turn, text AS t FROM conversations",
            "conv_id, turn",
            f"array_to_string({sql_clean_tokens('t', stop)}, ' ') AS cleaned_review,",
        ),
        "q_process_dictionary": signals_sql(
            "SELECT conv_id, turn, text AS t FROM conversations",
            "conv_id, turn",
            f"array_to_string({sql_clean_tokens('t', STOP_WORDS, DICTIONARY)}, ' ') AS cleaned_review,",
        ),
        "q_ngrams": f"SELECT review_id, term, count(*) AS tf FROM ({sql_grams(DOCUMENTS)}) GROUP BY ALL",
    }
