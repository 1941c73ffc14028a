"""Shared parts of the query catalogue: table loading and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.functions.text import MARKUP, NON_SPACE, SPACE_CLASS
from plaudit.sources.readers import spread_file
from plaudit.rules import CONTRACTIONS, LEMMA_MIN_CHARS, LEMMA_SUFFIXES, LEMMA_WORDS

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as reviews."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review_text")
    )
    return spread_file(documents)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that carry a quality label (1 genuine, 0 fake)."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("review_id"), F.col("quality").alias("label")
    )
    return reviews(spark, sf_dir).join(labels, "review_id")


def quoted(words: Iterable[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_is_blank(text: str) -> str:
    return f"({text} IS NULL OR NOT regexp_matches({text}, '[^{SPACE_CLASS}]'))"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def sql_normalise(text: str) -> str:
    no_markup = f"regexp_replace(lower({text}), '{MARKUP}', ' ', 'g')"
    return f"trim(regexp_replace({no_markup}, '[^a-zA-Z]+', ' ', 'g'))"


def sql_words(normalised: str) -> str:
    cut = normalised
    for word, pair in CONTRACTIONS:
        cut = f"regexp_replace({cut}, '\\b{word}\\b', '{pair}', 'g')"
    return f"list_filter(string_split({cut}, ' '), lambda w: w <> '')"


def sql_lemma(word: str, lemmas: dict[str, str] | None = None) -> str:
    whens = [f"WHEN {word} = '{form}' THEN '{lemma}'" for form, lemma in (lemmas or {}).items()]
    whens.append(f"WHEN length({word}) < {LEMMA_MIN_CHARS} THEN {word}")
    whens += [f"WHEN {word} = '{form}' THEN '{lemma}'" for form, lemma in LEMMA_WORDS]
    for ending, replacement in LEMMA_SUFFIXES:
        stem = f"left({word}, length({word}) - {len(ending)})"
        whens.append(f"WHEN ends_with({word}, '{ending}') THEN {stem} || '{replacement}'")
    return f"(CASE {' '.join(whens)} ELSE {word} END)"


def sql_clean_tokens(text: str, stop_words: Iterable[str], lemmas: dict[str, str] | None = None) -> str:
    """List of cleaned words of a text expression."""
    words = sql_words(sql_normalise(text))
    kept = f"list_filter({words}, lambda w: length(w) > 1 AND w NOT IN ({quoted(sorted(set(stop_words)))}))"
    return f"coalesce(list_transform({kept}, lambda w: {sql_lemma('w', lemmas)}), CAST([] AS VARCHAR[]))"


def sql_words_count(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{NON_SPACE}'))::BIGINT"


def sql_class_count(text: str, klass: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{klass}', '', 'g')))::BIGINT"
