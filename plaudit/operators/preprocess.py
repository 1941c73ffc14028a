"""Preprocessing of a whole review table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.functions.signals import with_signals
from plaudit.functions.text import clean_text, english_stop_words
from plaudit.operators.lemmas import lemma_pairs


def process_reviews(
    df: DataFrame, text_column: str = "review_text", stop_words: Iterable[str] | None = None, lemmas: DataFrame | None = None
) -> DataFrame:
    """Add ``cleaned_review`` and the seven signals. Map-only.

    ``lemmas`` (form, lemma) goes before the noun endings.
    """
    stop = english_stop_words() if stop_words is None else stop_words
    cleaned = df.withColumn("cleaned_review", clean_text(F.col(text_column), stop, lemmas=lemma_pairs(lemmas)))
    return with_signals(cleaned, text_column)
