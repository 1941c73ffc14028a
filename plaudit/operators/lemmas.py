"""Stop-word and lemma joins over word rows, for lists held as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.operators.lookup import Lookup


def without_stop_words(words: DataFrame, stop_words: DataFrame, token: str = "token") -> DataFrame:
    """Word rows whose token is not in ``stop_words(token)``."""
    lookup = Lookup(stop_words.select("token"), "token")
    salt = F.struct(*[F.col(c) for c in words.columns])
    marked = lookup.join(words, F.col(token), {"token": "_stop"}, salt)
    return marked.filter(F.col("_stop").isNull()).drop("_stop")


def lemmatise(
    df: DataFrame, tokens: Column, lemmas: DataFrame, id_column: str = "review_id", output: str = "cleaned_review"
) -> DataFrame:
    """(id, text) with every token replaced by its entry in ``lemmas(form, lemma)``.

    Tokens travel as (id, pos, token) rows and are collected per review, so a
    group is never larger than one review. Ending rules alone need no shuffle:
    see ``functions.text.suffix_lemma``.
    """
    lookup = Lookup(lemmas.select("form", "lemma"), "form")
    # The null row keeps reviews without words.
    rows = df.select(id_column, F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), tokens)).alias("pos", "token"))
    joined = lookup.join(rows, F.col("token"), {"lemma": "_lemma"}, F.struct(id_column, "pos"))
    # Ten digits before the word sort like its place, and take about half the bytes of a struct of both.
    word = F.concat(F.lpad(F.col("pos").cast("string"), 10, "0"), F.coalesce("_lemma", "token"))
    in_order = F.transform(F.array_sort(F.collect_list(word)), lambda w: F.substring(w, F.lit(11), F.length(w)))
    return joined.groupBy(id_column).agg(F.array_join(in_order, " ").alias(output))


def lemma_pairs(lemmas: DataFrame | None) -> tuple[tuple[str, str], ...]:
    """A dictionary (form, lemma) as pairs for ``clean_tokens`` and the settings of jobs.

    Measured first: one beyond the limits of ``Lookup`` is refused and has to be joined by ``lemmatise``.
    """
    if lemmas is None:
        return ()
    lookup = Lookup(lemmas.select("form", "lemma"), "form")
    if not lookup.small:
        raise ValueError("the lemma table is too large for a plan; join it with lemmatise")
    return tuple(sorted((r["form"], r["lemma"]) for r in lookup.df.collect() if r["lemma"] is not None))
