"""Term statistics, vocabulary and TF-IDF weights in long form and as vectors.

Term counts of one review are taken inside its row (sorted words, run
lengths). Corpus statistics number the words of an Arrow batch, count its n-grams by
number, and make strings of the distinct ones only, so the one shuffle gets a partial row
per term and batch; a word of half the corpus is no more.
Weights: tf, or 1 + ln(tf) when sublinear, times ln((1 + N) / (1 + df)) + 1,
then scaled to unit length per review.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.operators.lookup import Lookup
from plaudit.functions.text import word_ngrams
from plaudit.sources.readers import small_table


def with_terms(df: DataFrame, tokens: Column, max_n: int, output: str) -> DataFrame:
    """Add the 1..``max_n``-grams of ``tokens``.

    The tokens get a projection of their own: the n-gram expression reads them
    once per element, and an expression in their place would run that often.
    """
    return df.withColumn("_tok", tokens).withColumn(output, word_ngrams(F.col("_tok"), max_n)).drop("_tok")


def with_term_counts(df: DataFrame, tokens: Column, max_n: int = 1, id_column: str = "review_id") -> DataFrame:
    """(id, array<struct<term, tf>>), one projection per array."""
    terms = with_terms(df, tokens, max_n, "_terms")
    ordered = terms.select(id_column, F.sort_array("_terms").alias("_o"))
    marked = ordered.select(
        id_column, F.size("_o").alias("_n"),
        F.filter(
            F.transform("_o", lambda t, i: F.struct(t.alias("term"), i.alias("at"), F.get("_o", i - 1).alias("before"))),
            lambda m: m["before"].isNull() | (m["term"] != m["before"]),
        ).alias("_s"),
    )
    return marked.select(
        id_column,
        F.transform(
            "_s",
            lambda m, j: F.struct(
                m["term"].alias("term"),
                (F.coalesce(F.get("_s", j + 1)["at"], F.col("_n")) - m["at"]).cast("bigint").alias("tf"),
            ),
        ).alias("counts"),
    )


def posting_rows(df: DataFrame, tokens: Column, max_n: int = 1, id_column: str = "review_id") -> DataFrame:
    """(id, term, tf) rows. Map-only.

    The outer explode matters: for the inner one Catalyst adds a filter on the
    array size below the projections, which would compute every array twice
    and unfold the nested lambdas into each other.
    """
    counted = with_term_counts(df, tokens, max_n, id_column)
    rows = counted.select(id_column, F.explode_outer("counts").alias("c"))
    return rows.select(id_column, "c.term", "c.tf").filter(F.col("term").isNotNull())


def term_statistics(postings: DataFrame) -> DataFrame:
    """(term, df, cf): reviews with the term and its total count."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


SLICE_WORDS = 2_000_000  # words of an Arrow batch counted at once


def _tally(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, the rows that have each, and how often each comes, by one sort of both in a number."""
    bits = int(row.max()).bit_length()
    keys = np.sort((codes << bits) | row)
    fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))  # a row's first of a code
    found = keys[fresh] >> bits
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    return found[first], np.diff(np.append(first, len(fresh))), np.diff(np.append(fresh[first], len(keys)))


def _gram_counts(words: pa.Array, size: np.ndarray, max_n: int) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of the n-grams of some reviews, given their words and the number of each review's words."""
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(row))  # words from here to the end of the review
    listed = words.dictionary_encode()
    numbers, names = listed.indices.to_numpy().astype(np.int64), listed.dictionary
    codes, terms, at = numbers, names, np.arange(len(row))
    for n in range(1, max_n + 1):
        if n > 1:
            kept = np.flatnonzero(left[at] >= n)
            at = at[kept]
            if not len(at):
                return
            codes = codes[kept] * len(names) + numbers[at + n - 1]
        found, df, cf = _tally(codes, row[at])
        if n > 1:
            terms = pc.binary_join_element_wise(terms.take(pa.array(found // len(names))), names.take(pa.array(found % len(names))), " ")
        yield pa.RecordBatch.from_arrays([terms, pa.array(df, pa.int64()), pa.array(cf, pa.int64())], ["term", "df", "cf"])
        if 1 < n < max_n:
            codes = np.searchsorted(found, codes)


def corpus_terms(df: DataFrame, tokens: Column, max_n: int = 1) -> DataFrame:
    """(term, df, cf) of the 1..``max_n``-grams of ``tokens``, words without blanks: ``term_statistics`` without term rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            ends, first = np.cumsum(size), 0
            while first < len(size):
                before = int(ends[first] - size[first])
                last = max(first + 1, int(np.searchsorted(ends, before + SLICE_WORDS, side="right")))
                if ends[last - 1] > before:
                    yield from _gram_counts(flat.slice(before, int(ends[last - 1]) - before), size[first:last], max_n)
                first = last

    parts = df.select(tokens.alias("t")).mapInArrow(count, "term string, df bigint, cf bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def top_terms(statistics: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent terms of the corpus, ties by term."""
    return statistics.orderBy(F.desc("cf"), "term").limit(size)


@dataclass(frozen=True)
class Vocabulary:
    """Fitted terms in alphabetical order; at most ``max_features`` of them."""

    terms: tuple[str, ...]
    document_counts: tuple[int, ...]
    documents: int
    sublinear: bool

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.documents) / (1 + n)) + 1.0 for n in self.document_counts]

    def table(self, spark) -> DataFrame:
        """(term, idx, df, idf) as a local relation."""
        columns = {
            "term": self.terms, "idx": range(len(self.terms)), "df": self.document_counts, "idf": self.idf,
        }
        return small_table(spark, columns, "term string, idx int, df bigint, idf double")

    def to_json(self) -> str:
        return json.dumps(
            {"terms": self.terms, "df": self.document_counts, "n": self.documents, "sublinear": self.sublinear}
        )

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        read = json.loads(text)
        return cls(tuple(read["terms"]), tuple(read["df"]), read["n"], read["sublinear"])


def fit_vocabulary(
    df: DataFrame, tokens: Column, max_n: int, max_features: int, sublinear: bool = False, id_column: str = "review_id"
) -> Vocabulary:
    """Top terms of the corpus; the driver receives at most ``max_features`` rows."""
    rows = top_terms(corpus_terms(df, tokens, max_n), max_features).collect()
    rows.sort(key=lambda row: row["term"])
    return Vocabulary(tuple(r["term"] for r in rows), tuple(r["df"] for r in rows), df.count(), sublinear)


def weigh_postings(
    postings: DataFrame, vocabulary: DataFrame, documents: Column, sublinear: bool = False, id_column: str = "review_id"
) -> DataFrame:
    """(id, term, weight) by joining term rows to a vocabulary (term, df).

    The vocabulary is a ``Lookup``: broadcast if it is measured to be small, else
    joined with salted terms. Unknown terms vanish. One shuffle brings a review's
    weights together.
    """
    lookup = Lookup(vocabulary.select("term", "df"), "term")
    joined = lookup.join(postings, F.col("term"), {"df": "df"}, F.struct(id_column), how="inner")
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    idf = F.log((documents + 1).cast("double") / (F.col("df") + 1).cast("double")) + 1
    raw = joined.select(id_column, "term", (tf * idf).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(id_column)))
    return raw.select(id_column, "term", (F.col("_w") / norm).alias("weight"))


@F.arrow_udf(VectorUDT())
def _as_vector(parts: pa.Array) -> pa.Array:
    """Give a (type, size, indices, values) struct the vector type; data untouched."""
    return parts


def sparse_vector(size: Column, indices: Column, values: Column) -> Column:
    return _as_vector(
        F.struct(
            F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"),
            indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"),
        )
    )


def tfidf_vectors(
    df: DataFrame, tokens: Column, max_n: int, vocabulary: Vocabulary, output: str = "tfidf"
) -> DataFrame:
    """Add unit-length TF-IDF vectors. Map-only; weights stay in the JVM."""
    counts = CountVectorizerModel.from_vocabulary(list(vocabulary.terms), "_terms", "_tf")
    counted = counts.transform(with_terms(df, tokens, max_n, "_terms")).drop("_terms")
    if vocabulary.sublinear:
        part = F.unwrap_udt("_tf")
        logs = F.transform(part["values"], lambda v: 1 + F.log(v))
        counted = counted.withColumn("_tf", sparse_vector(part["size"], part["indices"], logs))
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(vocabulary.idf), inputCol="_tf", outputCol="_w")
    unit = Normalizer(p=2.0, inputCol="_w", outputCol=output)
    return unit.transform(scaled.transform(counted)).drop("_tf", "_w")


def tfidf_rows(
    df: DataFrame, tokens: Column, max_n: int, vocabulary: Vocabulary, id_column: str = "review_id", dealt: bool = False
) -> DataFrame:
    """(id, term, weight) of the vocabulary's terms, unit length per review. Map-only, unless ``dealt``.

    ``dealt`` deals the vectors by id before they become rows, for a join by id: one row a review is shuffled, not one a term.
    """
    part = tfidf_vectors(df, tokens, max_n, vocabulary, "_v").select(id_column, F.unwrap_udt("_v").alias("v"))
    if dealt:
        part = part.repartition(id_column)
    cells = part.select(id_column, F.explode(F.arrays_zip("v.indices", "v.values")).alias("e"))
    names = F.lit(list(vocabulary.terms)) if vocabulary.terms else F.array().cast("array<string>")
    return cells.select(id_column, F.get(names, F.col("e.indices")).alias("term"), F.col("e.values").alias("weight"))
