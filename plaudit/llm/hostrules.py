"""Host-level quality rules: failures by domain, shrunk with an empirical beta prior.

Every document is measured in its own row, with built-in functions only: words,
characters in words, symbols, repeated lines and words in repeated five-word windows.
Windows are found by sorting packed (hash, position) numbers inside the row and
confirmed by comparing the words, so the work is n log n for a text of any length.

Rule failures are then counted by host (partial sums before the shuffle, so a host
with a third of all rows is no hot key). A beta prior is fitted to the hosts' rates by
moments, each host's rate is shrunk towards it, and hosts whose shrunk rate is above
``HOST_LIMIT`` for some rule are rejected as a whole; the verdicts join back to the
documents. Small hosts are thus judged by their rates only as far as their rows allow.

Null and empty texts have no words and fail the length rule. A null host is a host of
its own. Rows with equal doc_id are measured each; null doc_ids stay. Further columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import attach, columns_of, let, stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
RULES = ("short", "repeated", "base_failed")
HOST_LIMIT = 0.5
PRIOR_ROWS = (2.0, 10_000.0)  # bounds of the prior's weight, in documents


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more in the array ``words``."""
    last = F.size(words) - WINDOW
    bits = F.length(F.bin(F.size(words).cast("long"))).cast("int")

    def packed(bits: Column) -> Column:
        def one(i: Column) -> Column:
            mark = F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
            return F.call_function("shiftleft", mark, bits).bitwiseOR(i.cast("long"))

        return F.sort_array(F.transform(F.sequence(F.lit(0), last), one))

    def covered(state: Column) -> Column:
        marks, bits = state["marks"], state["bits"]

        def key(x: Column) -> Column:
            return F.call_function("shiftright", x, bits)

        def at(x: Column) -> Column:
            return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def same(x: Column, y: Column) -> Column:
            return (key(x) == key(y)) & (F.slice(words, at(x) + 1, WINDOW) == F.slice(words, at(y) + 1, WINDOW))

        twice = F.filter(marks, lambda x, j: same(x, F.get(marks, j - 1)) | same(x, F.get(marks, j + 1)))
        places = F.sort_array(F.transform(twice, at))
        start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("before"))
        return F.aggregate(
            places, start,
            lambda s, x: F.struct((s["total"] + F.least(F.lit(WINDOW), x - s["before"])).alias("total"), x.alias("before")),
            lambda s: s["total"],
        )

    found = let(let(bits, lambda b: F.struct(packed(b).alias("marks"), b.alias("bits"))), covered)
    return F.when(last < 0, F.lit(0)).otherwise(found).cast("long")


def _measures(text: Column) -> Column:
    """Struct of all measures of a text that is not null."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            let(lines, lambda held: F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def measure(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the measures and the failed rules of every document; staged, without texts."""
    docs = columns_of(documents, "doc_id", host, "text").toDF("doc_id", "host", "text")
    rows = docs.select("doc_id", "host", _measures(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "host", "m.*")
    short = F.col("n_words") < MIN_WORDS
    repeated = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return stage(rows.withColumns({"short": short, "repeated": repeated, "base_failed": short | repeated}))


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, a shrunk failure rate for every rule, and host_kept."""
    hosts = rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col(rule)).alias(f"n_{rule}") for rule in RULES]
    )
    hosts = stage(hosts)
    rates = {rule: F.col(f"n_{rule}") / F.col("n_docs") for rule in RULES}
    # One row of moments; every host counts once.
    moments = hosts.agg(*[F.avg(r).alias(f"m_{k}") for k, r in rates.items()], *[F.var_pop(r).alias(f"v_{k}") for k, r in rates.items()]).first()
    shrunk = {}
    for rule in RULES:
        mean, spread = moments[f"m_{rule}"] or 0.0, moments[f"v_{rule}"] or 0.0
        weight = mean * (1 - mean) / spread - 1 if spread > 0 else PRIOR_ROWS[1]
        weight = min(max(weight, PRIOR_ROWS[0]), PRIOR_ROWS[1])
        shrunk[f"rate_{rule}"] = (F.col(f"n_{rule}") + mean * weight) / (F.col("n_docs") + weight)
    held = hosts.withColumns(shrunk)
    return held.select("host", "n_docs", *shrunk, (F.greatest(*shrunk) <= limit).alias("host_kept"))


def judge(documents: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the host's shrunk rate of every document."""
    rows = measure(documents, host)
    hosts = stage(host_verdicts(rows).withColumnRenamed("host", "h"))
    joined = attach(rows, hosts, F.col("host").eqNullSafe(F.col("h")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
        F.round("rate_base_failed", 6).alias("host_rate"),
    )
