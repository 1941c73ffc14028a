"""Exact train/test splits, folds and class balance without a global sort.

Rows are ordered by a salted md5 of their id. The hash is uniform, so a count
per (label, hash prefix) finds the prefix in which a wanted rank falls, and
only the rows of that prefix are ranked. The result is a few cut-off hashes
per label; assigning rows to parts is then a map-only comparison.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.rules import FOLDS, IMBALANCE_SHARE, SEED, TEST_PERCENT
from plaudit.sources.readers import small_table

PREFIX_CHARS = 3
# Rows of one (label, prefix) group that a single task may rank.
GROUP_ROWS = 1_000_000
KEY_CHARS = 32  # of an md5


def shuffle_key(id_column: Column, seed: int = SEED) -> Column:
    """Position of a row in the seeded order."""
    return F.md5(F.concat(F.lit(str(seed)), id_column.cast("string")))


def _label_counts(df: DataFrame, label: str) -> dict:
    """Rows of every label; one number for each class."""
    return {row[0]: row["n"] for row in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()}


def _opened(keyed: DataFrame, groups: dict) -> DataFrame:
    """Rows of ``keyed`` (label, key) inside the groups {(label, prefix): ...}, all of one prefix length."""
    chars = len(next(iter(groups))[1])
    table = small_table(
        keyed.sparkSession,
        {"label": [k[0] for k in groups], "prefix": [k[1] for k in groups]},
        f"label {dict(keyed.dtypes)['label']}, prefix string",
    )
    return keyed.withColumn("prefix", F.substring("key", 1, chars)).join(F.broadcast(table), ["label", "prefix"])


def _cutoffs(keyed: DataFrame, ranks: dict) -> dict:
    """The hash at each wanted 1-based rank, per label. ``keyed`` has (label, key).

    Every level counts the next ``PREFIX_CHARS`` characters inside the groups that
    hold a wanted rank, so at most 16 ** PREFIX_CHARS numbers for each wanted rank
    come to the driver, whatever the number of rows.
    """
    wanted = {(label, ""): [(r, r) for r in sorted(set(targets))] for label, targets in ranks.items() if targets}
    chars = 0
    while wanted:
        chars += PREFIX_CHARS
        rows = keyed if chars == PREFIX_CHARS else _opened(keyed, wanted)
        prefix = F.substring("key", 1, chars)
        sizes: dict = defaultdict(list)
        for label, value, n in rows.groupBy("label", prefix.alias("p")).agg(F.count(F.lit(1))).collect():
            sizes[(label, value[: chars - PREFIX_CHARS])].append((value, n))
        deeper: dict = {}
        largest = 0
        for (label, upper), places in wanted.items():
            seen, todo = 0, list(places)
            for value, n in sorted(sizes[(label, upper)]):
                while todo and seen < todo[0][1] <= seen + n:
                    rank, local = todo.pop(0)
                    deeper.setdefault((label, value), []).append((rank, local - seen))
                    largest = max(largest, n)
                seen += n
        wanted = deeper
        if largest <= GROUP_ROWS or chars + PREFIX_CHARS > KEY_CHARS:
            break
    if not wanted:
        return {}
    inside = {(k[0], k[1], local): rank for k, pairs in wanted.items() for rank, local in pairs}
    picks = small_table(
        keyed.sparkSession,
        {"label": [k[0] for k in inside], "prefix": [k[1] for k in inside], "place": [k[2] for k in inside]},
        f"label {dict(keyed.dtypes)['label']}, prefix string, place int",
    )
    place = F.row_number().over(W.partitionBy("label", "prefix").orderBy("key"))
    rows = _opened(keyed, wanted).withColumn("place", place).join(F.broadcast(picks), ["label", "prefix", "place"]).collect()
    return {(r["label"], inside[(r["label"], r["prefix"], r["place"])]): r["key"] for r in rows}


def rank_cutoffs(df: DataFrame, ranks: dict, label: Column, id_column: str, seed: int) -> dict:
    keyed = df.select(label.alias("label"), shuffle_key(F.col(id_column), seed).alias("key"))
    return _cutoffs(keyed, ranks)


def largest_remainder(counts: dict, draws: int) -> dict:
    """Share ``draws`` over the labels in proportion; leftovers to the largest remainders."""
    total = sum(counts.values())
    shares = {k: n * draws // total for k, n in counts.items()}
    left = draws - sum(shares.values())
    order = sorted(counts, key=lambda k: (-(counts[k] * draws % total), k))
    for k in order[:left]:
        shares[k] += 1
    return shares


def stratified_split(
    df: DataFrame, label: str = "label", id_column: str = "review_id", test_percent: int = TEST_PERCENT, seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: an exact share of every label, by seeded hash order."""
    counts = _label_counts(df, label)
    total = sum(counts.values())
    train = total - math.ceil(total * test_percent / 100)
    test = {k: n - m for (k, n), m in zip(counts.items(), largest_remainder(counts, train).values())}
    return _with_test(df, F.col(label), id_column, test, seed)


def plain_split(
    df: DataFrame, id_column: str = "review_id", test_percent: int = TEST_PERCENT, seed: int = SEED
) -> DataFrame:
    """Add ``is_test`` to an exact share of all rows."""
    total = df.count()
    return _with_test(df, F.lit(0), id_column, {0: math.ceil(total * test_percent / 100)}, seed)


def _with_test(df: DataFrame, label: Column, id_column: str, test: dict, seed: int) -> DataFrame:
    cuts = rank_cutoffs(df, {k: [n] if n else [] for k, n in test.items()}, label, id_column, seed)
    key = shuffle_key(F.col(id_column), seed)
    is_test = F.lit(False)
    for (value, _), cut in cuts.items():
        is_test = is_test | (label.eqNullSafe(F.lit(value)) & (key <= cut))
    return df.withColumn("is_test", is_test)


def stratified_folds(
    df: DataFrame, label: str = "label", id_column: str = "review_id", folds: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` 0..folds-1; sizes per label differ by at most one.

    Leftover rows of a label continue the round of the label before, so the
    folds as a whole stay balanced too.
    """
    counts = _label_counts(df, label)
    ranks, start = {}, 0
    for value, n in counts.items():
        sizes = [len(range(start + (f - start) % folds, start + n, folds)) for f in range(folds)]
        start += n
        ends = [sum(sizes[: f + 1]) for f in range(folds - 1)]
        ranks[value] = ends
    # A fold may be empty for a rare label: rank 0 lies before every row.
    cuts = rank_cutoffs(df, {k: [e for e in ends if e] for k, ends in ranks.items()}, F.col(label), id_column, seed)
    key = shuffle_key(F.col(id_column), seed)
    fold = F.when(F.lit(False), 0)
    for value, ends in ranks.items():
        below = F.lit(0)
        for end in ends:
            below = below + ((key > cuts[(value, end)]).cast("int") if end else F.lit(1))
        fold = fold.when(F.col(label).eqNullSafe(F.lit(value)), below)
    return df.withColumn("fold", fold.otherwise(0))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """(labels, rows, minority_rows, minority_share, imbalanced); one label has share 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows"), F.min("n").alias("minority_rows")
    ).select(
        "labels", "rows", "minority_rows",
        F.try_divide("minority_rows", "rows").alias("minority_share"),
        (F.col("minority_rows") / F.col("rows") < IMBALANCE_SHARE).alias("imbalanced"),
    )
