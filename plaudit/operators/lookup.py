"""Joins of many token rows to a lookup table whose size is measured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.sources.readers import small_table

MAX_ROWS = 200_000
MAX_BYTES = 64 << 20
# Keys that may also be named inside an expression, as a hash set.
MAX_LISTED = 20_000
SALTS = 16


def _one_row_each(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    known = df.select(key, *columns).na.drop(subset=[key])
    if not columns:
        return known.distinct()
    best = known.groupBy(key).agg(F.max(F.struct(*columns)).alias("_v"))
    return best.select(key, *[F.col(f"_v.{c}").alias(c) for c in columns])


class Lookup:
    """A table with one row per ``key``, joined by broadcast or with salt.

    A table within ``MAX_ROWS`` and ``MAX_BYTES`` is broadcast. A larger one is
    joined by shuffle: the many side spreads each key over ``SALTS`` values, so
    a key holding a third of all rows is split too, and the lookup side is
    repeated once per salt. The size decides the plan, never the answer: null
    keys are left out and of repeated keys the largest row of values counts.
    """

    def __init__(self, df: DataFrame, key: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> None:
        self.key = key
        self.columns = [c for c in df.columns if c != key]
        df = _one_row_each(df, key, self.columns)
        rows = df.take(max_rows + 1)
        size = sum(len(str(v)) + 16 for row in rows for v in row)
        self.small = len(rows) <= max_rows and size <= max_bytes
        if self.small:
            unique = {row[0]: row for row in rows}
            values = list(zip(*rows)) or [[] for _ in df.columns]
            names = [key, *self.columns]
            schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in names)
            self.df = small_table(df.sparkSession, dict(zip(names, values)), schema)
            listed = len(unique) <= MAX_LISTED and all(isinstance(k, str) for k in unique)
            self.listed = sorted(unique) if listed else None
        else:
            self.df = df
            self.listed = None

    def holds(self, name: str) -> str:
        """SQL test ``name IN (keys)`` for a listed lookup; false for null."""
        if not self.listed:
            return "false"
        words = ", ".join("'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'" for k in self.listed)
        return f"coalesce({name} IN ({words}), false)"

    def join(
        self, many: DataFrame, on: Column, rename: dict[str, str], salt: Column, how: str = "left"
    ) -> DataFrame:
        """Add the lookup columns (renamed by ``rename``) to the rows of ``many``.

        ``rename`` may name the key itself to get a found / not found marker.
        ``salt`` is any expression that varies among rows of one key.
        """
        side = self.df.select(F.col(self.key).alias("_k"), *[F.col(c).alias(n) for c, n in rename.items()])
        if self.small:
            return many.join(F.broadcast(side), on == F.col("_k"), how).drop("_k")
        salted = many.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
        copies = side.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(copies, (on == F.col("_k")) & (F.col("_s") == F.col("_c")), how).drop("_k", "_s", "_c")
