"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most ``max_repeats``
times what it has; what is above goes to the other sources by weight. A document
is wanted ``target / source size`` times: the whole part is taken for certain, the
rest is the inclusion probability of a sample without replacement. Documents are
ranked by random odds divided by inclusion odds (Rosen 1997) and taken in that
order for as long as they fit into the words that are left. Where the next document is
too long, later and shorter ones fill what remains, ``FILLS`` times.

* The random number of a document is a hash of seed, doc_id and text: reruns agree
  on any number of executors.
* No source is ever sorted or gathered as a whole: ranks are found by histograms of
  the key's leading bits, one small aggregate for each level, so a source with a
  third of all rows costs no task more than another one.
* The outcome is a few cut-offs for each source, and every row decides by itself.
  The text is read twice (sizes, output) and never shuffled.
* Null or blank text: size 0, nothing taken, and ``mix_documents`` drops it unless
  its source is wanted at least once. Null source: a source of its own, last in
  order. Null doc_id: ranked by its text. Rows with equal id and text share a rank
  and are taken together. Empty tables give empty results; other columns are ignored
  (``mix_sizes``) or kept (``mix_documents``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaudit.llm.common import attach, columns_of, stage

LAST_ROWS = 200_000  # rows left in all sources, up to which a task finishes its source
WORD = r"[^\x20\x09-\x0D]+"
_BITS = 14  # of the key for each histogram level; two levels and then exact keys
_KEY_BITS = 42


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """source, source_size, target of every source; ``weights`` repeat along the sources in code point order."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source from here on.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.get(F.array(*map(F.lit, map(float, weights))), rank % len(weights)))
    most = (max_repeats * F.col("source_size")).cast("double")
    by_ratio = Window.orderBy(most / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # Level at which the target sits if exactly the sources before this one are full.
    left = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (left - F.coalesce(F.sum(most).over(upto), F.lit(0.0))) / F.sum("w").over(onward)
    per = per.withColumn("most", most).withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The first level that its own source can hold is the final one.
    final = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("target", F.least("most", F.coalesce(final, F.max("level").over(everywhere)) * F.col("w"))).select(
        "source", "source_size", "target"
    )


def _key(doc_id: Column, text_key: Column, share: Column, seed: int) -> Column:
    """Rank key: odds of a hash divided by the odds of inclusion, squeezed into 42 bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text_key), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    value = u * (1 - share) / (u * (1 - share) + (1 - u) * share)
    return F.least(F.floor(value * float(1 << _KEY_BITS)), F.lit((1 << _KEY_BITS) - 1)).cast("long")


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    named = plan.withColumnRenamed("source", "p_source")
    return attach(rows, named, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")


def _prefix(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """Per source the last key whose running sum of sizes still fits into ``room``.

    ``rows``: source, key, size. ``budget``: source, room. Returns source, cut, used and stop;
    cut is null where not even the first key fits, stop is the first key that does not.
    """
    state = budget.select("source", "room", F.lit(0).cast("long").alias("head"), F.lit(0).cast("long").alias("used"),
                          F.lit(None).cast("long").alias("cut"))
    for shift in (_KEY_BITS - _BITS, _KEY_BITS - 2 * _BITS, 0):
        width = {0: _KEY_BITS - 2 * _BITS}.get(shift, _BITS)
        here = _planned(rows, state)
        inside = here.filter(F.shiftright("key", shift + width) == F.col("head"))
        summed = inside.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.first("room").alias("room"), F.first("used").alias("used"), F.first("cut").alias("cut")
        )
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) + F.col("used")
        placed = summed.withColumn("running", running)
        fits = F.col("running") <= F.col("room")
        last = (F.shiftleft(F.col("bucket") + 1, shift) - 1)
        # Whole buckets that fit move the cut; the first that does not is opened on the next level.
        state = stage(placed.groupBy("source").agg(
            F.first("room").alias("room"),
            F.min(F.when(~fits, F.col("bucket"))).alias("head"),
            F.coalesce(F.max(F.when(fits, F.col("running"))), F.first("used")).alias("used"),
            F.coalesce(F.max(F.when(fits, last)), F.first("cut")).alias("cut"),
        ))
        # A source whose rows all fit is done: no head matches it on later levels.
        level = state.withColumn("stop", F.lit(None).cast("long") if shift else F.col("head"))
        done = level if shift == _KEY_BITS - _BITS else done.unionByName(level)
    return done.groupBy("source").agg(F.max("cut").alias("cut"), F.max("used").alias("used"), F.max("stop").alias("stop"))


def last_steps(key: np.ndarray, size: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The steps (cut, limit) that the rounds would take over all rows left of a source."""
    key, at = np.unique(key, return_inverse=True)
    rows = np.stack((at, size), axis=1)
    steps: list[tuple[int, int]] = []
    while True:
        rows = rows[rows[:, 1] <= room]
        if not len(rows):
            return steps
        sums = np.bincount(rows[:, 0], weights=rows[:, 1], minlength=len(key)).astype(np.int64)
        upto = np.cumsum(sums)
        over = np.flatnonzero((upto > room) & (sums > 0))
        if not len(over):
            return [*steps, (int(key[rows[:, 0].max()]), room)]
        stop = int(over[0])
        taken = int(upto[stop] - sums[stop])
        if taken:
            last = int(rows[rows[:, 0] < stop, 0].max())
            steps.append((int(key[last]), room))
            room -= taken
        else:
            last = stop  # rows of one key that do not fit together are passed over
            steps.append((int(key[last]), -1))
        rows = rows[rows[:, 0] > last]


def _with_last(plan: DataFrame, left: DataFrame) -> DataFrame:
    """The plan with its last steps, from at most ``LAST_ROWS`` rows of all sources."""
    kind = dict(left.dtypes)["source"]

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        steps = last_steps(rows["key"].to_numpy(), rows["size"].to_numpy(), int(rows["room_now"].iloc[0]))
        return pd.DataFrame({"f_source": rows["source"].iloc[:1], "more": [[{"cut": c, "limit": m} for c, m in steps]]})

    schema = f"f_source {kind}, more array<struct<cut:bigint,limit:bigint>>"
    named = stage(left.groupBy("source").applyInPandas(work, schema))
    steps = F.concat("steps", F.coalesce("more", F.array().cast("array<struct<cut:bigint,limit:bigint>>")))
    joined = plan.join(named, F.col("source").eqNullSafe(F.col("f_source")), "left")
    return stage(joined.withColumn("steps", steps).drop("f_source", "more", "room"))


def plan_mix(sizes: DataFrame, weights: Sequence[float], max_repeats: int, seed: int) -> DataFrame:
    """Cut-offs for each source from ``sizes`` (doc_id, source, size, text_key).

    Columns: source, source_size, target, whole (certain copies), share (inclusion
    probability of one more) and steps, an array of (cut, limit): documents of at
    most ``limit`` words with keys after the previous cut and up to ``cut``. Rounds go on
    until no further document fits; each begins behind the keys of the one before. Once few
    rows are left, a task finishes the rounds of its source.
    """
    targets = source_targets(sizes, weights, max_repeats)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = stage(
        targets.withColumn("whole", F.floor(wanted).cast("int"))
        .withColumn("share", wanted - F.floor(wanted))
        .withColumn("room", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .withColumn("steps", F.array().cast("array<struct<cut:bigint,limit:bigint>>"))
    )
    keyed = _planned(sizes, plan.select("source", "share")).filter((F.col("share") > 0) & (F.col("size") > 0))
    keyed = stage(keyed.select("source", "size", _key(F.col("doc_id"), F.col("text_key"), F.col("share"), seed).alias("key")))
    while True:
        known = plan.select("source", "room", F.coalesce(F.try_element_at("steps", F.lit(-1))["cut"], F.lit(-1)).alias("from"))
        left = _planned(keyed, known.withColumnRenamed("room", "room_now"))
        left = left.filter((F.col("key") > F.col("from")) & (F.col("size") <= F.col("room_now")))
        left = stage(left.select("source", "size", "key", "room_now"))
        rows = left.count()
        if not rows:
            return plan.drop("room")
        if rows <= LAST_ROWS:
            return _with_last(plan, left)
        found = stage(_prefix(left.select("source", "size", "key"), plan.select("source", "room")))
        named = found.select(F.col("source").alias("f_source"), "cut", "used", "stop")
        # Rows of one key that do not fit together are passed over.
        step = F.when(F.col("cut").isNotNull(), F.struct(F.col("cut"), F.col("room").alias("limit"))).otherwise(
            F.struct(F.col("stop").alias("cut"), F.lit(-1).cast("long").alias("limit"))
        )
        plan = stage(
            plan.join(named, F.col("source").eqNullSafe(F.col("f_source")), "left")
            .withColumn("steps", F.when(F.col("used").isNotNull(), F.concat("steps", F.array(step))).otherwise(F.col("steps")))
            .withColumn("room", F.col("room") - F.when(F.col("cut").isNotNull(), F.col("used")).otherwise(0))
            .drop("f_source", "cut", "used", "stop")
        )


def _copies(size: Column, key: Column) -> Column:
    """Times a row is taken, from the plan's columns."""
    before = F.transform(
        F.col("steps"),
        lambda s, i: (size <= s["limit"]) & (key <= s["cut"]) & (key > F.coalesce(F.get("steps", i - 1)["cut"], F.lit(-1))),
    )
    more = (F.col("share") > 0) & (size > 0) & F.exists(before, lambda b: b)
    return F.col("whole") + F.when(more, 1).otherwise(0)


def document_sizes(documents: DataFrame) -> DataFrame:
    """The narrow table that a plan is made from; written once, without the texts."""
    docs = columns_of(documents, "doc_id", "source", "text")
    return stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key")))


def mix_sizes(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """doc_id, size, source_size, target and taken (words with repeats) of every document."""
    rows = _planned(sizes, plan)
    key = _key(F.col("doc_id"), F.col("text_key"), F.col("share"), seed)
    return rows.withColumn("key", key).select(
        "doc_id", "size", "source_size", "target", (_copies(F.col("size"), F.col("key")) * F.col("size")).cast("long").alias("taken")
    )


def mix_documents(documents: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows of ``documents``, each as often as the mix takes it."""
    names = documents.columns
    at = {name: f"c{names.index(name)}" for name in ("doc_id", "source", "text")}
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))]).withColumns({
        "source": F.col(at["source"]), "size": size_of(F.col(at["text"])), "text_key": F.xxhash64(at["text"]),
    })
    rows = _planned(plain, plan)
    rows = rows.withColumn("key", _key(F.col(at["doc_id"]), F.col("text_key"), F.col("share"), seed))
    rows = rows.withColumn("copies", _copies(F.col("size"), F.col("key"))).filter("copies > 0")
    repeated = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
