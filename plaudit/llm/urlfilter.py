"""URL filters: captures judged by the list entries that were active when they were fetched.

A list is a log of dated events (list, kind, pattern, day, action). Per entry the events
become validity intervals [from, until), and every capture is joined as of its fetch
day: a domain entry meets the host and all its subdomains, a prefix entry all paths
below it, a url entry one address.

* Intervals of one entry never overlap, so a capture meets an entry at most once.
* Each capture looks up its own host suffixes and path prefixes: an equality join, with
  the days as a further condition, and no comparison with all entries. A capture has
  few keys, and distinct (url, day) pairs are judged once.
* The entries are broadcast only if they are few when counted; else the join is a
  shuffle join in which a host with a third of all captures is split by adaptive
  execution.

Addresses are compared without scheme, user, port, query and fragment, in lower case for
the host only. Null or empty urls and null days meet nothing and pass. Events with any null
are ignored; of several on one day an ``add`` wins; repeated events and an ``add`` within
an interval change nothing. Repeated captures get equal verdicts; other columns of the
captures stay unless they carry a verdict's name. Empty tables: nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaudit.llm.common import attach, columns_of, let, stage

_ADDRESS = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)"


def intervals_of(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, from_day, until_day) in which entries are active; until_day null: still."""
    log = columns_of(events, "list", "kind", "pattern", "day", "action").na.drop()
    daily = log.groupBy("list", "kind", "pattern", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    entry = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    turns = daily.withColumn("was", F.coalesce(F.lag("on").over(entry), F.lit(0))).filter("`on` <> was")
    until = F.lead("day").over(entry)
    return turns.withColumn("until_day", until).filter("`on` = 1").select("list", "kind", "pattern", F.col("day").alias("from_day"), "until_day")


def host_and_path(url: Column) -> tuple[Column, Column]:
    return F.lower(F.regexp_extract(url, _ADDRESS, 1)), F.regexp_extract(url, _ADDRESS, 2)


def _keys(url: Column) -> Column:
    """All (kind, pattern) that could block an address."""
    host, path = host_and_path(url)

    def suffixes(labels: Column) -> Column:
        many = F.sequence(F.lit(1), F.size(labels))
        return F.transform(many, lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))

    def prefixes(steps: Column) -> Column:
        many = F.sequence(F.lit(1), F.size(steps))
        return F.transform(many, lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")).alias("pattern")))

    address = F.concat(host, path)
    exact = F.array(F.struct(F.lit("url").alias("kind"), address.alias("pattern")))
    # The last step is what follows the last slash and is not a folder.
    folders = F.split(F.regexp_extract(address, "^(.*)/[^/]*$", 1), "/")
    named = F.concat(let(F.split(host, r"\."), suffixes), let(folders, prefixes), exact)
    return F.when(host != "", F.array_distinct(named))


def judge_captures(captures: DataFrame, intervals: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with blocked, lists (names) and since (earliest active entry's day)."""
    pairs = columns_of(captures, url, day).toDF("u", "d").na.drop().distinct()
    asked = stage(pairs).select("u", "d", F.explode(_keys(F.col("u"))).alias("k")).select("u", "d", "k.*")
    entries = stage(intervals.select(F.col("kind").alias("e_kind"), F.col("pattern").alias("e_pattern"), "list", "from_day", "until_day"))
    on = (F.col("kind") == F.col("e_kind")) & (F.col("pattern") == F.col("e_pattern")) & (F.col("from_day") <= F.col("d"))
    on = on & (F.col("until_day").isNull() | (F.col("d") < F.col("until_day")))
    met = attach(asked, entries, on, "inner").groupBy("u", "d").agg(
        F.sort_array(F.collect_set("list")).alias("met_lists"), F.min("from_day").alias("met_since")
    )
    met = stage(met)
    others = [c for c in captures.columns if c.lower() not in ("blocked", "lists", "since")]
    plain = columns_of(captures, *others).toDF(*[f"c{i}" for i in range(len(others))])
    here = (F.col(f"c{others.index(url)}") == F.col("u")) & (F.col(f"c{others.index(day)}") == F.col("d"))
    joined = attach(plain, met, here)
    return joined.select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(others)],
        F.col("met_lists").isNotNull().alias("blocked"),
        F.coalesce("met_lists", F.array().cast("array<string>")).alias("lists"), F.col("met_since").alias("since"),
    )
