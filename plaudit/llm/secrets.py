"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of the text). The ledger
holds one row for each (blob, rule version) that was ever scanned, with its findings.
A run takes the distinct blobs of its paths, leaves out the pairs that the ledger has,
scans the others once each, and joins findings back to all paths of a blob.

* Copies are merged before the shuffle, so a blob under a third of all paths is moved
  once for each task, and scanned once.
* Only blobs with findings take part in the join back to the paths.
* Texts are scanned whole. Null is an empty text. A null doc_id stays; repeated rows get
  equal findings; other columns are ignored. Empty tables give empty ledgers and results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import attach, columns_of, map_columns, stage


@dataclass(frozen=True)
class Rule:
    """``pattern`` is found leftmost and without overlap; matches of a shorter ``group`` are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))

# The base rules, in the order that breaks ties between equal starts.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", r"://[^\s:/@]{1,64}:[^\s:/@]{1,128}@"),
    Rule("service_key", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
)
VERSIONS = {"base-1": BASE, "more-1": MORE}
KINDS = [rule.kind for rules in VERSIONS.values() for rule in rules]
FINDINGS = "array<struct<start:int,kind:string,stop:int>>"
LEDGER = f"blob string, version string, findings {FINDINGS}"


def spans_of(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all findings, in code points."""
    return [
        (m.start(), rule.kind, m.end())
        for rule in rules for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least
    ]


def paths_of(documents: DataFrame) -> DataFrame:
    """doc_id, blob and text of every row; null texts are empty."""
    docs = columns_of(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("blob", F.sha2("text", 256))


def scan_unseen(paths: DataFrame, ledger: DataFrame | None, versions: dict[str, tuple[Rule, ...]]) -> DataFrame:
    """New ledger rows: every (blob, version) of ``paths`` that ``ledger`` does not have."""
    blobs = paths.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("todo", F.array(*map(F.lit, versions)))
    else:
        # Keys first, so that texts of known blobs are never moved.
        wanted = F.explode(F.array(*map(F.lit, versions))).alias("version")
        unseen = paths.select("blob").distinct().select("blob", wanted).join(ledger.select("blob", "version"), ["blob", "version"], "left_anti")
        unseen = stage(unseen.groupBy("blob").agg(F.sort_array(F.collect_list("version")).alias("todo")))
        known = unseen.withColumnRenamed("blob", "b")
        fresh = attach(paths, known, F.col("blob") == F.col("b"), "inner")
        todo = fresh.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))

    def make():
        def work(batch):
            rows = []
            for text, names in zip(batch.column("text").to_pylist(), batch.column("todo").to_pylist()):
                rows.append([
                    {"version": name, "findings": [dict(zip(("start", "kind", "stop"), s)) for s in spans_of(text, versions[name])]}
                    for name in names
                ])
            finding = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())])
            return {"scanned": pa.array(rows, pa.list_(pa.struct([("version", pa.string()), ("findings", pa.list_(finding))])))}

        return work

    scanned = map_columns(todo, make, ["blob", "text", "todo"], f"scanned array<struct<version:string,findings:{FINDINGS}>>")
    return scanned.select("blob", F.explode("scanned").alias("s")).select("blob", "s.version", "s.findings")


def findings_of(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """doc_id and all findings (of every version in the ledger, by start and then kind) of every path."""
    rank = F.create_map(*[x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))])
    held = ledger.filter(F.size("findings") > 0).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    sorted_ = F.array_sort(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), F.get(F.array(rank), F.lit(0))[f["kind"]].alias("rank"), f["kind"].alias("kind"), f["stop"].alias("stop"))))
    held = stage(held.select(F.col("blob").alias("b"), sorted_.alias("findings")))
    return attach(paths.select("doc_id", "blob"), held, F.col("blob") == F.col("b")).select("doc_id", "findings")


def digest(findings: Column) -> Column:
    """kind:start:end of all findings, comma-joined."""
    named = F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string")))
    return F.coalesce(F.array_join(named, ","), F.lit(""))


def report(findings: DataFrame) -> DataFrame:
    """The findings of every path as counts and digests."""
    base = F.filter("findings", lambda f: f["kind"].isin([rule.kind for rule in BASE]))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("findings", lambda f: f["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    return findings.select(
        "doc_id", *[count(rule.kind) for rule in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("findings")).alias("spans")
    )
