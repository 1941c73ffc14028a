"""From raw documents to training order: five stages, each working on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet in the shared folder and reads it back as the next stage's documents.

* toxicity: fits on labelled rows outside the held-out part, drops what scores 0.3 or more.
* jaccard: keeps one document of every group of near copies (the smallest doc_id).
* decontamination: drops documents that hold a benchmark window.
* mixing: repeats, keeps or leaves out documents so that sources come near their targets.
* order: writes the token sequences at their slots and returns one row for each.

Nulls, empty texts, ties, repeated rows and further columns are handled as the stages'
modules say; all but the last return the columns of ``documents``. An empty table runs
through to an empty order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plaudit.llm import catalog, decontaminate, jaccard, mixing, toxicity
from plaudit.llm.common import stage

# The tokenizer, hash orders and fitted weights have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, catalog.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, catalog.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(mixing.document_sizes(docs), catalog.SOURCE_WEIGHTS, catalog.MAX_REPEATS, catalog.MIX_SEED)
    return mixing.mix_documents(docs, plan, catalog.MIX_SEED)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return catalog.ordered(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("order", training_order),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for _, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
