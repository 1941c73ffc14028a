"""Incremental scoring of CSV files dropped into a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.session import staged
from plaudit.sources.readers import clean_records, csv_options, csv_schema, reviews_for_scoring


def read_drops(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int = 100) -> DataFrame:
    """New CSV files of ``folder`` as a stream, read and cleaned like a batch; with ``source_file``."""
    raw = spark.readStream.schema(csv_schema(columns)).options(**csv_options()).option("maxFilesPerTrigger", files_per_batch)
    return clean_records(raw.csv(folder), columns, F.col("_metadata.file_path").alias("source_file"))


def score_drops(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    score: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    files_per_batch: int = 100,
) -> None:
    """Score the files not seen before and append the rows to Parquet; then stop.

    Each micro-batch is an ordinary batch job (``score`` shuffles per review).
    A batch is written under its own number, so a batch repeated after a
    failure replaces its first attempt.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        # Ids are fixed by writing the rows once; the batch number keeps them apart between batches.
        place = F.xxhash64(F.lit(number), "source_file", F.monotonically_increasing_id())
        numbered = staged(batch.withColumn("review_id", place).drop("source_file"))
        score(reviews_for_scoring(numbered)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = (
        read_drops(spark, folder, columns, files_per_batch)
        .writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
