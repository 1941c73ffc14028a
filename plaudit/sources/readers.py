"""Review sources: CSV, text lines, lists and already loaded tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.functions.text import is_blank, strip_text
from plaudit.rules import (
    LABEL_COLUMNS,
    NA_TOKENS,
    TEXT_COLUMNS_SCORING,
    TEXT_COLUMNS_TRAINING,
)

_CORRUPT = "_corrupt"


class SourceError(ValueError):
    """A source that cannot be used, with a short code for the caller."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


SPREAD = "spark.plaudit.spreadFiles"


def spread_file(df: DataFrame) -> DataFrame:
    """Deal the rows of one unsplittable file over the cores, if the session asks for it.

    Only ``local_session`` does, where a table is one row group. Rows are dealt
    round robin, so no later shuffle is saved by it; elsewhere scans stay as they are.
    """
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def small_table(spark: SparkSession, columns: dict[str, Sequence], schema: str | None = None) -> DataFrame:
    """A driver-side list as a local relation, whose exact size Spark knows."""
    return spark.createDataFrame(pa.table({k: list(v) for k, v in columns.items()}), schema=schema)


def _header(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names of the first line, read without scanning the files."""
    names = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False).columns
    return names


def csv_schema(header: Sequence[str]) -> T.StructType:
    """Every column as STRING, and one for the raw text of broken records."""
    return T.StructType([T.StructField(name, T.StringType()) for name in [*header, _CORRUPT]])


def csv_options(multiline: bool = True) -> dict:
    """How batch and stream read CSV. A file whose header has other names or another order is refused."""
    return {
        "pathGlobFilter": "*.csv", "header": True, "quote": '"', "escape": '"', "multiLine": multiline,
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "enforceSchema": False,
    }


def read_csv(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """CSV with header, every column as STRING.

    Records with too many fields are skipped, short ones are kept with nulls,
    and the usual missing-value spellings become null. ``multiline=False``
    lets Spark split large files when no quoted field has a line break. All
    files must have the header of the first; others are an error when read.
    """
    header = _header(spark, path)
    return clean_records(spark.read.schema(csv_schema(header)).options(**csv_options(multiline)).csv(path), header)


def clean_records(raw: DataFrame, header: Sequence[str], *keep: Column) -> DataFrame:
    """Sound records of ``csv_schema(header)`` with missing values as null."""
    last = F.col(f"`{header[-1]}`")
    # A record with too many fields fills the last declared column; so does a
    # sound one, but only broken ones keep their raw text in _corrupt. A long
    # record whose last declared field is empty is told by its comma count.
    fields = F.size(F.split(F.regexp_replace(F.col(_CORRUPT), r'"(?:[^"]|"")*"', ""), ","))
    too_long = F.col(_CORRUPT).isNotNull() & (last.isNotNull() | (fields > len(header)))
    # Filtering on the corrupt column next to data columns is allowed; a scan
    # of the corrupt column alone is not, so all columns stay selected here.
    kept = raw.filter(~too_long)
    return kept.select(*[_null_if_missing(F.col(f"`{name}`")).alias(name) for name in header], *keep)


def _null_if_missing(value):
    return F.when(value.isin(list(NA_TOKENS)), F.lit(None)).otherwise(value)


def scoring_column(columns: Sequence[str]) -> str:
    """First column called review_text, text or review in any case (no trim)."""
    for name in columns:
        if name.lower() in TEXT_COLUMNS_SCORING:
            return name
    raise SourceError("MISSING_COLUMN", "the table needs a 'review_text' column")


def training_columns(columns: Sequence[str]) -> tuple[str, str]:
    """Text and label column by synonym, trimmed and in any case."""
    found: list[str] = []
    for accepted in (TEXT_COLUMNS_TRAINING, LABEL_COLUMNS):
        matches = [name for name in columns if name.lower().strip() in accepted]
        if not matches:
            raise SourceError("MISSING_COLUMN", f"no column named one of {', '.join(accepted)}")
        if len(matches) > 1:
            raise SourceError("AMBIGUOUS_COLUMN", f"several columns match: {', '.join(matches)}")
        found.append(matches[0])
    return found[0], found[1]


def with_review_id(df: DataFrame) -> DataFrame:
    """Number rows in input order; ids grow but have gaps."""
    return df.select(F.monotonically_increasing_id().alias("review_id"), "*")


def reviews_for_scoring(df: DataFrame) -> DataFrame:
    """(review_id, review_text) of any table with a text column; nulls dropped."""
    name = scoring_column(df.columns)
    numbered = df if "review_id" in df.columns else with_review_id(df)
    text = F.col(f"`{name}`").cast("string")
    return numbered.select("review_id", text.alias("review_text")).na.drop(subset=["review_text"])


def read_scoring_csv(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Reviews of uploaded CSV files; only names ending in .csv are accepted."""
    paths = [path] if isinstance(path, str) else path
    for one in paths:
        leaf = one.rstrip("/").rsplit("/", 1)[-1]
        if "." in leaf and not leaf.endswith(".csv"):
            raise SourceError("INVALID_FILE", "only CSV files are accepted")
    try:
        table = read_csv(spark, path, multiline)
    except SourceError:
        raise
    except Exception as error:
        raise SourceError("PARSE_ERROR", "could not parse the CSV file") from error
    found = reviews_for_scoring(table)
    if not found.take(1):
        raise SourceError("EMPTY_DATA", "the CSV file has no valid reviews")
    return found


def labelled_reviews(df: DataFrame) -> DataFrame:
    """(review_id, review_text, label as STRING) by column synonyms, nulls dropped."""
    text, label = training_columns(df.columns)
    numbered = df if "review_id" in df.columns else with_review_id(df)
    return numbered.select(
        "review_id",
        F.col(f"`{text}`").cast("string").alias("review_text"),
        F.col(f"`{label}`").cast("string").alias("label"),
    ).na.drop(subset=["review_text", "label"])


def read_labelled(
    spark: SparkSession, path: str, default_df: DataFrame | None = None, multiline: bool = True
) -> DataFrame:
    """Labelled CSV; ``default_df`` stands in when the file or its columns fail."""
    try:
        return labelled_reviews(read_csv(spark, path, multiline))
    except Exception:
        if default_df is None:
            raise
        return labelled_reviews(default_df)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One review per line, trimmed; blank lines dropped."""
    lines = spark.read.text(path).select(strip_text(F.col("value")).alias("review_text"))
    return with_review_id(lines.filter(F.col("review_text") != ""))


def from_texts(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """A list of texts held by the caller, trimmed, blanks dropped; id is the position."""
    texts = list(texts)
    table = small_table(
        spark, {"review_id": range(len(texts)), "review_text": texts}, "review_id bigint, review_text string"
    )
    kept = table.filter(~is_blank(F.col("review_text")))
    return kept.withColumn("review_text", strip_text(F.col("review_text")))


def guard_rows(df: DataFrame, max_rows: int) -> DataFrame:
    """Refuse empty requests and those of more than ``max_rows`` rows."""
    seen = len(df.limit(max_rows + 1).select(F.lit(1)).collect()) if max_rows < 10_000 else (
        df.limit(max_rows + 1).count()
    )
    if not 1 <= seen <= max_rows:
        raise SourceError("INVALID_SIZE", f"between 1 and {max_rows} reviews are accepted")
    return df
