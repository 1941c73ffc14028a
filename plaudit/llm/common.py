"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.session import shared_dir

_stages: dict[str, list[str]] = {}


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns spelt exactly like ``names``, in that order.

    Works by position, so further columns (also ones that differ only in case)
    never clash with names that an operator gives to its own columns.
    """
    places = [df.columns.index(name) for name in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in zip(places, names)])


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and go on from the files.

    Survives lost executors, and later readers scan only their columns.
    ``drop_stages`` deletes what a session has staged.
    """
    path = new_stage(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_stage(spark: SparkSession) -> str:
    """An unused path in the shared folder, deleted by ``drop_stages``."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    _stages.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession) -> None:
    """Delete staged tables; call it once their results have been written."""
    for path in _stages.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


SLICE_ROWS = 1_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that what is made of a part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        pa.default_memory_pool().release_unused()


def map_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]], keep: list[str], schema: str
) -> DataFrame:
    """Add computed columns to Arrow batches, keeping the columns ``keep``.

    ``make()`` runs once per task and returns the function applied to batches.
    """
    fields = ", ".join([*(f"`{name}` {kind}" for name, kind in df.dtypes if name in keep), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict({name: part.column(name) for name in keep} | work(part))

    ordered = [name for name, _ in df.dtypes if name in keep]
    if ordered != keep:
        raise ValueError("keep must follow the order of the columns")
    return df.mapInArrow(run, fields)


# --- words and shingles as 64-bit numbers, whole arrays at a time -----------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {}


def _power_table(base: np.uint64, size: int) -> np.ndarray:
    table = _powers.get(int(base))
    if table is None or len(table) < size:
        room = max(1 << 16, 1 << int(size - 1).bit_length())
        table = np.full(room, base, dtype=np.uint64)
        table[0] = 1
        table = _powers[int(base)] = np.multiply.accumulate(table)
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of ``codes``, by prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(codes) + 1)[: len(codes)], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * _power_table(_INVERSE, len(codes) + 1)[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * _MIX2)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 1 << 18


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row bounds in them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, bounds.astype(np.int64)


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes of every row, some rows at a time: (first row, hashes, row bounds).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Rows are put
    together until they fill ``CHUNK_BYTES``; a longer text is a chunk of its own.
    """
    raw, bounds = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        codes = _LOWER[raw[bounds[first] : bounds[last]]]
        rows = bounds[first : last + 1] - bounds[first]
        cuts = rows[:-1][rows[:-1] < len(codes)]
        inside = ~_SPACE[codes]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begins[cuts] = inside[cuts]
        before = cuts[cuts > 0] - 1
        closes[before] = inside[before]
        starts = np.flatnonzero(begins)
        yield first, span_hashes(codes, starts, np.flatnonzero(closes) + 1), np.searchsorted(starts, rows)
        first = last


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its runs of ``size`` words.

    A row of fewer words has its whole sequence as one run; no words, no runs.
    """
    for _, words, rows in word_hashes(column):
        n = max(len(words) - size + 1, 0)
        value = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            value += words[i : i + n] * np.uint64(pow(int(_BASE), i + 1, 1 << 64))
        value = mix64(value)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= size:
                found = np.sort(value[a : b - size + 1])
                yield found[np.concatenate((_TRUE, found[1:] != found[:-1]))]
            elif b > a:
                yield mix64(np.array([_fold(words[a:b].tolist())], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


_TRUE = np.ones(1, dtype=bool)


def _fold(words: list[int]) -> int:
    value = len(words)
    for word in words:
        value = (value * int(_BASE) + word) % (1 << 64)
    return value


_LOWER_CODES = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0xD800)], dtype=np.uint32)


def lower_codes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lower-case code points of every row, some rows at a time: (first row, codes, row of each code).

    A zero stands before every row and after the last one.
    """
    raw, bounds = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        part = raw[bounds[first] : bounds[last]]
        codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        low = codes < len(_LOWER_CODES)
        lower = np.where(low, _LOWER_CODES[np.where(low, codes, 0)], codes)
        leads = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum((part & 0xC0) != 0x80)))
        sizes = np.diff(leads[bounds[first : last + 1] - bounds[first]])
        row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        out = np.zeros(len(codes) + len(sizes) + 1, dtype=np.uint32)
        out[np.arange(len(codes)) + row + 1] = lower
        rows = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes + 1)
        yield first, out, np.concatenate((rows, rows[-1:]))
        first = last


BROADCAST_ROWS = 100_000


def attach(many: DataFrame, few: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join a table of parameters: broadcast only if its rows, counted here, are few.

    Beyond ``BROADCAST_ROWS`` it is an ordinary shuffle join, whose hot keys
    adaptive execution splits.
    """
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    return many.join(few, on, how)
