"""Training-order materialisation: token sequences at permuted slots of fixed-stride shards.

1. Every text is encoded, an end token added, and cut into sequences of at most
   ``length`` tokens. The sequences are staged with a running number inside their
   task; the tasks' totals turn it into one number from 0 to n - 1.
2. A keyed Feistel network over the smallest even number of bits that holds n,
   walked again while its value is n or more, is a bijection of 0..n-1: the slot.
3. Slots are dealt out by range, one exchange, and each range writes its shards of
   ``shard_size`` sequences. A sequence takes ``2 * length`` bytes (little-endian
   16-bit token numbers, then padding), so slot s stands in shard s // shard_size at
   byte (s % shard_size) * stride, and reading can go on from any slot.

Everything is spread by slots, which are uniform whatever the sources or copies are.
The same files and seed give the same order. Null and empty texts are one sequence
with the end token only; rows without a doc_id keep null; repeated rows get slots of
their own. Empty tables make no shards. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaudit.llm.bpe import encoder
from plaudit.llm.common import attach, columns_of, slices, stage

PAD = 0xFFFF
ROUNDS = 6


@dataclass(frozen=True)
class OrderConfig:
    vocabulary: str  # path of the vocabulary file on every executor
    length: int = 1024
    shard_size: int = 1024
    seed: int = 42


SHARD_SCHEMA = (
    "shard long, first_slot long, payload binary, doc_ids array<long>, seq_nos array<int>, n_tokens array<int>"
)


def feistel(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The slot of every number in 0..n-1: a keyed permutation of that range."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)

    def once(value: np.ndarray) -> np.ndarray:
        left, right = value >> half, value & mask
        for key in keys:
            mixed = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << half) | right

    slot = once(index.astype(np.uint64))
    while len(out := np.flatnonzero(slot >= np.uint64(n))):
        slot[out] = once(slot[out])
    return slot.astype(np.int64)


def sequences(documents: DataFrame, config: OrderConfig) -> DataFrame:
    """Staged rows (part, local, doc_id, seq_no, n_tokens, tokens) of all sequences."""
    length, path = config.length, config.vocabulary

    def cut(batches):
        encode = encoder(path)
        part, local = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, row = batch.column("doc_id").to_pylist(), 0
            for tokens, bounds in encode.encode(batch.column("text")):
                out = {"doc_id": [], "seq_no": [], "n_tokens": [], "tokens": []}
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    whole = np.append(tokens[a:b], np.uint16(encode.vocabulary)).astype("<u2")
                    for no, at in enumerate(range(0, len(whole), length)):
                        piece = whole[at : at + length]
                        out["doc_id"].append(ids[row])
                        out["seq_no"].append(no)
                        out["n_tokens"].append(len(piece))
                        out["tokens"].append(piece.tobytes())
                    row += 1
                count = len(out["tokens"])
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(count, part, dtype=np.int32)),
                    "local": pa.array(np.arange(local, local + count)),
                    "doc_id": pa.array(out["doc_id"], pa.int64()), "seq_no": pa.array(out["seq_no"], pa.int32()),
                    "n_tokens": pa.array(out["n_tokens"], pa.int32()), "tokens": pa.array(out["tokens"], pa.binary()),
                })
                local += count

    schema = "part int, local long, doc_id long, seq_no int, n_tokens int, tokens binary"
    return stage(columns_of(documents, "doc_id", "text").mapInArrow(cut, schema))


def with_slots(rows: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """The sequences with their global slot, and how many there are."""
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row for each task of the encoding pass.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stage(totals.withColumn("base", F.coalesce(F.sum("n").over(upto), F.lit(0))))
    n = base.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, seed))

    bases = base.select(F.col("part").alias("p"), "base")
    numbered = attach(rows, bases, F.col("part") == F.col("p"), "inner")
    return numbered.withColumn("slot", slot(F.col("local") + F.col("base"))).drop("part", "p", "local", "base"), n


def write_shards(documents: DataFrame, path: str, config: OrderConfig) -> int:
    """Write all sequences of ``documents`` as shards under ``path``; returns their number."""
    spark = documents.sparkSession
    rows, n = with_slots(sequences(documents, config), config.seed)
    size, length = config.shard_size, config.length
    shards = -(-n // size)
    ranges = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = rows.repartitionById(ranges, F.floor(F.floor(F.col("slot") / size) * ranges / max(shards, 1)).cast("int"))

    def shard(number: int, held: dict[str, list]) -> pa.RecordBatch:
        payload = b"".join(t.ljust(2 * length, b"\xff") for t in held["tokens"])
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([number], pa.int64()), "first_slot": pa.array([number * size], pa.int64()),
            "payload": pa.array([payload], pa.binary()), "doc_ids": pa.array([held["doc_id"]], pa.list_(pa.int64())),
            "seq_nos": pa.array([held["seq_no"]], pa.list_(pa.int32())),
            "n_tokens": pa.array([held["n_tokens"]], pa.list_(pa.int32())),
        })

    def pack(batches):
        current, held = None, {}
        for batch in batches:
            number = np.asarray(batch.column("slot")) // size
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if number[a] != current:
                    if current is not None:
                        yield shard(current, held)
                    current, held = int(number[a]), {"tokens": [], "doc_id": [], "seq_no": [], "n_tokens": []}
                for name, values in held.items():
                    values.extend(batch.column(name).slice(a, b - a).to_pylist())
        if current is not None:
            yield shard(current, held)

    # Rows of one range arrive in slot order, so a task holds one shard at a time.
    dealt.sortWithinPartitions("slot").mapInArrow(pack, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)
    return n


def read_slots(spark: SparkSession, path: str, config: OrderConfig, start: int = 0, stop: int | None = None) -> DataFrame:
    """Sequences of the slots from ``start`` to before ``stop``: slot, shard, byte_offset, doc_id, seq_no, n_tokens, tokens.

    Only shards that hold wanted slots are read; a reader that ended at slot s goes on with ``start=s``.
    """
    size, stride = config.shard_size, 2 * config.length
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).filter(F.col("shard") >= start // size)
    if stop is not None:
        shards = shards.filter(F.col("shard") <= (stop - 1) // size)

    def records(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                held = batch.slice(row, 1)
                payload = held.column("payload")[0].as_buffer()
                ids, nos, sizes = (held.column(name)[0].values for name in ("doc_ids", "seq_nos", "n_tokens"))
                at = np.arange(len(ids))
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(held.column("first_slot")[0].as_py() + at),
                    "shard": pa.array(np.full(len(at), held.column("shard")[0].as_py())),
                    "byte_offset": pa.array(at * stride), "doc_id": ids, "seq_no": nos, "n_tokens": sizes,
                    "tokens": pa.array([payload[o : o + 2 * k].to_pybytes() for o, k in zip((at * stride).tolist(), sizes.to_pylist())], pa.binary()),
                })

    found = shards.select("shard", "first_slot", "payload", "doc_ids", "seq_nos", "n_tokens").mapInArrow(
        records, "slot long, shard long, byte_offset long, doc_id long, seq_no int, n_tokens int, tokens binary"
    )
    wanted = F.col("slot") >= start
    return found.filter(wanted if stop is None else wanted & (F.col("slot") < stop))
