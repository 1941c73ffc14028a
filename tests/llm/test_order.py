from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from edge import edge_docs, empty_docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from plaudit.llm import catalog, order
from plaudit.llm.bpe import encoder
from plaudit.llm.common import columns_of, new_stage

VOCABULARY = catalog.VOCABULARY


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abt1 '\n\té.½漢😀srevl_  　", max_size=40), min_size=1, max_size=5))
def test_tokens_equal_the_library(texts):
    encode = encoder(VOCABULARY)
    got = [tokens[a:b].tolist() for tokens, cuts in encode.encode(pa.array(texts)) for a, b in zip(cuts[:-1], cuts[1:])]
    assert got == [encode._library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_slots_are_a_keyed_permutation(n):
    slots = order.feistel(np.arange(n), n, 42)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 16:
        assert slots.tolist() != order.feistel(np.arange(n), n, 43).tolist()


def test_shards_round_trip_and_resume(spark):
    config = order.OrderConfig(VOCABULARY, length=16, shard_size=8)
    path = new_stage(spark)
    n = order.write_shards(edge_docs(spark).repartition(3), path, config)
    every = sorted(order.read_slots(spark, path, config).collect())
    assert [r.slot for r in every] == list(range(n))
    assert all(r.shard == r.slot // 8 and r.byte_offset == (r.slot % 8) * 32 and len(r.tokens) == 2 * r.n_tokens for r in every)
    encode = encoder(VOCABULARY)
    wanted, got = [], {}
    for doc_id, text, *_ in rows():
        wanted.append((doc_id, tuple([*encode._library.encode_ordinary(text or ""), encode.vocabulary])))
    for r in every:
        got.setdefault((r.doc_id, r.seq_no), []).append(np.frombuffer(bytes(r.tokens), "<u2").tolist())
    pieces = sorted((str(i), k // 16, list(t[k : k + 16])) for i, t in wanted for k in range(0, len(t), 16))
    assert pieces == sorted((str(i), no, piece) for (i, no), held in got.items() for piece in held)
    later = sorted(order.read_slots(spark, path, config, 21, 30).collect())
    assert later == every[21:30]


def test_same_input_same_order(spark, tmp_path):
    config = order.OrderConfig(VOCABULARY, length=64, shard_size=4)
    columns_of(edge_docs(spark), "doc_id", "text").coalesce(2).write.parquet(str(tmp_path / "d"))
    runs = []
    for _ in range(2):
        path = new_stage(spark)
        order.write_shards(spark.read.parquet(str(tmp_path / "d")), path, config)
        runs.append(sorted(order.read_slots(spark, path, config).collect()))
    assert runs[0] == runs[1]


def test_empty_table(spark):
    assert catalog.ordered(empty_docs(spark)).count() == 0
