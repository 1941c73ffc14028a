from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from edge import components, edge_docs, empty_docs, families, rows, shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from plaudit.llm import jaccard
from plaudit.llm.common import shingle_sets
from plaudit.llm.components import connected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x00😀", max_size=30)), max_size=6))
def test_shingle_sets_equal_plain_sets(texts):
    found = list(shingle_sets(pa.array(texts, pa.string()), 5))
    assert [len(f) for f in found] == [len(shingles(t)) for t in texts]
    names = {}
    for text, numbers in zip(texts, found):
        assert names.setdefault(frozenset(shingles(text)), tuple(numbers.tolist())) == tuple(numbers.tolist())


def test_tree_bound_keeps_every_link_and_block_is_connected():
    texts = families(groups=30)
    sets = list(shingle_sets(pa.array(texts), 5))
    links = jaccard.link_block(np.arange(len(sets)), sets)
    part = list(range(len(sets)))
    for a, b in links:
        assert 100 * len(shingles(texts[a]) & shingles(texts[b])) >= 75 * len(shingles(texts[a]) | shingles(texts[b]))
        part = [part[a] if p == part[b] else p for p in part]
    wanted = components(texts)
    assert len(set(zip(part, wanted))) == len(set(part)) == len(set(wanted))


def _check(df, texts):
    got = {r.doc_id: r for r in df.collect()}
    part = components(texts)
    first = {}
    for i, p in enumerate(part):
        first.setdefault(p, i)
    for i, p in enumerate(part):
        assert (got[i].n_shingles, got[i].component_id) == (len(shingles(texts[i])), first[p])


def test_components_equal_all_pairs(spark):
    texts = families(seed=9, groups=25)
    _check(jaccard.components_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), texts)


@pytest.mark.parametrize("rare", [2, 3, 16])
def test_split_roots_and_hot_shingles_give_the_same(spark, monkeypatch, rare):
    """Blocks of a few texts, and every shared shingle taken as frequent."""
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(jaccard, "HOT_IN_BATCH", 1)
    monkeypatch.setattr(jaccard, "RARE_RUN", rare)
    texts = families(seed=2, groups=15) + ["same words in a row for all of us here now " * 2 + f"{i}" for i in range(12)]
    _check(jaccard.components_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), texts)


def test_odd_rows(spark):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components_of(edge_docs(spark)).collect()]
    assert len(found) == len(rows())
    got = set(found)
    size = len(shingles(rows()[0][1]))
    assert {(1, size, 1), (2, size, 1), (3, size, 1), (None, size, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7)} <= got
    assert (None, 1, None) in got and found.count((3, size, 1)) == 2
    assert jaccard.components_of(empty_docs(spark)).count() == 0


def test_drop_copies_keeps_one_row_of_each_group(spark):
    kept = jaccard.drop_copies(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    ids = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in kept.collect())
    assert [i for none, i, _ in ids if not none] == [1, 4, 5, 6, 7, 9, 10, 11, 12]
    assert [t for none, _, t in ids if none] == ["alone here"]
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.drop_copies(twice).collect()] == [(1, "a b c d e f")]
    assert jaccard.drop_copies(empty_docs(spark)).count() == 0


def test_connected_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + i) for i in range(20)] + [(7, 7)]
    found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.a, r.b) for r in found) == [(i, 1) for i in range(2, 41)] + [(200 + i, 100) for i in range(20)]


def test_runs_over_many_batches():
    """Pairs of rare shingles and texts of frequent ones do not depend on where batches end."""
    rng = np.random.default_rng(3)
    rows = np.unique(np.stack([rng.geometric(0.15, 900), rng.integers(0, 60, 900)], axis=1), axis=0)
    rows = np.repeat(rows, rng.integers(1, 3, len(rows)), axis=0)
    wanted = set()
    for shingle in np.unique(rows[:, 0]):
        texts = np.unique(rows[rows[:, 0] == shingle, 1]).tolist()
        if len(texts) > jaccard.RARE_RUN:
            wanted |= {(t, None, int(shingle)) for t in texts}
        else:
            wanted |= {(a, b, None) for i, a in enumerate(texts) for b in texts[i + 1 :]}
    for size in (1, 2, 7, 50, 5000):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pydict({"shingle": c[:, 0], "salt": np.zeros(len(c), dtype=np.int32), "vertex": c[:, 1]}) for c in cut]
        got = {tuple(r.values()) for b in jaccard._runs(batches) for r in b.to_pylist()}
        assert got == wanted
