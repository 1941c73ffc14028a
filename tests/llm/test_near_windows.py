"""Near windows of the benchmark against a plain edit distance over all places."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from plaudit.llm import decontaminate


def plain_distance(window, text):
    """Least number of word edits between the window and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(window, 1):
        last, row = row, [i]
        for j, other in enumerate(text, 1):
            row.append(min(last[j - 1] + (word != other), last[j] + 1, row[j - 1] + 1))
    return min(row)


def plain_near(text, items, slop):
    words, met = text.split(), set()
    for item_id, item in items:
        held = item.split()
        size = min(10, len(held))
        edits = slop * (size // 10)
        if any(plain_distance(held[i : i + size], words) <= edits for i in range(len(held) - size + 1)):
            met.add(item_id)
    return len(met)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=10), st.lists(st.integers(0, 3), max_size=16), st.sampled_from([1, 2]))
def test_near_places_equal_the_edit_distance(window, text, slop):
    found = any(decontaminate.near_at(window, text, at, slop) for at in range(-slop, len(text) + 1))
    assert found == (plain_distance(window, text) <= slop)


def _tables(spark):
    draw = random.Random(8)
    words = [f"w{n}" for n in range(60)]
    items = [(n, " ".join(draw.choice(words) for _ in range(draw.randint(10, 14)))) for n in range(8)] + [(8, "short item")]
    docs = []
    for n in range(120):
        part = draw.choice(items)[1].split()
        for _ in range(n % 4):
            at, kind = draw.randrange(max(1, len(part))), draw.choice("ird")
            part[at : at + (kind != "i")] = [] if kind == "d" else [draw.choice([*words, f"new{n}"])]
        docs.append((n, " ".join([*draw.sample(words, n % 3), *part, *draw.sample(words, n % 2)])))
    docs += [(200 + n, " ".join(items[0][1].split()[:5] + ["extra"] + items[0][1].split()[5:10])) for n in range(2)]
    return items, docs, spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")


def test_near_items_equal_plain_search(spark, monkeypatch):
    items, docs, bench, frame = _tables(spark)
    for slop in (1, 2):
        wanted = {i: plain_near(t, items, slop) for i, t in docs}
        assert {r.doc_id: r.n_near_items for r in decontaminate.contamination(frame, bench, slop=slop).collect()} == wanted
    exact = {r.doc_id: r for r in decontaminate.contamination(frame, bench).collect()}
    near = {r.doc_id: r for r in decontaminate.contamination(frame, bench, slop=1).collect()}
    assert all(tuple(near[i])[:6] == tuple(exact[i]) for i in exact)
    assert near[200].n_near_items >= 1 and not near[200].contaminated
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 3)  # many blocks of items
    wanted = {i: plain_near(t, items, 1) for i, t in docs}
    assert {r.doc_id: r.n_near_items for r in decontaminate.contamination(frame, bench, slop=1).collect()} == wanted


def test_word_that_is_nowhere_may_be_replaced(spark):
    bench = spark.createDataFrame([(1, "a b c d e absent g h i j")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e other g h i j y"), (2, "a b c d e g h i j"), (3, "a b c d other g h i j")], "doc_id long, text string")
    assert {r.doc_id: r.n_near_items for r in decontaminate.contamination(docs, bench, slop=1).collect()} == {1: 1, 2: 1, 3: 0}
