"""Prefix trie of conversations against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from oracle import difference, duck

from plaudit.llm import catalog, prefixtrie, radix

SCHEMA = "conv_id long, turn long, role string, text string, `TEXT` string, key binary, depth int"
SF = "/root/testdata/sf0.001"


def plain_nodes(rows, rebuild=True):
    """Rows (conv_id, turn, role, text) to the set of node rows, by a dictionary over whole prefixes."""
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            md5 = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, role, md5, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        made[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    out = set()
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if made[c] == path)
        above = min(members[path[:-1]]) if path else None
        out.add((min(convs), len(path), above, len(convs), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def tables():
    draw = random.Random(7)
    mixed = []
    for c in [*range(0, 130), *range(300, 340), 1000, 2005]:
        first = draw.choice([0, 0, 0, 1, 2])
        for t in range(draw.randint(1, 7)):
            word = first if t == 0 else draw.randint(0, 2)
            mixed.append((c, t, draw.choice(["user", None]) if t > 2 else "user", None if word == 2 else "é" * (word + 1) + "x" * t))
    equal = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(4)]
    odd = [(None, 0, "user", "lost"), (5, None, "a", "x"), (5, 0, "a", ""), (5, 0, "a", ""), (5, 0, "a", "y"), (7, 1, None, None),
           (100, 0, "", ""), (101, 0, "a", "b" * 50_000), (102, 0, "ab", "c"), (103, 0, "a", "bc")]
    long = [(c, t, "user", f"t{t % 5}") for c in (1, 2) for t in range(300)]
    return {"mixed": mixed, "equal": equal, "odd": odd, "long": long, "empty": []}


@pytest.mark.parametrize("name", list(tables()))
@pytest.mark.parametrize("turns", [7, 100_000])
def test_same_as_dictionary(spark, monkeypatch, name, turns):
    monkeypatch.setattr(prefixtrie, "RANGE_TURNS", turns)
    monkeypatch.setattr(prefixtrie, "CHUNK_ENDS", 3)
    rows = tables()[name]
    df = spark.createDataFrame([(*r, "clash", b"k", 1) for r in rows], SCHEMA).repartition(3)
    found = prefixtrie.prefix_trie(df).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == plain_nodes(rows)


def test_ranges_that_only_repeat_a_key():
    """A range is all one key, which goes on before and after it."""
    rows = list(prefixtrie.range_nodes([4, 5], [b"a" * 32] * 2, [[3, 4]] * 2, 2, 2))
    counts = [(r[2], r[5], r[6], r[7], r[8]) for r in rows if r[5] is not None]
    assert sorted(counts) == [(0, 2, 0, 0, 14), (1, 2, 0, 0, 14), (2, 2, 0, 0, 8)]


def test_tree_layouts():
    """Nodes grow through all four layouts, split paths and give back every key in order."""
    draw = random.Random(3)
    keys = sorted({bytes([a, draw.choice([1, 9]), draw.randrange(256), 7]) * draw.choice([1, 2]) for a in range(256) for _ in range(3)})
    tree = radix.Tree()
    for place, key in draw.sample(list(enumerate(keys)), len(keys)):
        tree.insert(key, place)
    found, sizes = [], set()

    def walk(node, upto):
        sizes.add(node.places)
        found.extend((upto + node.path, place) for place in node.ends)
        bytes_ = [b for b in range(256) if node.child(b) is not None]
        assert [node.child(b) for b in bytes_] == list(node.children())
        for b in bytes_:
            walk(node.child(b), upto + node.path + bytes([b]))

    walk(tree.root, b"")
    assert [k for k, _ in sorted(found)] == keys and {k: p for k, p in found} == {k: p for p, k in enumerate(keys)}
    assert 4 in sizes and 256 in sizes
    assert radix.shared(b"abcd", b"abxd") == 2 and radix.shared(b"ab", b"abc") == 2 and radix.shared(b"", b"a") == 0


def test_query_same_as_sql(spark):
    assert not difference(catalog.op12_prefix_trie(spark, SF), duck(SF), catalog.oracle_sql()["op12_prefix_trie"])


def test_texts_of_nodes(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = prefixtrie.trie_nodes(prefixtrie.sorted_keys(prefixtrie.conversations_of(df)))
    found = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in prefixtrie.node_turns(nodes, df).collect()}
    assert found == {(1, 0): (None, None), (1, 1): ("user", "a"), (1, 2): ("bot", "b")}
