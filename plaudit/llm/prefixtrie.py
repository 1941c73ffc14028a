"""Prefix trie of conversations: adaptive radix trees over fixed-width big-endian turn ids.

1. A turn becomes a 16-byte id (digest of role and text) and the text's code points; a
   conversation becomes the joined ids of its turns in order: its key.
2. Keys are sorted by (key, conv_id) and cut into ranges of about ``RANGE_TURNS`` turns, so
   neither a common first turn nor a third of all conversations being equal fills one task.
3. For every range a task builds an adaptive radix tree (``radix``) and walks it from the
   leaves up. Only depths that are whole turns become nodes of the trie.
4. A node that goes on in the range before or after is complete only with its other parts.
   Sorted order tells which: its depth is at most what the range's first or last key shares
   with the neighbouring key. A range counts such a node as a child, and its text once, only
   if the node begins there, and as childless only if it ends there, so that parts add up.
5. The conversations that end at a node are hashed in order of conv_id. Those of a node with
   several parts are written in chunks and hashed as a stream: SHA-256 has no other way, and
   the task holds one chunk at a time.

Turns are ordered by turn (null first), then role, then the text's id. Null role or text
counts as empty; texts that differ only in that are equal. Rows without conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. A conversation is one row
of 16 bytes a turn. Further columns are ignored. No conversations, no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from plaudit.llm.common import attach, columns_of, stage
from plaudit.llm.radix import Tree, shared

WIDTH = 16
RANGE_TURNS = 100_000
CHUNK_ENDS = 4_096
GROUP, SHARED_TURNS = 100, 6  # conversations c-c%100 lend up to five first turns


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; the role's length keeps ("ab", "c") and ("a", "bc") apart."""
    return F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))))


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (id, size) of every conversation in order."""
    plain = columns_of(rows, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), turn_id(role, text).alias("id"), F.length(text).alias("size"))
    grouped = plain.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation c with the first crc32(c) % 6 turns taken from conversation c-c%100."""
    own = conversations.select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("from_id"),
        (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int").alias("h"),
    )
    heads = conversations.filter(f"conv_id % {GROUP} = 0").select(
        F.col("conv_id").alias("from_id"), F.slice("turns", 1, SHARED_TURNS - 1).alias("lent")
    )
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return own.join(heads, "from_id", "left").select("conv_id", F.concat(lent, rest).alias("turns"))


def sorted_keys(conversations: DataFrame) -> DataFrame:
    """(part, conv_id, key, sizes), staged: ranges of conversations in order of (key, conv_id)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    keyed = stage(conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")))
    turns = keyed.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    ranges = keyed.repartitionByRange(1 + turns // RANGE_TURNS, "key", "conv_id")
    return stage(ranges.select(F.spark_partition_id().alias("part"), "conv_id", "key", "sizes").sortWithinPartitions("key", "conv_id"))


@F.udf(IntegerType())
def _shared_turns(a, b):
    """Whole turns that two keys have in common; -1 where there is no neighbour."""
    return -1 if a is None or b is None else shared(bytes(a), bytes(b)) // WIDTH


def range_borders(keys: DataFrame) -> DataFrame:
    """(part, before, after): turns shared with the neighbouring ranges. One row a range."""
    ends = keys.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = W.orderBy("part")
    near = ends.select("part", "first", "last", F.lag("last").over(order).alias("prior"), F.lead("first").over(order).alias("next"))
    return near.select("part", _shared_turns("prior", "first").alias("before"), _shared_turns("last", "next").alias("after"))


_NODES = pa.schema([
    ("node", pa.binary()), ("above", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("first_end", pa.int64()), ("ends", pa.list_(pa.int64())),
])
_NODE_SQL = (
    "node binary, above binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, first_end long, ends array<long>"
)


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class _Below:
    """What lies below a depth of the tree: sums over the nodes there, and the rows still without a parent."""

    __slots__ = ("first", "last", "least", "n", "nodes", "owned", "leaves", "saved", "orphans", "ends")

    def __init__(self) -> None:
        self.first, self.last, self.least, self.n = 1 << 62, -1, None, 0
        self.nodes = self.owned = self.leaves = self.saved = 0
        self.orphans: list[list] = []
        self.ends: list[int] = []

    def take(self, other: _Below) -> None:
        self.first, self.last, self.n = min(self.first, other.first), max(self.last, other.last), self.n + other.n
        self.least = other.least if self.least is None else min(self.least, other.least)
        for name in ("nodes", "owned", "leaves", "saved"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.orphans.extend(other.orphans)


def range_nodes(ids: list[int], keys: list[bytes], sizes: list[list[int]], before: int, after: int) -> Iterator[list]:
    """The trie's nodes of one sorted range, as rows of ``_NODES``; those that go on elsewhere have ``node`` set."""
    tree, last = Tree(), len(ids) - 1
    for place, key in enumerate(keys):
        tree.insert(key, place)
    names: dict[tuple[bool, int], bytes] = {}
    for side, key in ((False, keys[0]), (True, keys[-1])):
        name = names[side, 0] = b"\0" * WIDTH
        for depth in range(1, max(before, after) + 1 if len(key) else 1):
            if depth * WIDTH > len(key):
                break
            name = names[side, depth] = hashlib.md5(name + key[(depth - 1) * WIDTH : depth * WIDTH]).digest()

    def emit(below: _Below, depth: int, made: list[list]) -> _Below:
        """The node at ``depth`` over all that is in ``below``."""
        earlier, later = below.first == 0 and depth <= before, below.last == last and depth <= after
        size = sizes[below.first][depth - 1] if depth else 0
        if not below.nodes:
            below.leaves = 0 if later else 1
        below.saved += below.n * size - (0 if earlier else size)
        ends = [ids[i] for i in below.ends]
        part = names[not earlier, depth] if earlier or later else None
        row = [part, None, depth, below.least, None, below.n, below.owned, below.leaves, below.saved, None if part else _sha(ends), None, None]
        for orphan in below.orphans:
            orphan[4] = None if part else below.least
            orphan[1] = part
        made += below.orphans
        if part:
            made += [
                [part, None, depth, None, None, None, None, None, None, None, ends[i], ends[i : i + CHUNK_ENDS]]
                for i in range(0, len(ends), CHUNK_ENDS)
            ]
        up = _Below()
        up.first, up.last, up.least, up.n, up.leaves, up.saved = below.first, below.last, below.least, below.n, below.leaves, below.saved
        up.nodes, up.owned, up.orphans = 1, 0 if earlier else 1, [row]
        return up

    # Depth first without recursion: (node, depth in bytes where its path begins, children left, what they gave).
    made: list[list] = []
    open_ = [(tree.root, 0, iter(tree.root.children()), _Below())]
    while open_:
        node, start, kids, below = open_[-1]
        kid = next(kids, None)
        if kid is not None:
            open_.append((kid, start + len(node.path) + 1, iter(kid.children()), _Below()))
            continue
        open_.pop()
        stop = start + len(node.path)
        below.ends = sorted(node.ends)
        if below.ends:
            own = _Below()
            own.first, own.last, own.n, own.least = below.ends[0], below.ends[-1], len(below.ends), min(ids[i] for i in below.ends)
            below.take(own)
        # The byte that leads here belongs to the path too; the root's begins with depth 0.
        for depth in range(stop // WIDTH, -(-start // WIDTH) - 1, -1):
            below = emit(below, depth, made)
        if open_:
            open_[-1][3].take(below)
        else:
            made += below.orphans
        yield from made
        made = []


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []

    def flush():
        rows = []
        if held:
            _, ids, keys, sizes, before, after = zip(*held)
            for row in range_nodes(list(ids), list(keys), list(sizes), before[0], after[0]):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)

    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in ("part", "conv_id", "key", "sizes", "before", "after")]):
            if held and held[-1][0] != row[0]:
                yield from flush()
                held = []
            held.append(row)
    yield from flush()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the sorted chunks of every node, one chunk at a time."""
    node, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "sha": [state.hexdigest()]})

    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if name != node:
                if node is not None:
                    yield done()
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids)).encode())
    if node is not None:
        yield done()


def trie_nodes(keys: DataFrame) -> DataFrame:
    """All nodes of the trie over the staged ranges of ``sorted_keys``."""
    ranges = 1 + (keys.agg(F.max("part")).first()[0] or 0)
    framed = attach(keys, stage(range_borders(keys)).withColumnRenamed("part", "at"), F.col("part") == F.col("at")).drop("at")
    dealt = framed.repartition(ranges, "part").sortWithinPartitions("part", "key", "conv_id")
    found = stage(dealt.mapInArrow(_tree_rows, _NODE_SQL))
    counted = found.filter("n_convs is not null")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = counted.filter("node is not null").groupBy("node").agg(
        F.first("above", ignorenulls=True).alias("above"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(name).alias(name) for name in sums],
    )
    chunks = found.filter("ends is not null").select("node", "first_end", "ends")
    hashed = chunks.repartition("node").sortWithinPartitions("node", "first_end").mapInArrow(_hashed, "node binary, sha string")
    joined = stage(parts.join(hashed, "node", "left"))
    names = joined.select(F.col("node").alias("over"), F.col("conv_id").alias("over_id"))
    columns = ("conv_id", "depth", "parent_conv_id", *sums, "ends_sha256")
    split = joined.withColumns({"parent_conv_id": F.lit(None).cast("long"), "ends_sha256": F.coalesce("sha", F.sha2(F.lit(b""), 256))})
    rows = counted.filter("node is null").select("above", *columns).unionByName(split.select("above", *columns))
    out = attach(rows, names, F.col("above") == F.col("over"))
    return out.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over_id")).select(*columns)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie's nodes for a table of turns (conv_id, turn, role, text), after ``rebuilt``."""
    return trie_nodes(sorted_keys(rebuilt(conversations_of(rows))))


def node_turns(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn, for conversations that are not rebuilt; the root has none."""
    plain = columns_of(rows, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", role, turn_id(role, text)))
    turns = plain.select(F.col("conv_id").alias("c"), place.cast("long").alias("d"), role.alias("role"), text.alias("text"))
    return nodes.join(turns, (F.col("c") == F.col("conv_id")) & (F.col("d") == F.col("depth")), "left").drop("c", "d")
