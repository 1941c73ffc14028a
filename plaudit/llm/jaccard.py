"""N-gram Jaccard join of whole texts with a count-vector R-tree.

A text is its set of distinct shingles. Shingles are hashed into groups, and the
counts of the groups are a point. The overlap of two sets is at most the sum of the
coordinate minima of their points, and at most that sum for the upper corner of a
box of points: this is the bound with which the tree is searched. Pairs that survive
are verified on the sets themselves.

Points of unrelated texts look alike in every single coordinate, so one tree over a
whole corpus would open nearly all boxes for every text. The tree is therefore a
forest, planted where links can be:

1. *Roots.* Put all shingles into one order, the frequent ones last, and take of each set
   the first ``n - ceil(0.75 n) + m`` with ``m`` a twentieth of its size. Linked sets share
   at least ``m`` of these (the smaller ``m`` of both). Shared rare shingles are counted for
   each pair of texts (at most ``RARE_RUN`` texts have a rare one), shared frequent ones are
   bounded by how many each text has. Pairs and texts that cannot reach ``m`` are left out;
   the others, joined directly or through others, make the roots, and no link leads out of
   one. The order comes from a counting pass, of which the top ``HOT_SHINGLES`` are
   broadcast; any order is right, a poor one costs time.
2. *Forest.* A root with many texts is split by size class and hash into blocks, and
   pairs of blocks that can hold links are searched. A text meets its own class and
   the next ones only, and no task holds more than two blocks.
3. *Tree.* Inside a block texts are packed by size into leaves and nodes of
   ``FANOUT``; each text descends by the bound. Places already connected are skipped,
   so m near copies need about m verifications, not m * m.

Results are components, never all pairs. Equal sets are one vertex: copies, also a
third of all rows, cost a row each before the first shuffle.

Null, empty and wordless texts have no shingles and are linked with nothing; their
component is their own doc_id. Texts of fewer words than a shingle are one shingle.
A null doc_id takes part and yields to any other id of its component (null if there
is none). Rows with equal doc_id are joined by their own texts. Other columns are
ignored (``components_of``) or kept (``drop_copies``); empty tables stay empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import attach, columns_of, map_columns, mix64, shingle_sets, slices, stage
from plaudit.llm.components import connected

SHINGLE = 5
# Linked means 100 * |A and B| >= 75 * |A or B|, that is 7 * |A and B| >= 3 * (|A| + |B|).
HOT_SHINGLES = 200_000  # broadcast; the rest counts as rare, which costs time and never a link
HOT_IN_BATCH = 2
RARE_RUN = 16  # texts that a rare shingle has at most
SALTS = 8
BLOCK_TEXTS, BLOCK_SHINGLES = 2_048, 1 << 21
FANOUT = 32


def shared_least(n: int) -> int:
    """Shingles of their prefixes that linked sets share at least."""
    return max(1, n // 20)


def prefix_size(n: int) -> int:
    return n - (75 * n + 99) // 100 + shared_least(n)


def linked(common: int, a: int, b: int) -> bool:
    return 7 * common >= 3 * (a + b)


# --- sets, vertices and prefixes -------------------------------------------------------------


def _hot_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in order of hash, with their counts (rare ones left out)."""

    def count(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), SHINGLE))
            every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else every.astype(np.int64)
            sizes = np.diff(np.append(first, len(every)))
            many = sizes >= HOT_IN_BATCH
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(every[first[many]].view(np.int64)), "n": pa.array(sizes[many])})

    counts = texts.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") > RARE_RUN).orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).toPandas()
    shingle = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], top["n"].to_numpy(dtype=np.int64)[order]


def _vertices(documents: DataFrame) -> DataFrame:
    """Staged rows (doc_id, text_key, n, vertex, prefix, hot_from) of all documents.

    ``vertex`` is a hash of the set. Only its first row in a task has a prefix, so
    copies do not multiply the rows that are shuffled.
    """
    docs = columns_of(documents, "doc_id", "text")
    shared = documents.sparkSession.sparkContext.broadcast(_hot_shingles(docs.select("text")))

    def make():
        hot, often = shared.value
        seen: set[int] = set()

        def work(batch):
            n, vertex, prefix, hot_from = [], [], [], []
            for found in shingle_sets(batch.column("text"), SHINGLE):
                size = len(found)
                key = int(mix64(np.array([np.sum(mix64(found ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(size)], dtype=np.uint64)).view(np.int64)[0])
                n.append(size)
                vertex.append(key)
                if not size or key in seen:
                    prefix.append(None)
                    hot_from.append(None)
                    continue
                seen.add(key)
                at = np.minimum(np.searchsorted(hot, found), max(len(hot) - 1, 0))
                count = np.where(hot[at] == found, often[at], 0) if len(hot) else np.zeros(size, dtype=np.int64)
                order = np.argsort(count, kind="stable")[: prefix_size(size)]
                prefix.append(found[order].view(np.int64))
                hot_from.append(int(np.count_nonzero(count[order] == 0)))
            return {"n": pa.array(n, pa.int64()), "vertex": pa.array(vertex, pa.int64()),
                    "prefix": pa.array(prefix, pa.list_(pa.int64())), "hot_from": pa.array(hot_from, pa.int32())}

        return work

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    made = map_columns(rows, make, rows.columns, "n long, vertex long, prefix array<long>, hot_from int")
    return stage(made.drop("text"))


def _runs(batches):
    """From postings in order of shingle: pairs of texts with a rare one (b), and texts of frequent ones (shingle)."""
    held = [np.zeros(0, dtype=np.int64)] * 3
    open_ = None  # key of a frequent run that goes on

    def out(a, b, shingle):
        n, k = len(b), len(shingle)
        none = np.zeros(n + k, dtype=bool)
        return pa.RecordBatch.from_pydict({
            "a": pa.array(a),
            "b": pa.array(np.append(b, np.zeros(k, dtype=np.int64)), mask=np.arange(n + k) >= n),
            "shingle": pa.array(np.append(np.zeros(n, dtype=np.int64), shingle), mask=np.arange(n + k) < n if n + k else none),
        })

    def work(shingle, salt, vertex, last):
        """Rows to emit, and the rows of a run that may go on in the next batch."""
        nonlocal open_
        same = (shingle[1:] == shingle[:-1]) & (salt[1:] == salt[:-1])
        unlike = np.append(True, ~same | (vertex[1:] != vertex[:-1]))
        shingle, salt, vertex = shingle[unlike], salt[unlike], vertex[unlike]
        fresh = np.append(True, (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1]))
        run = np.cumsum(fresh) - 1
        starts = np.flatnonzero(fresh)
        often = (np.diff(np.append(starts, len(run))) > RARE_RUN) | (salt[starts] > 0)
        often[0] |= (shingle[0], salt[0]) == open_
        keep = len(run)
        if not last:
            if often[-1]:
                open_ = (shingle[-1], salt[-1])
            else:
                keep = starts[-1]
        rest = [x[keep:] for x in (shingle, salt, vertex)]
        shingle, vertex, run = shingle[:keep], vertex[:keep], run[:keep]
        many = often[run]
        a, b = [], []
        for step in range(1, RARE_RUN):
            met = (run[step:] == run[:-step]) & ~many[step:] if step < len(run) else np.zeros(0, dtype=bool)
            if not met.any():
                break
            a.append(vertex[:-step][met])
            b.append(vertex[step:][met])
        b = np.concatenate([np.zeros(0, dtype=np.int64), *b])
        return out(np.concatenate([*a, vertex[many]]), b, shingle[many]), rest

    for batch in batches:
        if batch.num_rows:
            columns = [np.asarray(batch.column(c)).astype(np.int64) for c in ("shingle", "salt", "vertex")]
            made, held = work(*[np.append(h, c) for h, c in zip(held, columns)], last=False)
            yield made
    if len(held[0]):
        yield work(*held, last=True)[0]


def _roots(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): texts that may be linked with others (and some shingles) with the name of their root."""
    posted = rows.filter("prefix is not null").select("vertex", "hot_from", F.posexplode("prefix").alias("at", "shingle"))
    # Runs of frequent shingles are cut into parts; they need not meet.
    salt = F.when(F.col("at") >= F.col("hot_from"), 1 + F.pmod("vertex", F.lit(SALTS))).otherwise(0).cast("int")
    posted = posted.select("shingle", salt.alias("salt"), "vertex")
    dealt = posted.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "vertex")
    found = stage(dealt.mapInArrow(_runs, "a long, b long, shingle long"))
    frequent = found.filter("b is null").select(F.col("a").alias("vertex"), "shingle")
    often = frequent.groupBy("vertex").agg(F.count(F.lit(1)).alias("often"))
    own = sizes.select("vertex", "n").join(often, "vertex", "left").na.fill({"often": 0})
    own = stage(own.withColumn("least", F.greatest(F.lit(1), F.floor(F.col("n") / 20))))
    one, two = (own.select([F.col(c).alias(f"{c}_{side}") for c in own.columns]) for side in "ab")
    pairs = found.filter("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("rare"))
    pairs = pairs.join(one, F.col("a") == F.col("vertex_a")).join(two, F.col("b") == F.col("vertex_b"))
    reach = F.col("rare") + F.least("often_a", "often_b") >= F.least("least_a", "least_b")
    near = 4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")
    able = own.filter("often >= least").select("vertex")
    stars = frequent.join(able, "vertex").select(F.col("vertex").alias("a"), F.col("shingle").alias("b"))
    return connected(pairs.filter(reach & near).select("a", "b").unionByName(stars))


# --- blocks and trees ------------------------------------------------------------------------


class CountTree:
    """Points of group counts, packed by set size; boxes keep the largest count of each group."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        groups = 1 << int(np.clip(np.log2(max(np.median(self.sizes) / 4, 1)) + 0.5, 3, 10))
        kind = np.uint16 if self.sizes.max() < 65_536 else np.uint32
        self.points = np.zeros((len(sets), groups), dtype=kind)
        for i, found in enumerate(sets):
            self.points[i] = np.bincount((found >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            points, smallest = self.levels[-1]
            cuts = np.arange(0, len(points), FANOUT)
            self.levels.append((np.maximum.reduceat(points, cuts), np.minimum.reduceat(smallest, cuts)))

    def later(self, i: int) -> np.ndarray:
        """Points after ``i`` whose overlap with it may be large enough."""
        own, size = self.points[i], int(self.sizes[i])
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            points, smallest = self.levels[level]
            span = FANOUT**level
            at = at[((at + 1) * span > i + 1) & (3 * smallest[at] <= 4 * size)]
            bound = np.minimum(points[at], own).sum(axis=1, dtype=np.int64)
            at = at[7 * bound >= 3 * (size + smallest[at])]
            if level:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return at[at > i]


def link_block(vertices: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the components of one block: a spanning forest."""
    order = np.lexsort((vertices, [len(s) for s in sets]))
    sets, vertices = [sets[i] for i in order], vertices[order]
    tree = CountTree(sets)
    part = np.arange(len(sets))
    links = []
    for i, own in enumerate(sets):
        places = tree.later(i)
        places = places[part[places] != part[i]]
        while len(places):
            j = places[0]
            if linked(_common(own, sets[j]), len(own), len(sets[j])):
                links.append((int(vertices[i]), int(vertices[j])))
                part[part == part[j]] = part[i]
                places = places[part[places] != part[i]]
            else:
                places = places[1:]
    return links


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _blocks(members: DataFrame) -> tuple[DataFrame, bool]:
    """Members with the blocks that they belong to; whether some root was split.

    ``members``: vertex, n, root. A root within the block bounds is one block.
    """
    klass = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    members = members.withColumn("class", klass)
    per = members.groupBy("root", "class").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_TEXTS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    whole = per.groupBy("root").agg(
        F.sum("m").alias("m"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("class", parts))).alias("parts")
    )
    split = (F.col("m") > BLOCK_TEXTS) | (F.col("s") > BLOCK_SHINGLES)
    plan = stage(whole.select("root", split.alias("split"), F.when(split, F.col("parts")).alias("parts")))
    joined = attach(members, plan.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "inner").drop("r")

    def count(k):
        return F.coalesce(F.try_element_at("parts", k), F.lit(0))

    def series(n, name):
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda j: j < n), name)

    mine = F.pmod(F.xxhash64("vertex"), count(F.col("class"))).cast("int")
    low, k = F.col("class") - 1, F.col("class")
    name = lambda *bits: F.concat_ws("/", *[b.cast("string") for b in bits])
    blocks = F.concat(
        series(count(k), lambda j: name(k, k, F.least(F.col("mine"), j), F.greatest(F.col("mine"), j))),
        series(count(k + 1), lambda j: name(k, k + 1, F.col("mine"), j)),
        series(count(low), lambda j: name(low, k, j, F.col("mine"))),
    )
    joined = joined.withColumn("mine", F.when(F.col("split"), mine))
    block = F.when(F.col("split"), blocks).otherwise(F.array(F.lit("")))
    out = joined.select("vertex", "root", F.explode(block).alias("block"))
    return out, bool(plan.filter("split").limit(1).count())


def _links(texts: DataFrame) -> DataFrame:
    """Verified links (a, b) from rows (root, block, vertex, text)."""

    def search(batches):
        current, names, column = None, [], []

        def finish():
            sets = list(shingle_sets(pa.array(column, pa.string()), SHINGLE))
            found = link_block(np.array(names, dtype=np.int64), sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        for batch in slices(batches):
            for root, block, vertex, text in zip(*(batch.column(c).to_pylist() for c in ("root", "block", "vertex", "text"))):
                if (root, block) != current:
                    if len(names) > 1:
                        yield finish()
                    current, names, column = (root, block), [], []
                names.append(vertex)
                column.append(text)
        if len(names) > 1:
            yield finish()

    return texts.repartition("root", "block").sortWithinPartitions("root", "block", "vertex").mapInArrow(search, "a long, b long")


# --- the join --------------------------------------------------------------------------------


def _labels(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(vertex, label) of all vertices with links."""
    sizes = stage(rows.filter("prefix is not null").groupBy("vertex").agg(F.first("n").alias("n"), F.min("text_key").alias("text_key")))
    roots = _roots(rows, sizes)
    named = roots.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    )
    members = stage(named.join(sizes, "vertex"))
    docs = columns_of(documents, "text").withColumn("k", F.xxhash64("text"))
    held = attach(docs, members.select("text_key", "vertex"), F.col("k") == F.col("text_key"), "inner")
    texts = held.groupBy("vertex").agg(F.first("text").alias("text"))
    blocks, split = _blocks(members.select("vertex", "n", "root"))
    links = stage(_links(texts.join(blocks, "vertex").select("root", "block", "vertex", "text")))
    found = connected(links)
    return found.select(F.col("a").alias("vertex"), F.col("b").alias("label")).unionByName(
        found.select(F.col("b").alias("vertex"), F.col("b").alias("label")).distinct()
    )


def _labelled(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, n and the label of the component (null without shingles)."""
    rows = _vertices(documents)
    labels = stage(_labels(documents, rows))
    narrow = rows.select("doc_id", "text_key", "n", "vertex")
    joined = attach(narrow, labels.withColumnRenamed("vertex", "v"), F.col("vertex") == F.col("v"))
    return joined.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.coalesce("label", "vertex")).alias("label"))


def components_of(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows = stage(_labelled(documents))
    groups = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    groups = stage(groups.filter("m > 1").select(F.col("label").alias("l"), "least"))
    joined = attach(rows, groups, F.col("label") == F.col("l"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("l").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """One row of every component (the smallest doc_id), and all rows without shingles."""
    names = documents.columns
    doc_id, text = (f"c{names.index(name)}" for name in ("doc_id", "text"))
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    rows = stage(_labelled(documents).filter("label is not null"))
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    kept = rows.groupBy("label").agg(F.min(one).alias("w"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    kept = stage(kept.select(F.col("label").alias("l"), F.col("w.doc_id").alias("w_id"), F.col("w.text_key").alias("w_key")))
    many = attach(rows, kept, F.col("label") == F.col("l"), "inner")
    wins = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))
    lost = many.filter(~wins).select("doc_id", "text_key").distinct()
    again = many.filter(wins).groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")
    lost, again = stage(lost), stage(again)
    keyed = plain.withColumn("k", F.xxhash64(text))
    here = F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))
    left = attach(keyed, lost.unionByName(again), here, "left_anti")
    if again.limit(1).count():
        left = left.unionByName(attach(keyed, again, here, "left_semi").dropDuplicates([doc_id, "k"]))
    return left.drop("k").toDF(*names)
