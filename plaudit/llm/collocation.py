"""Phrases of words that stand together more often than by chance, from a weighted de Bruijn graph.

1. Words are counted per language; ``n`` is the count of all words.
2. Every phrase counted ``LEAST`` times or more consists of words and word pairs that are, so pieces
   are cut between two words whose pair is rarer. No occurrence of a frequent phrase is lost. The
   frequent pairs are known by a bit map of fixed size (a rarer pair may pass, none is missed).
3. Edges are the runs of ``LONGEST`` words, each from the node of its first ``LONGEST`` - 1 words to
   the node of its last; their weights are summed over the corpus. Nothing shorter is counted but the
   ends of pieces: the count of a node is the flow out of it plus the pieces that end with it, and
   the same step gives the counts of shorter phrases from the nodes.
4. ``absorbed``: a phrase whose whole flow passes through one longer phrase is part of that unary
   path. ``unary_paths`` joins edges along nodes with one way in and one way out, by pointer
   doubling, to phrases of any length.
5. ``collocations`` scores each phrase at its weakest cut and keeps the first per language.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words
``[^\\x20\\x09]+``. Null texts are empty; a null lang is ``und``; repeated rows and copies count each.
Words are known by 64-bit hashes that take in the language; texts of any length are worked off in
whole. Further columns are ignored. Ties in the order go by the phrase's bytes. No words, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plaudit.llm.common import _LOWER, attach, columns_of, mix64, slices, span_hashes, stage, text_bytes

LEAST, LONGEST, TOP = 100, 5, 2_000
CHUNK = 1 << 21
BITS = 27  # bit maps of 16 MB
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def texts_of(documents: DataFrame) -> DataFrame:
    """(lang, salt, text): what is counted of the documents."""
    lang = F.coalesce("lang", F.lit("und"))
    return columns_of(documents, "lang", "text").filter("text is not null").select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), "text")


def chunk_words(column: pa.Array, salts: np.ndarray):
    """Words of some rows at a time: (first row, bytes, starts, ends, keys, row, whether the word before is in the same piece)."""
    raw, bounds = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        codes = _LOWER[raw[bounds[first] : bounds[last]]]
        rows = bounds[first : last + 1] - bounds[first]
        stops = _STOP[codes]
        inside = ~(_BLANK[codes] | stops)
        cuts = rows[:-1][rows[:-1] < len(codes)]
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begins[cuts] = inside[cuts]
        before = cuts[cuts > 0] - 1
        closes[before] = inside[before]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        row = np.searchsorted(rows, starts, side="right") - 1
        upto = np.cumsum(stops)
        joined = np.zeros(len(starts), dtype=bool)
        joined[1:] = (row[1:] == row[:-1]) & (upto[starts[1:]] == upto[ends[:-1] - 1])
        yield first, codes, starts, ends, mix64(span_hashes(codes, starts, ends) ^ salts[first + row]), row, joined
        first = last


def _salts(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("salt").to_numpy().view(np.uint64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, key, word, n) of every word, and the sum of all for each lang in a row without word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            for first, codes, starts, ends, keys, row, _ in chunk_words(batch.column("text"), _salts(batch)):
                found, at, n = np.unique(keys, return_index=True, return_counts=True)
                data = codes.tobytes()
                words = [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                per: dict[str, int] = {}
                for r, c in enumerate(np.bincount(row).tolist()):
                    if c:
                        per[langs[first + r]] = per.get(langs[first + r], 0) + c
                yield pa.RecordBatch.from_pydict({
                    "lang": [*(langs[first + r] for r in row[at].tolist()), *per],
                    "key": pa.array([*found.view(np.int64).tolist(), *[0] * len(per)], pa.int64()),
                    "word": pa.array([*words, *[None] * len(per)], pa.string()),
                    "n": pa.array([*n.tolist(), *per.values()], pa.int64()),
                })

    return texts.mapInArrow(count, "lang string, key long, word string, n long").groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))


def bit_map(keys: DataFrame, column: str) -> np.ndarray:
    """2^``BITS`` bits as bytes, set where the leading bits of a key stand."""
    place = F.shiftrightunsigned(column, 64 - BITS)
    blocks = keys.select(F.floor(place / 32768).alias("block"), (place % 32768).alias("bit"))
    out = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for row in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # at most 2^(BITS-15) rows
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def pair_keys(keys: np.ndarray) -> np.ndarray:
    """A hash of every word and the one before it."""
    return mix64(keys[:-1] * _STEP + keys[1:])


def pair_counts(texts: DataFrame, words) -> DataFrame:
    """(pair, n) of neighbouring words that may both be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, _, _, _, keys, _, joined in chunk_words(batch.column("text"), _salts(batch)):
                frequent = in_map(words.value, keys)
                pairs, n = np.unique(pair_keys(keys)[joined[1:] & frequent[1:] & frequent[:-1]], return_counts=True)
                yield pa.RecordBatch.from_pydict({"pair": pairs.view(np.int64), "n": n})

    return texts.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _distinct(grams: np.ndarray) -> pa.RecordBatch:
    """Rows of words and how often each occurs; words are big-endian, so bytes keep their order."""
    mixed = np.zeros(len(grams), dtype=np.uint64)
    for i in range(grams.shape[1]):
        mixed = mix64(mixed * _STEP + grams[:, i])
    _, at, n = np.unique(mixed, return_index=True, return_counts=True)
    data = np.ascontiguousarray(grams[at].astype(">u8"))
    offsets = (np.arange(len(at) + 1) * 8 * grams.shape[1]).astype(np.int32)
    return pa.RecordBatch.from_pydict({"gram": pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), "n": n})


def edges_and_ends(texts: DataFrame, words, pairs, longest: int) -> DataFrame:
    """(gram, n): runs of ``longest`` words, and the last 2 to ``longest`` - 1 words of pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, _, _, _, keys, _, joined in chunk_words(batch.column("text"), _salts(batch)):
                if len(keys) < 2:
                    continue
                frequent = in_map(words.value, keys)
                linked = np.zeros(len(keys) + 1, dtype=bool)  # to the word before; nothing before the first and after the last
                linked[1:-1] = joined[1:] & frequent[1:] & frequent[:-1]
                open_ = np.flatnonzero(linked[1:-1]) + 1
                linked[open_] = in_map(pairs.value, mix64(keys[open_ - 1] * _STEP + keys[open_]))
                breaks = np.flatnonzero(~linked[:-1])
                run = np.arange(len(keys)) - np.repeat(breaks, np.diff(np.append(breaks, len(keys)))) + 1  # words of the piece up to here
                for size in range(2, longest + 1):
                    ends = np.flatnonzero(run >= size) if size == longest else np.flatnonzero((run >= size) & ~linked[1:])
                    if len(ends):
                        yield _distinct(keys[ends[:, None] + np.arange(1 - size, 1)])

    return texts.mapInArrow(cut, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _words(gram: str, first: int, n) -> Column:
    """``n`` words of a gram from word ``first`` (1-based)."""
    return F.substring(gram, 8 * (first - 1) + 1, 8 * n)


def phrase_counts(grams: DataFrame, least: int, longest: int) -> DataFrame:
    """(gram, a), staged: phrases of 2 to ``longest`` words found ``least`` times or more."""
    level = grams.filter(F.length("gram") == 8 * longest).select("gram", F.col("n").alias("a"))
    frequent = stage(level.filter(F.col("a") >= least))
    for size in range(longest - 1, 1, -1):
        flow = level.select(_words("gram", 1, size).alias("gram"), "a")
        ends = grams.filter(F.length("gram") == 8 * size).select("gram", F.col("n").alias("a"))
        level = stage(flow.unionByName(ends).groupBy("gram").agg(F.sum("a").alias("a")))
        frequent = frequent.unionByName(level.filter(F.col("a") >= least))
    return stage(frequent)


def absorbed(phrases: DataFrame) -> DataFrame:
    """(gram, through): the largest count of a phrase that is one word longer, for phrases inside one."""
    size = F.length("gram") / 8
    longer = phrases.filter(size > 2)
    parts = [F.substring("gram", F.lit(1), F.length("gram") - 8), F.substring("gram", F.lit(9), F.length("gram") - 8)]
    return longer.select(F.explode(F.array(*parts)).alias("gram"), "a").groupBy("gram").agg(F.max("a").alias("through"))


def unary_paths(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(gram, edges, least): maximal runs of frequent edges through nodes with one way in and one way out.

    ``edges`` is their number and ``least`` the smallest weight. Pointer doubling: each round joins
    every stretch with the one that begins where it ends, so rounds grow as the logarithm of the
    longest path; a closed circle, which has no beginning, is left as its edges.
    """
    node = 8 * (longest - 1)
    edges = phrases.filter(F.length("gram") == 8 * longest).select(
        "gram", "a", F.substring("gram", 1, node).alias("tail"), F.substring("gram", 9, node).alias("head")
    )
    out = edges.groupBy("tail").agg(F.count(F.lit(1)).alias("n_out")).withColumnRenamed("tail", "node")
    into = edges.groupBy("head").agg(F.count(F.lit(1)).alias("n_in")).withColumnRenamed("head", "node")
    inner = stage(out.join(into, "node").filter("n_out = 1 and n_in = 1").select("node"))
    starts = edges.join(inner.withColumnRenamed("node", "tail"), "tail", "left_anti").select("gram").withColumn("first", F.lit(True))
    # A stretch is its gram, where it goes on (null at a path's end), its edges and smallest weight.
    going = edges.join(inner.withColumnRenamed("node", "head").withColumn("on", F.lit(True)), "head", "left")
    now = stage(
        going.join(starts, "gram", "left").select(
            F.coalesce("first", F.lit(False)).alias("first"), "tail", F.when(F.col("on"), F.col("head")).alias("head"), "gram",
            F.lit(1).cast("long").alias("edges"), F.col("a").alias("least"),
        )
    )
    total = now.count()
    reached = 1
    while reached <= total and now.filter("first and head is not null").limit(1).count():
        nexts = now.select(*[F.col(c).alias(f"n_{c}") for c in ("tail", "head", "gram", "edges", "least")])
        both = now.join(nexts, F.col("head") == F.col("n_tail"), "left")
        tail = F.substring("n_gram", F.lit(node + 1), F.length("n_gram") - node)
        met = F.col("n_tail").isNotNull()
        now = stage(
            both.select(
                "first", "tail", F.when(met, F.col("n_head")).otherwise(F.lit(None)).alias("head"),
                F.when(met, F.concat("gram", tail)).otherwise(F.col("gram")).alias("gram"),
                F.when(met, F.col("edges") + F.col("n_edges")).otherwise(F.col("edges")).alias("edges"),
                F.when(met, F.least("least", "n_least")).otherwise(F.col("least")).alias("least"),
            )
        )
        reached *= 2
    return now.filter("first").select("gram", "edges", "least")


def with_text(rows: DataFrame, words: DataFrame, column: str = "phrase") -> DataFrame:
    """Add the words of ``gram``, joined by blanks; ``gram`` is unique in ``rows``."""
    places = F.sequence(F.lit(0), (F.length("gram") / 8 - 1).cast("int"))
    each = rows.select("gram", F.posexplode(F.transform(places, lambda i: F.substring(F.col("gram"), i * 8 + 1, F.lit(8)))).alias("at", "key"))
    named = each.join(words.select("key", "word"), "key")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    return rows.join(named.groupBy("gram").agg(text.alias(column)), "gram")


def phrase_graph(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged (lang, key, word, n) of frequent words, (lang, n) of all words, and (gram, a) of frequent phrases."""
    texts = texts_of(documents)
    context = texts.sparkSession.sparkContext
    key = F.unhex(F.lpad(F.hex("key"), 16, "0"))
    counted = stage(word_counts(texts).filter((F.col("n") >= least) | F.col("word").isNull()).withColumn("number", F.col("key")).withColumn("key", key))
    words, totals = counted.filter("word is not null"), counted.filter("word is null").select("lang", "n")
    if words.count() != words.select("key").distinct().count():
        raise ValueError("two frequent words have the same 64-bit hash")
    word_bits = context.broadcast(bit_map(words, "number"))
    pair_bits = context.broadcast(bit_map(pair_counts(texts, word_bits).filter(F.col("n") >= least), "pair"))
    grams = stage(edges_and_ends(texts, word_bits, pair_bits, longest))
    word_bits.unpersist()
    pair_bits.unpersist()
    return words.drop("number"), totals, phrase_counts(grams, least, longest)


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of every lang."""
    words, totals, phrases = phrase_graph(documents, least, longest)
    whole = phrases.join(absorbed(phrases), "gram", "left").filter("through is null or through < a").select("gram", "a")
    langs = words.select(F.col("key").alias("first"), "lang")
    named = attach(whole.withColumn("first", _words("gram", 1, 1)).join(langs, "first"), totals.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"))
    counts = phrases.unionByName(words.select(F.col("key").alias("gram"), F.col("n").alias("a")))
    cuts = named.select("lang", "gram", "a", "n", F.explode(F.sequence(F.lit(1), (F.length("gram") / 8 - 1).cast("int"))).alias("cut"))
    parts = cuts.withColumns({
        "left": F.substring(F.col("gram"), F.lit(1), F.col("cut") * 8), "right": F.substring(F.col("gram"), F.col("cut") * 8 + 1, F.length("gram") - F.col("cut") * 8)
    })
    left, right = counts.select(F.col("gram").alias("left"), F.col("a").alias("l")), counts.select(F.col("gram").alias("right"), F.col("a").alias("r"))
    both = parts.join(left, "left").join(right, "right")
    # Decimals of 38 digits: products may pass 64 bits, the quotient is at most 1000 * n / least.
    score = F.expr(
        "(cast(a as decimal(18,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    )
    scored = both.withColumn("score", score)
    weakest = scored.groupBy("gram", "lang", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w")).select("gram", "lang", "a", "n", "w.score", "w.l", "w.r")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = stage(weakest.withColumn("place", F.rank().over(order)).filter(F.col("place") <= top).drop("place"))
    full = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = with_text(first, words).withColumn("rank", F.row_number().over(full)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
