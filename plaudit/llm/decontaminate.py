"""Benchmark decontamination with a positional inverted index of the training texts.

1. Items are cut into windows of ``WINDOW`` consecutive words (a shorter item is one
   window). One pass counts how often each item word occurs in the training texts.
2. ``build_index`` stores postings (term, text, position) of the terms that some window has
   among its ``RAREST`` rarest words; frequent words are posted only where a window has
   nothing rarer. The index is distributed by texts: a shard has all lists of its texts.
3. ``phrase_candidates`` goes through the list of each window's rarest word, shifted by the
   word's offset, and probes the other chosen words' lists at these places only: a text and
   start survive if every chosen word stands there.
4. ``window_hits`` compares the surviving places word by word with the whole text.
With ``slop`` > 0, ``proximity_matches`` takes the place of step 3: it uses the same
lists with a tolerance instead of equal starts, and finds the exact places too. A window
is near where at most ``slop`` words for every ``WINDOW`` of its own are put in, left out
or replaced; windows shorter than that are near only where they are exact. Step 4 then
checks all words of the window for both, and exact hits stay as they are.

Items are worked off in blocks of about ``BLOCK_WORDS`` words, so what is broadcast has
a bound and any number of items costs passes, not memory. Training texts are keyed by
a hash of their content: places of copies are united and found together.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case. Null, empty
and wordless texts have no words and no hits; such items have no windows. A null
item_id still makes hits but is not listed. Rows with equal doc_id, or without one,
are each judged by their own text. Other columns are ignored (``contamination``) or
kept (``drop_contaminated``). Empty tables give empty or clean results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import columns_of, map_columns, slices, stage, text_bytes

WINDOW = 10
RAREST = 3
SLOP = 1
BLOCK_WORDS = 400_000
SHARD_PLACES = 1 << 18
BROADCAST_BYTES = 32 << 20

# Bytes between words become blanks, A-Z become a-z; bytes from 0x80 on are letters.
_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Items:
    """One block of items: their words as term numbers, and the windows."""

    ids: list  # item_id of every item
    terms: dict  # word -> term number
    words: list  # term numbers of every item
    windows: list  # (item, first word, length)


def _texts(column: pa.Array):
    raw, bounds = text_bytes(column)
    data = raw[bounds[0] : bounds[-1]].tobytes()
    bounds = bounds - bounds[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield data[a:b]


def _blocks(benchmark: DataFrame, window: int):
    items = columns_of(benchmark, "item_id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // (BLOCK_WORDS * 6)))
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).dropDuplicates()
        found = rows.orderBy("item_id", "text").collect()
        block = Items([], {}, [], [])
        for item_id, text in found:
            numbers = [block.terms.setdefault(w, len(block.terms)) for w in words_of(text.encode("utf-8"))]
            if numbers:
                length = min(window, len(numbers))
                block.windows.extend((len(block.ids), k, length) for k in range(len(numbers) - length + 1))
                block.ids.append(item_id)
                block.words.append(numbers)
        if block.ids:
            yield block


def _term_counts(texts: DataFrame, shared) -> np.ndarray:
    """Occurrences of every term of the block in the training texts."""
    size = len(shared.value.terms)

    def count(batches):
        terms, total = shared.value.terms, np.zeros(size, dtype=np.int64)
        for batch in slices(batches):
            found = [n for text in _texts(batch.column("text")) for n in map(terms.get, words_of(text)) if n is not None]
            total += np.bincount(np.array(found, dtype=np.int64), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int64()), "n": pa.array(total[seen])})

    counts = np.zeros(size, dtype=np.int64)
    for term, n in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        counts[term] = n
    return counts


def _tolerance(length: int, slop: int) -> int:
    """Words of a window of this length that may be put in, left out or replaced."""
    return slop * (length // WINDOW)


def _rarest(block: Items, counts: np.ndarray, rarest: int, slop: int = 0) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """(term, offset) of the rarest words of every window that occur, and how many of them may be missing.

    A word that is nowhere uses up one edit of the window; each edit left can spoil one
    chosen word. With more such words than edits there is no place and nothing is chosen.
    """
    chosen, spare = [], []
    for item, first, length in block.windows:
        terms = block.words[item][first : first + length]
        there = [o for o in range(length) if counts[terms[o]]]
        left = _tolerance(length, slop) - (length - len(there))
        offsets = sorted(there, key=lambda o: (counts[terms[o]], terms[o], o))[: max(rarest, left + 1)]
        usable = left >= 0 and len(offsets) > left
        chosen.append([(terms[o], o) for o in offsets] if usable else [])
        spare.append(left if usable else 0)
    return chosen, spare


def build_index(texts: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """The stored postings of ``terms`` in shards of some texts.

    A shard is one row: the keys of its texts, and its postings (term, text, place) in order
    as arrays of integers. All lists of a text stand in one shard, so intersecting lists moves
    nothing between tasks. ``SHARD_PLACES`` bounds a shard, unless one text has more.
    """
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def shard(keys, found):
        numbers = np.repeat(np.arange(len(found), dtype=np.int64), [len(f[0]) for f in found])
        at, term = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((at, numbers, term))
        arrays = (np.array(keys, dtype=np.int64), term[order].astype(np.int32), numbers[order].astype(np.int32), at[order].astype(np.int32))
        return pa.RecordBatch.from_pydict({name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("keys", "terms", "texts", "places"), arrays)})

    def post(batches):
        known = shared.value
        for batch in slices(batches):
            keys, found, size = [], [], 0
            for key, text in zip(batch.column("text_key").to_pylist(), _texts(batch.column("text"))):
                numbers = np.array([-1 if n is None else n for n in map(known.get, words_of(text))], dtype=np.int64)
                at = np.flatnonzero(numbers >= 0)
                if len(at):
                    keys.append(key)
                    found.append((at, numbers[at]))
                    size += len(at)
                    if size >= SHARD_PLACES:
                        yield shard(keys, found)
                        keys, found, size = [], [], 0
            if found:
                yield shard(keys, found)

    return stage(texts.mapInArrow(post, "keys binary, terms binary, texts binary, places binary"))


@dataclass(frozen=True)
class Keys:
    """The chosen words of every window, rarest first, as tables of windows x ranks (term -1: none)."""

    terms: np.ndarray
    offsets: np.ndarray
    wanted: np.ndarray  # words that have to be there
    leads: np.ndarray  # of so many ranks, one is there


def _keys(chosen: list[list[tuple[int, int]]], spare: list[int]) -> Keys:
    width = max(map(len, chosen), default=0)
    terms, offsets = np.full((len(chosen), width), -1, dtype=np.int64), np.zeros((len(chosen), width), dtype=np.int64)
    for w, keys in enumerate(chosen):
        for r, (term, offset) in enumerate(keys):
            terms[w, r], offsets[w, r] = term, offset
    size = (terms >= 0).sum(axis=1)
    spared = np.array(spare, dtype=np.int64)
    return Keys(terms, offsets, size - spared, np.minimum(spared + 1, size))


def _intersected(keys: Keys, terms: np.ndarray, texts: np.ndarray, places: np.ndarray, count: int, slop: int):
    """(window, text, start) of a shard: lists of the rarest words first, then the others at their places only."""
    code = ((terms.astype(np.int64) * count + texts) << 32) + places
    windows, ranks = np.nonzero(np.arange(keys.terms.shape[1]) < keys.leads[:, None])
    low = np.searchsorted(terms, keys.terms[windows, ranks], side="left")
    size = np.searchsorted(terms, keys.terms[windows, ranks], side="right") - low
    upto = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(size)))
    first = 0
    while first < len(windows):
        last = min(max(int(np.searchsorted(upto, upto[first] + SHARD_PLACES, side="right")) - 1, first + 1), len(windows))
        key = np.repeat(np.arange(first, last), size[first:last])
        at = low[key] + np.arange(len(key)) - (upto[key] - upto[first])
        window, text = windows[key], texts[at].astype(np.int64)
        start = places[at] - keys.offsets[window, ranks[key]]
        held, met = start >= -slop, np.zeros(len(key), dtype=np.int64)
        for rank in range(keys.terms.shape[1]):
            # Only places that can still have all words wanted are probed further.
            left = (keys.terms[window, rank:] >= 0).sum(axis=1)
            held &= met + left >= keys.wanted[window]
            window, text, start, met, held = window[held], text[held], start[held], met[held], held[held]
            term = keys.terms[window, rank]
            base = ((term * count + text) << 32) + start + keys.offsets[window, rank]
            found = np.searchsorted(code, base - slop)
            near = (found < len(code)) & (code[np.minimum(found, len(code) - 1)] <= base + slop)
            met += near & (term >= 0)
        held = met >= keys.wanted[window]
        yield np.stack((window[held], text[held], start[held]), axis=1)
        first = last


def proximity_matches(index: DataFrame, chosen: list[list[tuple[int, int]]], slop: int, spare: list[int] | None = None) -> DataFrame:
    """(window, text_key, start): the chosen words, each within ``slop`` words of its place.

    ``spare`` says for every window how many chosen words may be missing (none by default).
    ``start`` is every start of one of the ``spare`` + 1 rarest words for which enough others
    lie at most ``slop`` away; ``slop=0`` without spare words gives the phrase candidates.
    Only the lists of those rarest words are gone through; the others are probed at their places.
    """
    shared = index.sparkSession.sparkContext.broadcast(_keys(chosen, spare or [0] * len(chosen)))

    def intersect(batches):
        keys = shared.value
        for batch in batches:
            for row in zip(*[batch.column(name).to_pylist() for name in ("keys", "terms", "texts", "places")]):
                names, terms, texts, places = (np.frombuffer(x, dtype=kind) for x, kind in zip(row, (np.int64, np.int32, np.int32, np.int32)))
                parts = list(_intersected(keys, terms, texts, places, len(names), slop))
                if parts:
                    found = np.unique(np.concatenate(parts), axis=0)
                    yield pa.RecordBatch.from_pydict({"window": found[:, 0], "text_key": names[found[:, 1]], "start": found[:, 2]})

    return index.mapInArrow(intersect, "window long, text_key long, start long").distinct()


def phrase_candidates(index: DataFrame, chosen: list[list[tuple[int, int]]]) -> DataFrame:
    """(window, text_key, start) at which all chosen words of a window stand: positions less the offset, intersected."""
    return proximity_matches(index, chosen, 0)


def _within(words: list[int], text: list, edits: int) -> bool:
    """Whether ``text`` begins with ``words`` but for so many words put in, left out or replaced."""
    at = 0
    while at < len(words) and at < len(text) and words[at] == text[at]:
        at += 1
    if len(words) - at <= edits:
        return True
    if not edits:
        return False
    words, text = words[at:], text[at:]
    return (
        _within(words[1:], text[1:], edits - 1) or _within(words[1:], text, edits - 1)
        or bool(text) and _within(words, text[1:], edits - 1)
    )


def near_at(words: list[int], text: list, at: int, slop: int) -> bool:
    """Whether a place of ``text`` that begins at most ``slop`` words from ``at`` is near ``words``."""
    edits = _tolerance(len(words), slop)
    size = len(words) + edits
    return any(_within(words, text[a : a + size], edits) for a in range(max(0, at - edits), max(0, at + edits) + 1))


def _marked(rows: DataFrame, shared, slop: int) -> DataFrame:
    """Check of the candidate places of every text: exact hit runs of words, their items, and near items."""

    def make():
        block = shared.value
        terms, windows, words = block.terms, block.windows, block.words
        names = [None if i is None else str(i) for i in block.ids]

        def work(batch):
            spans, items, near, loose = [], [], [], []
            for text, places in zip(_texts(batch.column("text")), batch.column("places").to_pylist()):
                hits, met, close = [], set(), set()
                numbers = list(map(terms.get, words_of(text)))
                for place in places:
                    item, first, length = windows[place["window"]]
                    at = place["start"]
                    if at >= 0 and numbers[at : at + length] == words[item][first : first + length]:
                        hits.append((at, at + length))
                        met.add(names[item])
                    elif slop and item not in close and near_at(words[item][first : first + length], numbers, at, slop):
                        close.add(item)
                spans.append([{"a": a, "b": b} for a, b in merged(hits)])
                items.append(sorted(met - {None}))
                near.append(sorted((met | {names[i] for i in close}) - {None}))
                loose.append(bool(hits or close))
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            return {"spans": pa.array(spans, kind), "items": pa.array(items, pa.list_(pa.string())),
                    "near_items": pa.array(near, pa.list_(pa.string())), "near": pa.array(loose, pa.bool_())}

        return work

    return map_columns(rows, make, rows.columns, "spans array<struct<a:int,b:int>>, items array<string>, near_items array<string>, near boolean")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans united."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _few(df: DataFrame, row_bytes: Column) -> DataFrame:
    """A staged table, marked for broadcast only if it is measured to be small."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def window_hits(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST, slop: int = 0) -> DataFrame:
    """(text_key, text_md5, spans, items, near_items) of every text with a hit; ``texts`` has text_key and text.

    With ``slop`` also the texts that are only near an item; they have no spans.
    """
    found = texts.sparkSession.createDataFrame(
        [], "text_key long, text_md5 string, spans array<struct<a:int,b:int>>, items array<string>, near_items array<string>"
    )
    for block in _blocks(benchmark, window):
        shared = texts.sparkSession.sparkContext.broadcast(block)
        chosen, spare = _rarest(block, _term_counts(texts, shared), rarest, slop)
        used = {t for keys in chosen for t, _ in keys}
        if not used:
            shared.unpersist()
            continue
        index = build_index(texts, {w: n for w, n in block.terms.items() if n in used})
        edits = _tolerance(window, slop)
        met = (proximity_matches(index, chosen, edits, spare) if edits else phrase_candidates(index, chosen)).groupBy("text_key")
        places = stage(met.agg(F.collect_list(F.struct("window", "start")).alias("places")))
        held = texts.join(_few(places, 16 * F.size("places") + 64), "text_key").select("text_key", "text", "places")
        marked = _marked(held, shared, slop).filter("near")
        hit = marked.select("text_key", F.md5("text").alias("text_md5"), "spans", "items", "near_items")
        found = found.unionByName(hit.dropDuplicates(["text_key", "text_md5"]))
    merged_rows = found.groupBy("text_key", "text_md5").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")],
    )
    return stage(merged_rows)


def covered(spans: Column) -> Column:
    """Words inside the union of (a, b) spans."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto"))

    def add(state, span):
        fresh = F.greatest(F.lit(0), span["b"] - F.greatest(span["a"], state["upto"]))
        return F.struct((state["total"] + fresh).alias("total"), F.greatest(state["upto"], span["b"]).alias("upto"))

    return F.coalesce(F.aggregate(F.array_sort(spans), start, add, lambda state: state["total"]), F.lit(0).cast("long"))


def _keyed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({"text_key": F.xxhash64(text), "text_md5": F.md5(text)})


def _counted(docs: DataFrame) -> DataFrame:
    def make():
        return lambda batch: {"n_words": pa.array([len(words_of(text)) for text in _texts(batch.column("text"))], pa.int64())}

    return map_columns(docs, make, docs.columns, "n_words long")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    These are exact. With ``slop`` also n_near_items: the items, exact ones among them, of
    which the text holds a window with up to so many words put in, left out or replaced.
    """
    docs = columns_of(documents, "doc_id", "text")
    hits = window_hits(docs.select("text", F.xxhash64("text").alias("text_key")), benchmark, window, slop=slop)
    narrow = _counted(_keyed(docs, "text")).drop("text")
    size = 12 * F.size("spans") + F.length(F.array_join("items", ",")) + F.length(F.array_join("near_items", ",")) + 128
    joined = narrow.join(_few(hits, size), ["text_key", "text_md5"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = covered(F.col("spans"))
    near = [F.coalesce(F.size("near_items"), F.lit(0)).cast("long").alias("n_near_items")] if slop else []
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *near,
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents`` without any hit, with all their columns."""
    names = documents.columns
    text = f"c{names.index('text')}"
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    hits = window_hits(plain.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_key")), benchmark, window)
    keys = _few(hits.select("text_key", "text_md5"), F.lit(64))
    return _keyed(plain, text).join(keys, ["text_key", "text_md5"], "left_anti").drop("text_key", "text_md5").toDF(*names)
