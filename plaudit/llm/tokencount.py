"""Edit-aware token counts: segment trees over the pre-tokens of every document.

A leaf stands for up to ``LEAF`` pre-tokens and keeps their characters and tokens; an
inner node keeps the sums of ``FANOUT`` nodes below. An edit removes and adds characters
at a place. It is re-encoded from the leaf that holds the place three characters before
it (the pattern looks at most two characters past a piece) up to the first pre-token end
that is also an end of an old leaf behind the edit: from there on the pattern, which
never looks back, sees the same text. Only the leaves between are replaced and only sums
above them are renewed.

Building is one pass over the texts, editing another one in the same stage; nothing is
shuffled unless edits come as a table of their own (``with_edits``, joined by doc_id).
Null texts and edits count as empty. Places beyond the text are its end, and negative ones
its start; edits are applied in their order, each to the text that the ones before
left. A doc_id that occurs more than once gets its edits in every row; edits without a
doc_id meet nothing. Further columns are ignored, empty tables stay empty.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaudit.llm.bpe import PATTERN, Encoder, encoder
from plaudit.llm.common import columns_of, map_columns

LEAF, FANOUT = 64, 16
BACK = 3  # characters that a piece's end may depend on, and one more
TREE = "leaf_chars array<int>, leaf_tokens array<int>"
EDITS = "array<struct<at:int,removed:int,added:string>>"
_PIECE = regex.compile(PATTERN)


class TokenTree:
    """Sums of characters and tokens, level by level, over the leaves of one text."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.levels = [(list(chars), list(tokens))]
        self._renew(0, grown=True)

    def _renew(self, first: int, grown: bool, last: int | None = None) -> None:
        """Sums above the leaves ``first`` to ``last``; above all later ones if places have moved."""
        level = 0
        while len(self.levels[level][0]) > 1:
            below = self.levels[level]
            size = -(-len(below[0]) // FANOUT)
            if level + 1 == len(self.levels):
                self.levels.append(([], []))
            first //= FANOUT
            stop = size if grown else min(size, last // FANOUT + 1)
            last = stop - 1
            for sums, under in zip(self.levels[level + 1], below):
                fresh = [sum(under[i * FANOUT : (i + 1) * FANOUT]) for i in range(first, stop)]
                sums[first : len(sums) if grown else stop] = fresh
            level += 1
        del self.levels[level + 1 :]

    @property
    def tokens(self) -> int:
        return sum(self.levels[-1][1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character; the last leaf beyond the end."""
        leaf, start = 0, 0
        for chars, _ in reversed(self.levels):
            stop = min(len(chars), leaf + FANOUT)
            while leaf < stop - 1 and start + chars[leaf] <= place:
                start += chars[leaf]
                leaf += 1
            leaf *= FANOUT
        return leaf // FANOUT, start

    def edit(self, text: str, at: int, removed: int, added: str, encode: Encoder) -> tuple[str, int]:
        """The new text and the number of pre-tokens that were encoded for it."""
        at = min(max(at, 0), len(text))
        removed = min(max(removed, 0), len(text) - at)
        new = text[:at] + added + text[at + removed :]
        chars, tokens = self.levels[0]
        leaf, start = self.leaf_at(max(at - BACK, 0)) if chars else (0, 0)
        # Ends of the old leaves from here on, as places in the new text.
        moved = len(added) - removed
        ends = list(itertools.accumulate(chars[leaf:], initial=start))[1:]
        behind = bisect.bisect_left(ends, at + removed)
        wanted = {end + moved: leaf + behind + i + 1 for i, end in enumerate(ends[behind:])}
        fresh: list[tuple[int, int]] = []
        stop = len(chars)
        for found in _PIECE.finditer(new, start):
            fresh.append((found.end() - found.start(), encode.count_piece(found[0])))
            if found.end() in wanted:
                stop = wanted[found.end()]
                break
        groups = [fresh[i : i + LEAF] for i in range(0, len(fresh), LEAF)]
        grown = len(groups) != stop - leaf
        chars[leaf:stop] = [sum(c for c, _ in g) for g in groups]
        tokens[leaf:stop] = [sum(t for _, t in g) for g in groups]
        self._renew(leaf, grown, max(leaf + len(groups) - 1, 0))
        return new, len(fresh)


def _leaves(chars: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(chars):
        return chars, tokens
    cuts = np.arange(0, len(chars), LEAF)
    return np.add.reduceat(chars, cuts), np.add.reduceat(tokens, cuts)


def build_trees(documents: DataFrame, vocabulary: str, *keep: str) -> DataFrame:
    """doc_id, text, the columns ``keep`` and the leaves (leaf_chars, leaf_tokens) of every text's tree."""
    docs = columns_of(documents, "doc_id", "text", *keep).withColumn("text", F.coalesce("text", F.lit("")))

    def make():
        def work(batch):
            pairs = [_leaves(*pair) for pair in encoder(vocabulary).count(batch.column("text"))]
            return {name: pa.array([pair[i] for pair in pairs], pa.list_(pa.int32())) for i, name in enumerate(("leaf_chars", "leaf_tokens"))}

        return work

    return map_columns(docs, make, docs.columns, TREE)


def with_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) with the column ``edits`` from rows (doc_id, version, at, removed, added)."""
    steps = columns_of(edits, "doc_id", "version", "at", "removed", "added").filter("doc_id is not null")
    one = F.struct("version", "at", "removed", "added")
    per = steps.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("e"))
    lists = per.select("doc_id", F.transform("e", lambda x: F.struct(x["at"].cast("int").alias("at"), x["removed"].cast("int").alias("removed"), x["added"].alias("added"))).alias("edits"))
    return columns_of(documents, "doc_id", "text").join(lists, "doc_id", "left")


def apply_edits(trees: DataFrame, vocabulary: str) -> DataFrame:
    """New text and leaves, tokens before and after, pre-tokens encoded, of rows with trees and ``edits``."""

    def make():
        def work(batch):
            encode = encoder(vocabulary)
            out = {name: [] for name in ("new_text", "new_chars", "new_tokens", "n_before", "n_after", "n_encoded")}
            for text, chars, tokens, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits"))):
                tree, encoded = TokenTree(chars, tokens), 0
                before = tree.tokens
                for edit in edits or ():
                    if edit is not None:
                        text, n = tree.edit(text, edit["at"] or 0, edit["removed"] or 0, edit["added"] or "", encode)
                        encoded += n
                leaves = tree.levels[0]
                for name, value in zip(out, (text, leaves[0], leaves[1], before, tree.tokens, encoded)):
                    out[name].append(value)
            ints = pa.list_(pa.int32())
            kinds = (pa.string(), ints, ints, pa.int64(), pa.int64(), pa.int64())
            return {name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)}

        return work

    rows = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")
    schema = "new_text string, new_chars array<int>, new_tokens array<int>, n_before long, n_after long, n_encoded long"
    return map_columns(rows, make, rows.columns, schema)
