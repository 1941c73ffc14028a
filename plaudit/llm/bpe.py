"""Token numbers of many texts at once with a published byte-level BPE vocabulary.

Texts are cut into pre-tokens by array operations on their code points, following
the vocabulary's pattern (contractions, an optional blank before letters, digits or
other marks, runs of white space). A piece is encoded by the library once for each
worker and then found by a 64-bit hash of its code points.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken

from plaudit.llm.common import mix64, span_hashes, text_bytes

# Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 1 << 17
FIRST_PIECES = 1 << 14
MAX_PIECES = 1 << 21  # remembered pieces for each worker; tables grow up to it, beyond it the memory starts anew
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
# The characters that \s matches.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    global _kinds
    if _kinds is None:
        major = {"L": _LETTER, "N": _NUMBER}
        _kinds = np.fromiter((major.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        _kinds[_SPACES] = _SPACE
    return _kinds


def piece_starts(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks the first code point of every pre-token; ``rows`` are the texts' first positions."""
    kind = _kind_table()[codes]
    start = np.ones(len(codes) + 1, dtype=bool)  # the last one stands for the end
    np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
    start[rows] = True
    fresh = np.zeros(len(codes) + 1, dtype=bool)
    fresh[rows] = True
    fresh[-1] = True
    # White space before a word: its last character stands alone, or joins the word if it is a blank.
    word = np.flatnonzero(start[1:-1] & ~fresh[1:-1] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    start[word - 1] = True
    start[word[codes[word - 1] == 0x20]] = False
    # Contractions: an apostrophe that is a run of its own and begins a piece.
    mark = np.flatnonzero((codes == 0x27) & start[:-1])
    mark = mark[(mark + 1 < len(codes))]
    mark = mark[(kind[mark + 1] == _LETTER) & ~fresh[mark + 1]]
    for at in mark.tolist():
        tail = "".join(map(chr, codes[at + 1 : at + 3].tolist()))
        size = 1 if tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") and not fresh[at + 2] else 0
        if size:
            start[at + 1] = False
            end = at + 1 + size
            start[end] = True
    return start[:-1]


class Encoder:
    """Texts to token numbers; ``path`` names a file of base64 pieces and ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.vocabulary = max(ranks.values()) + 1
        self._library = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self._known = 0
        self._first = np.zeros(FIRST_PIECES + 1, dtype=np.int64)
        self._tokens = np.zeros(1 << 18, dtype=np.uint16)
        self._names = np.zeros(FIRST_PIECES, dtype=np.uint64)
        self._rehash(4 * FIRST_PIECES)

    def _rehash(self, slots: int) -> None:
        """A table of so many places with all known pieces."""
        self._slots = slots
        self._keys = np.zeros(slots, dtype=np.uint64)
        self._piece = np.zeros(slots, dtype=np.int32)
        self._place(self._names[: self._known], np.arange(self._known))

    def _place(self, keys: np.ndarray, number: np.ndarray) -> None:
        slot, open_ = (keys % np.uint64(self._slots)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            free = open_[self._keys[slot[open_]] == 0]
            self._keys[slot[free]] = keys[free]
            placed = self._keys[slot[open_]] == keys[open_]
            self._piece[slot[open_[placed]]] = number[open_[placed]]
            open_ = open_[~placed]
            slot[open_] = (slot[open_] + 1) % self._slots

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each key, or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        slot = (keys % np.uint64(self._slots)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self._keys[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self._piece[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
            slot[open_] = (slot[open_] + 1) % self._slots
        return found

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        lists = [self._library.encode_ordinary(piece) for piece in pieces]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((t for one in lists for t in one), np.uint16, int(sizes.sum()))
        used = self._first[self._known]
        while used + len(flat) > len(self._tokens):
            self._tokens = np.concatenate((self._tokens, np.zeros_like(self._tokens)))
        self._tokens[used : used + len(flat)] = flat
        upto = self._known + len(lists)
        while upto > len(self._names):
            self._names = np.concatenate((self._names, np.zeros_like(self._names)))
            self._first = np.concatenate((self._first, np.zeros(len(self._first) - 1, dtype=np.int64)))
        self._first[self._known + 1 : upto + 1] = used + np.cumsum(sizes)
        self._names[self._known : upto] = keys
        number = np.arange(self._known, upto)
        self._known = upto
        if 2 * upto > self._slots:
            self._rehash(4 * len(self._names))
        else:
            self._place(keys, number)

    def encode(self, column: pa.Array):
        """Yields (token numbers, bounds) for some rows at a time; null is an empty text."""
        for codes, rows in self._chunks(column):
            starts, piece = self._pieces(codes, rows)
            size = self._first[piece + 1] - self._first[piece]
            upto = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(size)))
            tokens = self._tokens[np.repeat(self._first[piece] - upto[:-1], size) + np.arange(upto[-1])]
            yield tokens, upto[np.searchsorted(starts, rows)]

    def count(self, column: pa.Array):
        """Yields (characters, tokens) of the pre-tokens of every row."""
        for codes, rows in self._chunks(column):
            starts, piece = self._pieces(codes, rows)
            size = self._first[piece + 1] - self._first[piece]
            chars = np.diff(np.append(starts, len(codes)))
            cuts = np.searchsorted(starts, rows)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield chars[a:b], size[a:b]

    def count_piece(self, piece: str) -> int:
        return len(self._library.encode_ordinary(piece))

    def _chunks(self, column: pa.Array):
        raw, bounds = text_bytes(column)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(bounds, bounds[first] + CHUNK_CHARS, side="right")) - 1
            last = min(max(last, first + 1), len(column))
            part = raw[bounds[first] : bounds[last]]
            codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
            leads = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum((part & 0xC0) != 0x80)))
            rows = leads[bounds[first : last + 1] - bounds[first]]
            yield codes, rows
            first = last

    def _pieces(self, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code points and numbers of all pre-tokens of a chunk."""
        if not len(codes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        starts = np.flatnonzero(piece_starts(codes, rows[:-1][rows[:-1] < len(codes)]))
        ends = np.append(starts[1:], len(codes))
        keys = mix64(span_hashes(codes, starts, ends)) | np.uint64(1)
        piece = self._find(keys)
        missing = np.flatnonzero(piece < 0)
        if len(missing):
            fresh, at = np.unique(keys[missing], return_index=True)
            if self._known + len(fresh) > MAX_PIECES:
                self._forget()
                fresh, at = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            at = missing[at]
            text = codes.tobytes().decode("utf-32-le")
            self._learn(fresh, [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            piece[missing] = self._find(keys[missing])
        return starts, piece


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary file, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
