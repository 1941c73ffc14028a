"""Seven writing-style signals of a review.

Characters are counted by Arrow batch from the bytes of the texts: a byte table knows the ASCII
ones, and white space beyond ASCII has few encodings. Other capitals and digits are left to Java's
classes, on what remains of a text without its ASCII characters.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plaudit.functions.rounding import rounded_ratio
from plaudit.functions.text import is_ascii
from plaudit.rules import SIGNAL_COLUMNS

# Decimal digits of every script plus super- and subscript and circled digits.
DIGIT_CLASS = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}"
)
UPPER_CLASS = r"\p{javaUpperCase}"
SLICE_BYTES = 1 << 20  # bytes counted at once
_SPACE, _BANG, _PUNCT, _UPPER, _DIGIT = 1, 2, 3, 4, 5
_KINDS = np.zeros(256, dtype=np.uint8)
for _kind, _chars in (
    (_SPACE, "\t\n\x0b\f\r\x1c\x1d\x1e\x1f "), (_PUNCT, string.punctuation), (_BANG, "!"),
    (_UPPER, string.ascii_uppercase), (_DIGIT, string.digits),
):
    _KINDS[list(_chars.encode())] = _kind
_COUNTED = ("words", "spaces", "bangs", "punct", "upper", "digits")


def _count(text: Column, pattern: str) -> Column:
    """Matches of a one-character class: what its removal takes off the length."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def _wide_spaces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where white space beyond ASCII begins in UTF-8: that of two bytes and that of three (see ``SPACE_CLASS``)."""
    lead = np.flatnonzero(data >= 0xC2)
    lead = lead[np.isin(data[lead], (0xC2, 0xE1, 0xE2, 0xE3))]
    after = np.append(data, np.zeros(2, dtype=np.uint8))
    a, b, c = after[lead], after[lead + 1], after[lead + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    e2 = ((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | np.isin(c, (0xA8, 0xA9, 0xAF)))) | ((b == 0x81) & (c == 0x9F))
    three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & e2) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return lead[two], lead[three]


def _count_slice(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The ``_COUNTED`` numbers of some texts that lie one after the other in ``data``."""
    kinds = _KINDS[data]
    space, wide = kinds == _SPACE, np.zeros(0, dtype=np.int64)
    if len(data) and data.max() >= 0x80:
        two, three = _wide_spaces(data)
        wide = np.sort(np.concatenate((two, three)))
        for at in (two, two + 1, three, three + 1, three + 2):
            space[at] = True
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[firsts] = ~space[firsts]

    def each(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, bounds))

    found = {kind: each(np.flatnonzero(kinds == kind)) for kind in (_SPACE, _BANG, _PUNCT, _UPPER, _DIGIT)}
    return np.stack((
        each(np.flatnonzero(begins)), found[_SPACE] + each(wide), found[_BANG], found[_BANG] + found[_PUNCT],
        found[_UPPER], found[_DIGIT],
    ))


@F.arrow_udf(StructType([StructField(name, LongType()) for name in _COUNTED]))
def _counts(texts: pa.Array) -> pa.Array:
    """Words and characters of each text; capitals and digits of ASCII only."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, places, held = texts.buffers()
    bounds = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if places else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(held, dtype=np.uint8) if held else np.zeros(0, dtype=np.uint8)
    found, first = [np.zeros((len(_COUNTED), 0), dtype=np.int64)], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, side="right")) - 1)
        part = bounds[first : last + 1]
        found.append(_count_slice(data[part[0] : part[-1]], part - part[0]))
        first = last
    return pa.StructArray.from_arrays([pa.array(row, pa.int64()) for row in np.concatenate(found, axis=1)], list(_COUNTED))


def with_signals(df: DataFrame, text_column: str = "review_text") -> DataFrame:
    """Add the signal columns; blank or null text gives 0.0 throughout.

    Counts are taken in one projection and the ratios in the next, so each
    pass over the text happens once.
    """
    text = F.col(text_column)
    keep = [F.col(c) for c in df.columns]
    beyond = F.when(F.coalesce(is_ascii(text), F.lit(True)), "").otherwise(F.regexp_replace(text, r"[\x00-\x7f]+", ""))
    counted = df.select(*keep, F.length(text).cast("bigint").alias("_chars"), beyond.alias("_beyond"), _counts(text.cast("string")).alias("_c"))

    def either(name: str, letters: str) -> Column:
        more = F.when(F.col("_beyond") == "", F.lit(0).cast("bigint")).otherwise(_count(F.col("_beyond"), letters))
        return F.col(f"_c.{name}") + more

    counts = counted.select(
        *keep, "_chars",
        F.col("_c.words").alias("_words"), F.col("_c.bangs").alias("_bangs"), F.col("_c.spaces").alias("_spaces"),
        F.col("_c.punct").alias("_punct"),
        either("upper", f"[{UPPER_CLASS}]").alias("_upper"), either("digits", f"[{DIGIT_CLASS}]").alias("_digits"),
    )
    chars, words = F.col("_chars"), F.col("_words")
    values = {
        "review_length": chars.cast("double"),
        "word_count": words.cast("double"),
        "exclamation_count": F.col("_bangs").cast("double"),
        "caps_ratio": rounded_ratio("_upper", "_chars"),
        "avg_word_length": rounded_ratio("_chars - _spaces", "_words"),
        "punctuation_density": rounded_ratio("_punct", "_chars"),
        "digit_ratio": rounded_ratio("_digits", "_chars"),
    }
    # A text without words is blank.
    return counts.select(
        *keep,
        *[F.when(words == 0, 0.0).otherwise(values[c]).alias(c) for c in SIGNAL_COLUMNS],
    )
