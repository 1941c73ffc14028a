"""Documents with every odd case, and plain re-statements of the operators' rules."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "`TEXT` string, Doc_ID long, score double, size int, n int, vertex long, c0 string, k string"
)
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


def rows() -> list[tuple]:
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of them today"
    near = base.replace("today", "tonight")
    texts = [
        (1, base, "a"), (2, near, "a"), (3, base, "b"), (3, base, "b"), (4, None, "a"), (5, "", "b"), (6, " \n\t ", None),
        (7, "one two", "a"), (8, "One TWO", "c"), (None, base, "a"), (None, "alone here", None), (9, LONG, "a"),
        (10, "été “ça” 😀 a b", "c"), (11, "x " * 40, "b"), (12, "line\nline\n\nline\nother", "c"),
    ]
    return [(i, t, None, s, None, "clash", -1, 0.5, 3, 4, 5, "c", "k") for i, t, s in texts]


def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def families(seed: int = 5, groups: int = 12, least: int = 20, most: int = 120) -> list[str]:
    """Texts with exact and near copies of different closeness, and a shared passage."""
    draw = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    passage = [draw.choice(words) for _ in range(30)]
    out = []
    for _ in range(groups):
        text = [draw.choice(words) for _ in range(draw.randint(least, most))]
        if draw.random() < 0.5:
            text += passage
        out.append(" ".join(text))
        for _ in range(draw.choice([0, 1, 3, 8])):
            copy = list(text)
            for _ in range(draw.choice([0, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append(" ".join(copy))
    return out


def shingles(text: str | None) -> set[tuple]:
    words = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return set()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(texts: list[str | None]) -> list[int]:
    """Number of the component of every text, by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 75 * (len(a) + len(sets[j]) - common) and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    return part


def bag(df) -> Counter:
    return Counter(tuple(row) for row in df.collect())
