"""Phrases from the weighted graph against plain counts of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest
from oracle import difference, duck

from plaudit.llm import catalog, collocation

SF = "/root/testdata/sf0.01"


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain_counts(rows, longest):
    """{lang: {words: count}} of (lang, text) rows, and all words."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in pieces_of(text):
            totals[lang] += len(piece)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(piece[i : i + k]) for i in range(len(piece) - k + 1))
    return counts, totals


def plain_collocations(rows, least, longest, top):
    counts, totals = plain_counts(rows, longest)
    out = set()
    for lang, f in counts.items():
        n = totals[lang]
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {
            p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
            if 100 * a >= 100 * f[p[i : i + k]]
        }
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(9)] + ["été", "Ça", "b b", "x-1"]
    idiom, long = "as far as one can", "a chain of many words that never parts at all"
    rows = []
    for i in range(160):
        parts = []
        for _ in range(draw.randint(0, 12)):
            parts.append(draw.choice([idiom, long, long.upper(), *[" ".join(draw.choice(words) for _ in range(draw.randint(1, 7)))] * 4]))
            parts.append(draw.choice([" ", ", ", "\n", "!", "\t", "..", " . "]))
        rows.append((draw.choice(["en", "en", "de", None, "und", ""]), "".join(parts)))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, a, b, "clash", 1) for i, (a, b) in enumerate(rows)], "doc_id long, lang string, text string, key string, n int").repartition(parts)


@pytest.mark.parametrize("seed,least,longest,top", [(1, 3, 5, 2000), (2, 8, 5, 7), (3, 2, 4, 2000), (4, 5, 2, 50)])
def test_same_as_plain_counts(spark, seed, least, longest, top):
    rows = corpus(seed)
    found = [tuple(r) for r in collocation.collocations(frame(spark, rows), least, longest, top).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_collocations(rows, least, longest, top)


def test_counts_from_flow_same_as_plain(spark):
    rows = corpus(5)
    words, totals, phrases = collocation.phrase_graph(frame(spark, rows), 4, 5)
    named = collocation.with_text(phrases.join(words.select("key", "lang"), collocation._words("gram", 1, 1) == words["key"]).drop("key"), words)
    counts, n = plain_counts(rows, 5)
    wanted = {(lang, " ".join(p), a) for lang, f in counts.items() for p, a in f.items() if len(p) > 1 and a >= 4}
    assert {(r["lang"], r["phrase"], r["a"]) for r in named.collect()} == wanted
    assert {r["lang"]: r["n"] for r in totals.collect()} == dict(n)


def test_unary_paths(spark):
    """A phrase longer than an edge becomes one path; where a word varies, the path parts."""
    rows = [("en", "p q r s t u v w x y z")] * 5 + [("en", "k l m n o A b c d e f g")] * 4 + [("en", "k l m n o Z b c d e f g")] * 6
    words, _, phrases = collocation.phrase_graph(frame(spark, rows), 3, 5)
    paths = collocation.with_text(collocation.unary_paths(phrases), words)
    found = {(r["phrase"], r["edges"], r["least"]) for r in paths.select("phrase", "edges", "least").collect()}
    assert found == {
        ("p q r s t u v w x y z", 7, 5), ("k l m n o", 1, 10), ("l m n o a b c d e", 5, 4), ("l m n o z b c d e", 5, 6), ("b c d e f g", 2, 10),
    }


def test_pieces_and_words():
    text = "One two, THREE\tfour.\n\nfive ! été;: ,six seven\x0beight"
    import pyarrow as pa

    column = pa.array([text, None, "", "nine", " ,"])
    salts = np.zeros(5, dtype=np.uint64)
    words, joined = [], []
    for _, codes, starts, ends, _, _, link in collocation.chunk_words(column, salts):
        words += [codes.tobytes()[a:b].decode() for a, b in zip(starts, ends)]
        joined += link.tolist()
    pieces = [p for t in column.to_pylist() for p in pieces_of(t)]
    assert words == [w for p in pieces for w in p]
    assert joined == [i > 0 for p in pieces for i in range(len(p))]


def test_odd_rows_and_empty_table(spark):
    docs = edge.edge_docs(spark)
    found = collocation.collocations(docs, 2, 5, 2000)
    assert {tuple(r) for r in found.collect()} == plain_collocations([(None, r[1]) for r in edge.rows()], 2, 5, 2000)
    assert collocation.collocations(edge.empty_docs(spark)).count() == 0
    assert collocation.collocations(frame(spark, [("en", None), (None, " ")])).count() == 0


def test_query_same_as_sql(spark):
    assert not difference(catalog.op11_collocations(spark, SF), duck(SF), catalog.oracle_sql()["op11_collocations"])
