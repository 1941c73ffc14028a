from __future__ import annotations

import string

from pyspark.sql import functions as F

from plaudit.functions import signals as sg
from plaudit.functions import text as tx
from plaudit.functions.rounding import rounded_ratio
from plaudit.functions.signals import with_signals
from plaudit.operators import tfidf as tf
from plaudit.operators.lemmas import lemmatise
from plaudit.operators.preprocess import process_reviews
from plaudit.rules import SIGNAL_COLUMNS
from plaudit.sources.readers import small_table


def expected_signals(text):
    if text is None or not text.strip():
        return [0.0] * 7
    words, n = text.split(), len(text)
    return [
        float(n), float(len(words)), float(text.count("!")),
        round(sum(c.isupper() for c in text) / n, 4),
        round(sum(map(len, words)) / len(words), 4),
        round(sum(c in string.punctuation for c in text) / n, 4),
        round(sum(c.isdigit() for c in text) / n, 4),
    ]


def table(spark, texts):
    return small_table(spark, {"review_id": range(len(texts)), "review_text": texts}, "review_id bigint, review_text string")


def test_ratio_rounds_like_python(spark):
    pairs = [(k, n) for n in range(1, 700) for k in range(0, n + 1, 1 if n % 32 == 0 else 7)]
    df = small_table(spark, {"k": [p[0] for p in pairs], "n": [p[1] for p in pairs]}, "k bigint, n bigint")
    rows = df.select("k", "n", rounded_ratio("k", "n").alias("x"), rounded_ratio("k", "n", 3).alias("y"))
    for row in rows.collect():
        assert row["x"] == round(row["k"] / row["n"], 4)
        assert row["y"] == round(row["k"] / row["n"], 3)


def test_signals_equal_python(spark):
    texts = [
        "Really GREAT kettle!!! Boils in 2 minutes!!", "ok", None, "", "   ", "\t\n", "  ",
        "Tabs\tand\nlines and wide　blanks", "ÄÖÜ straße Ñandú №5 ¡hola!", "😀😀 Wow 😀 ²³ ①",
        "a" * 31 + "B", "1234567890 " * 50, "x\x1cy\x1dz", "_-+=[]{}|\\:;\"'<>,.?/~`@#$%^&*()!",
        "word " * 20_000,
    ]
    got = {r["review_id"]: [r[c] for c in SIGNAL_COLUMNS] for r in with_signals(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == expected_signals(text), (i, got[i], expected_signals(text))


def test_signals_count_without_classes_over_the_text(spark, monkeypatch):
    monkeypatch.setattr(sg, "SLICE_BYTES", 16)
    odd = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["\U0001d400", "\U0001f600", "\U0001d7ce"]
    texts = [f"{c}a {c}{c}!" for c in odd] + ["".join(odd), None, "", "\u3000\x85"]
    rows = table(spark, texts)
    got = with_signals(rows)
    # Every class by its own pass over the text, as Java sees it.
    text, classes = F.col("review_text"), {"caps_ratio": sg.UPPER_CLASS, "punctuation_density": r"\p{Punct}", "digit_ratio": sg.DIGIT_CLASS}
    spaces = sg._count(text, f"[{tx.SPACE_CLASS}]")
    counts = rows.select(
        "review_id", tx.is_blank(text).alias("blank"), F.length(text).cast("bigint").alias("n"),
        (F.length(text) - spaces).alias("dark"), *[sg._count(text, f"[{c}]").alias(name) for name, c in classes.items()],
        F.size(F.filter(F.split(text, f"[{tx.SPACE_CLASS}]+"), lambda w: w != "")).cast("bigint").alias("words"),
    )
    shares = {name: rounded_ratio(name, "n") for name in classes} | {"avg_word_length": rounded_ratio("dark", "words")}
    shares["word_count"] = F.col("words").cast("double")
    wanted = counts.select("review_id", *[F.when(F.col("blank"), 0.0).otherwise(c).alias(name) for name, c in shares.items()])
    assert sorted(got.select(*wanted.columns).collect()) == sorted(wanted.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(review_text") == 1  # takes the ASCII characters away


def test_words_split_as_the_class_says(spark):
    texts = [f"a{chr(c)}b" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = table(spark, texts)
    plain = F.filter(F.split("review_text", f"[{tx.SPACE_CLASS}]+"), lambda w: w != "")
    assert not rows.filter(tx.split_words(F.col("review_text")) != plain).count()
    assert rows.filter(F.size(tx.split_words(F.col("review_text"))) == 2).count() == sum(len(t.split()) == 2 for t in texts)


def test_clean_text(spark):
    texts = [
        "Read MORE at http://x.example/a?b=1 or www.y.example <b>now</b>!",
        "I cannot wait, gonna buy two boxes of batteries", None, "  ", "The the THE of", "Women's dresses & brushes: 100%",
    ]
    stop = tx.english_stop_words()
    rows = table(spark, texts).select("review_id", tx.clean_text(F.col("review_text"), stop).alias("c")).orderBy("review_id")
    assert [r["c"] for r in rows.collect()] == [
        "read", "wait gon na buy two box battery", "", "", "", "woman dress brush",
    ]


def test_process_table_columns(spark):
    df = process_reviews(table(spark, ["One two"]))
    assert df.columns == ["review_id", "review_text", "cleaned_review", *SIGNAL_COLUMNS]


def test_ngrams(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "id int, t array<string>")
    got = {r["id"]: r["g"] for r in df.select("id", tx.word_ngrams(F.col("t")).alias("g")).collect()}
    assert got == {1: ["a", "b", "c", "a b", "b c"], 2: ["a"], 3: []}


def test_lemma_table_keeps_order_and_empty_rows(spark):
    df = table(spark, ["mice and geese", ""])
    lemmas = small_table(spark, {"form": ["mice", "geese"], "lemma": ["mouse", "goose"]})
    out = lemmatise(df, tx.word_tokens(tx.normalise_text(F.col("review_text"))), lemmas)
    assert {r[0]: r[1] for r in out.collect()} == {0: "mouse and goose", 1: ""}


def test_latin1(spark):
    assert table(spark, ["aé→ü😀z"]).select(tx.latin1_only(F.col("review_text"))).first()[0] == "aéüz"


def test_corpus_terms_equal_term_rows(spark, monkeypatch):
    """Counting by batch gives what term rows give, with few words at once, null, empty and repeated reviews; no rows of terms."""
    monkeypatch.setattr(tf, "SLICE_WORDS", 4)
    texts = ["a b a b a", "", None, "b", "c a b", "c a b", "d d d d d d d", "é ü é"]
    rows = small_table(spark, {"review_id": [0, 1, 2, 3, 4, 4, 5, 6], "t": texts}, "review_id int, t string")
    tokens = F.filter(F.split("t", " "), lambda w: w != "")
    for n in (1, 2, 3):
        wanted = tf.term_statistics(tf.posting_rows(rows, tokens, n)).collect()
        found = tf.corpus_terms(rows, tokens, n)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted))
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lemmatise_keeps_order_and_sends_words_without_structs(spark):
    """Words come back in order beyond nine places, and the collected words are strings."""
    rows = small_table(spark, {"review_id": [1, 2], "review_text": [" ".join(f"w{i}" for i in range(25)), ""]}, "review_id int, review_text string")
    pairs = small_table(spark, {"form": ["w3", "w12"], "lemma": ["x", ""]}, "form string, lemma string")
    found = lemmatise(rows, F.filter(F.split("review_text", " "), lambda w: w != ""), pairs)
    words = [f"w{i}" for i in range(25)]
    words[3], words[12] = "x", ""
    assert {r["review_id"]: r["cleaned_review"] for r in found.collect()} == {1: " ".join(words), 2: ""}
    assert "struct<pos" not in found._jdf.queryExecution().executedPlan().toString() and "struct(pos" not in found._jdf.queryExecution().executedPlan().toString()
