"""Lexicon sentiment as a join job.

Every review is exploded into one row per word, holding the word with its
neighbours, and one header row with the counts of the whole text. The lexicon
join drops all words but the hits, the modifier rules run on the hits, and one
aggregate per review collects them. The header row keeps reviews without any
hit, so no second join is needed, and the partial aggregate leaves one row per
review before the shuffle. Word scores are summed as integers of 1e-6, which
makes the result independent of row order.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions.rounding import rounded_ratio
from plaudit.functions.text import is_blank, split_words
from plaudit.operators.lookup import Lookup
from plaudit.rules import (
    DEFAULT_POLARITY,
    DEFAULT_SENTIMENT,
    SEED_LEXICON,
    SEED_POLARITY,
    SENTIMENT_THRESHOLD,
    PolarityRules,
    SentimentRules,
)
from plaudit.sources.readers import small_table

MICRO = 1_000_000


def seed_lexicon(spark) -> DataFrame:
    tokens, valences = zip(*SEED_LEXICON)
    return small_table(spark, {"token": tokens, "valence": valences}, "token string, valence double")


def seed_polarity(spark) -> DataFrame:
    tokens, polarity, subjectivity = zip(*SEED_POLARITY)
    return small_table(
        spark,
        {"token": tokens, "polarity": polarity, "subjectivity": subjectivity},
        "token string, polarity double, subjectivity double",
    )


def sentiment_label(score: Column) -> Column:
    """Positive, Negative or Neutral; one rule for rows and for averages."""
    return (
        F.when(score >= SENTIMENT_THRESHOLD, "Positive")
        .when(score <= -SENTIMENT_THRESHOLD, "Negative")
        .otherwise("Neutral")
    )


def is_negative(compound: Column) -> Column:
    return compound <= -SENTIMENT_THRESHOLD


def spoken_words(text: Column) -> Column:
    """Words split at white space; outer punctuation goes if over two characters stay."""

    def strip(word: Column) -> Column:
        bare = F.btrim(word, F.lit(string.punctuation))
        return F.when(F.length(bare) > 2, bare).otherwise(word)

    return F.transform(split_words(text), strip)


def _flagged(
    reviews: DataFrame, keep: Sequence[str], text_column: str, rules: SentimentRules, lookup: Lookup
) -> DataFrame:
    """*keep, the words in lower case, the places that may be hits, and counts of the whole text.

    Words outside a listed lexicon are left out before rows are made of them.
    """
    text = F.when(is_blank(F.col(text_column)), "").otherwise(F.col(text_column))
    words = reviews.select(*keep, text.alias("_t"), spoken_words(text).alias("_w"))
    lower = words.select(*keep, "_t", "_w", F.transform("_w", lambda w: F.lower(w)).alias("_l")).select(
        *keep, "_t", "_w", "_l",
        F.zip_with("_w", "_l", lambda w, low: (w != low) & (w == F.upper(w))).alias("_u"),
    )
    places = F.sequence(F.lit(0), F.size("_l") - 1)
    if lookup.listed is not None:
        places = F.expr(f"filter(transform(_l, (w, i) -> IF({lookup.holds('w')}, i, NULL)), i -> i IS NOT NULL)")
    places = F.when(F.size("_l") > 0, places).otherwise(F.array().cast("array<int>"))
    n_upper = F.size(F.filter("_u", lambda u: u))
    bangs = F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("!"), F.lit("")))
    asks = F.length("_t") - F.length(F.replace(F.col("_t"), F.lit("?"), F.lit("")))
    emphasis = F.least(bangs, F.lit(rules.exclamation_max)) * rules.exclamation_micro + F.when(
        asks > 3, rules.question_many_micro
    ).when(asks > 1, asks * rules.question_micro).otherwise(0)
    return lower.select(
        *keep, "_l", "_u", places.alias("_at"),
        F.size("_w").cast("bigint").alias("_n"),
        ((n_upper > 0) & (n_upper < F.size("_w"))).alias("_mixed"),
        (F.array_position("_l", F.lit(rules.but_word)) - 1).alias("_but"),
        emphasis.cast("bigint").alias("_emph"),
    )


def _word_row(i: Column) -> Column:
    """The word at place ``i`` of ``_l`` with its neighbours."""
    before = [F.get("_l", i - d).alias(f"p{d}") for d in (1, 2, 3)]
    shout = [(F.coalesce(F.get("_u", i - d), F.lit(False)) & F.col("_mixed")).alias(f"u{d}") for d in (0, 1, 2, 3)]
    after = [F.get("_l", i + d).alias(f"n{d}") for d in (1, 2)]
    return F.struct(
        i.cast("bigint").alias("pos"), F.get("_l", i).alias("tok"), *before, *shout, *after,
        F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("emph"),
    )


def _token_rows(
    reviews: DataFrame, id_column: str, text_column: str, keep: Sequence[str], rules: SentimentRules, lookup: Lookup
) -> DataFrame:
    """One row per word (``pos`` >= 0) and one header row (``pos`` = -1) per review."""
    flagged = _flagged(reviews, [id_column, *keep], text_column, rules, lookup)
    text_null, no = F.lit(None).cast("string"), F.lit(False)
    header = F.struct(
        F.lit(-1).cast("bigint").alias("pos"), text_null.alias("tok"),
        *[text_null.alias(f"p{d}") for d in (1, 2, 3)], *[no.alias(f"u{d}") for d in (0, 1, 2, 3)],
        *[text_null.alias(f"n{d}") for d in (1, 2)], F.col("_n").alias("words"), F.col("_emph").alias("emph"),
    )
    rows = F.concat(F.array(header), F.transform("_at", _word_row))
    return flagged.select(id_column, *keep, "_but", F.explode_outer(rows).alias("r")).select(id_column, *keep, "_but", "r.*")


def sql_words(words: Sequence[str]) -> str:
    """A comma list of SQL string literals."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def _any_of(name: str, words: Sequence[str]) -> str:
    return f"coalesce({name} IN ({sql_words(words)}), false)" if words else "false"


def _modifier(rules: SentimentRules, name: str) -> str:
    """What a booster or damper adds, as SQL text; null for other words."""
    signed = f"IF({_any_of(name, rules.boosters)}, {rules.raise_by}D, -{rules.raise_by}D)"
    return f"IF({_any_of(name, [*rules.boosters, *rules.dampers])}, {signed}, CAST(NULL AS DOUBLE))"


def _steps(rules: SentimentRules) -> list[str]:
    """The modifier rules in order, each giving the next ``v`` from the names of a hit row.

    The rules are SQL text: each is parsed in one call, where a Column would
    take one call per word of the lists.
    """
    r = rules

    def emphasis(amount: str, upper: str) -> str:
        """``amount`` moved away from zero by the capitals bonus if ``upper``."""
        return f"({amount} + IF({upper}, IF(v > 0, {r.caps_by}D, -{r.caps_by}D), 0D))"

    def negated(name: str) -> str:
        return f"({_any_of(name, r.negations)} OR coalesce(contains({name}, '{sql_words([r.negation_suffix])[1:-1]}'), false))"

    no, never, without, doubt = [r.no_word], [r.never_word], [r.without_word], [r.doubt_word]
    steps = [
        f"CASE WHEN {_any_of('p1', no)} OR {_any_of('p2', no)} OR ({_any_of('p3', no)} AND {_any_of('p1', r.or_words)}) "
        f"THEN valence * {r.negate_by}D WHEN {_any_of('tok', no)} AND k_n1 THEN 0D ELSE valence END",
        f"IF(u0, {emphasis('v', 'true')}, v)",
    ]
    # "so" right before the hit counts at distance 3 even without "never".
    stronger = {
        1: "false",
        2: f"({_any_of('p2', never)} AND {_any_of('p1', r.so_words)})",
        3: f"(({_any_of('p3', never)} AND {_any_of('p2', r.so_words)}) OR {_any_of('p1', r.so_words)})",
    }
    kept = {
        1: "false",
        2: f"({_any_of('p2', without)} AND {_any_of('p1', doubt)})",
        3: f"({_any_of('p3', without)} AND ({_any_of('p2', doubt)} OR {_any_of('p1', doubt)}))",
    }
    for d, damp in zip((1, 2, 3), r.distance_damp):
        name, active = f"p{d}", f"(p{d} IS NOT NULL AND NOT k_p{d})"
        toward = f"IF(v < 0, -m{d}, m{d})"
        steps.append(f"IF({active} AND m{d} IS NOT NULL, v + {emphasis(toward, f'u{d}')} * {damp}D, v)")
        steps.append(
            f"CASE WHEN NOT {active} THEN v WHEN {stronger[d]} THEN v * {r.never_so_by}D WHEN {kept[d]} THEN v "
            f"WHEN {negated(name)} THEN v * {r.negate_by}D ELSE v END"
        )
    steps += _idioms(rules)
    steps.append(
        f"IF({_any_of('p1', [r.least_word])} AND NOT k_p1 AND NOT {_any_of('p2', r.least_guards)}, v * {r.negate_by}D, v)"
    )
    steps.append(
        f"CASE WHEN _but >= 0 AND pos < _but THEN v * {r.before_but}D WHEN _but >= 0 AND pos > _but THEN v * {r.after_but}D ELSE v END"
    )
    return steps


_MICRO_SQL = f"cast(round(v * {float(MICRO)}D) AS BIGINT)"


def _word_scores(hits: DataFrame, rules: SentimentRules) -> DataFrame:
    """Apply the modifier rules to hit rows one after the other; adds ``micro``."""
    df = hits.withColumns({f"m{d}": F.expr(_modifier(rules, f"p{d}")) for d in (1, 2, 3)})
    for step in _steps(rules):
        df = df.withColumn("v", F.expr(step))
    return df.withColumn("micro", F.expr(_MICRO_SQL))


def _idioms(rules: SentimentRules) -> list[str]:
    """Fixed phrases around the word replace its score; two-word modifiers add to it."""
    active, steps = "(p3 IS NOT NULL AND NOT k_p3)", []
    if rules.idioms:
        whens = " ".join(f"WHEN {sql_words([text])} THEN {value}D" for text, value in rules.idioms)
        phrases = ("tok n1 n2", "tok n1", "p1 tok", "p2 p1 tok", "p2 p1", "p3 p2 p1", "p3 p2")
        # concat, unlike concat_ws, is null when a neighbour is missing.
        texts = ["concat(" + ", ' ', ".join(names.split()) + ")" for names in phrases]
        known = sql_words([text for text, _ in rules.idioms])
        found = ", ".join(f"IF({text} IN ({known}), CASE {text} {whens} END, CAST(NULL AS DOUBLE))" for text in texts)
        steps.append(f"IF({active}, coalesce({found}, v), v)")
    for names in ("p3, ' ', p2, ' ', p1", "p3, ' ', p2", "p2, ' ', p1"):
        steps.append(f"IF({active}, v + coalesce({_modifier(rules, f'concat({names})')}, 0D), v)")
    return steps


def _counts(rules: SentimentRules) -> str:
    """SQL test that a word of the lexicon is no modifier itself."""
    modifier = _any_of("tok", [*rules.boosters, *rules.dampers])
    return f"NOT {modifier} AND NOT ({_any_of('tok', [rules.kind_word])} AND {_any_of('n1', [rules.of_word])})"


# Names of a hit in the rules' SQL text; quoted words are passed over.
_NAMES = re.compile(r"'(?:[^'\\]|\\.)*'|\b(p[123]|u[0-3]|n[12]|m[123]|k_[pn][123]|tok|valence|pos)\b")
MAX_VALENCES = 400


def _of_hit(sql: str) -> str:
    return _NAMES.sub(lambda m: f"h.{m[1]}" if m[1] else m[0], sql)


def _valence_sql(lookup: Lookup) -> str | None:
    """``tok`` to its valence as one hash-set test for each distinct valence; null for a lexicon it cannot hold."""
    if lookup.listed is None:
        return None
    groups: dict[float, list[str]] = {}
    for row in lookup.df.collect():  # a listed lookup has at most MAX_LISTED rows
        if row["valence"] is not None:
            groups.setdefault(row["valence"], []).append(row["token"])
    if len(groups) > MAX_VALENCES or not groups:
        return None
    whens = " ".join(f"WHEN {_any_of('tok', sorted(words))} THEN {value!r}D" for value, words in sorted(groups.items()))
    return f"CASE {whens} END"


def sentiment_in_row(
    reviews: DataFrame,
    lexicon: DataFrame | None = None,
    rules: SentimentRules = DEFAULT_SENTIMENT,
    text_column: str = "review_text",
) -> DataFrame | None:
    """``reviews`` with positive, neutral, negative, compound and label added; map-only.

    The hits of a text are an array in its row, the rules pass over it, and its sums give the
    same numbers as ``score_sentiment``. Needs a lexicon that is listed and has at most
    ``MAX_VALENCES`` different valences; for any other the answer is None and the join is to be taken.
    """
    lookup = Lookup(lexicon if lexicon is not None else seed_lexicon(reviews.sparkSession), "token")
    valence = _valence_sql(lookup)
    if valence is None:
        return None
    names = reviews.columns
    flagged = _flagged(reviews, names, text_column, rules, lookup).withColumn("_hits", F.transform("_at", _word_row))
    words = [*[f"p{d}" for d in (1, 2, 3)], *[f"u{d}" for d in (0, 1, 2, 3)], *[f"n{d}" for d in (1, 2)], "pos", "tok"]

    def again(df: DataFrame, **fields: str) -> DataFrame:
        """Every hit with fields added or replaced; each step reads the array of the one before once."""
        parts = ", ".join(f"'{n}', h.{n}" for n in again.names if n not in fields)
        added = ", ".join(f"'{n}', {_of_hit(sql)}" for n, sql in fields.items())
        again.names = [*[n for n in again.names if n not in fields], *fields]
        return df.withColumn("_hits", F.expr(f"transform(_hits, h -> named_struct({', '.join(x for x in (parts, added) if x)}))"))

    again.names = words
    marks = {f"k_{n}": lookup.holds(n) for n in ("p1", "p2", "p3", "n1")}
    df = again(flagged, valence=valence, **marks, **{f"m{d}": _modifier(rules, f"p{d}") for d in (1, 2, 3)})
    df = df.withColumn("_hits", F.expr(f"filter(_hits, h -> {_of_hit('valence IS NOT NULL AND ' + _counts(rules))})"))
    # The score runs beside the hits: a step makes numbers, not structs of all fields.
    df = df.withColumn("_v", F.expr("transform(_hits, h -> h.valence)"))
    for step in _steps(rules):
        df = df.withColumn("_v", F.expr(f"zip_with(_hits, _v, (h, v) -> {_of_hit(step)})"))
    zero = "named_struct('s', 0L, 'p', 0L, 'm', 0L, 'h', 0L)"
    micros = f"transform(_v, v -> {_MICRO_SQL})"
    add = (
        f"named_struct('s', a.s + x, 'p', a.p + IF(x > 0, x + {MICRO}, 0L), 'm', a.m + IF(x < 0, {MICRO} - x, 0L), "
        "'h', a.h + IF(x <> 0, 1L, 0L))"
    )
    summed = df.withColumn("_sums", F.expr(f"aggregate({micros}, {zero}, (a, x) -> {add})"))
    sums = summed.select(*names, "_n", F.col("_emph").alias("_e"), *[F.col(f"_sums.{n}").alias(f"_{n}") for n in "spmh"])
    return _totals(sums, names, rules)


def score_sentiment(
    reviews: DataFrame,
    lexicon: DataFrame | None = None,
    rules: SentimentRules = DEFAULT_SENTIMENT,
    id_column: str = "review_id",
    text_column: str = "review_text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, positive, neutral, negative, compound, label), one row per review.

    ``id_column`` must be unique. ``keep`` names short columns to carry along;
    they become grouping keys, so long texts are better joined back by id.
    """
    lookup = Lookup(lexicon if lexicon is not None else seed_lexicon(reviews.sparkSession), "token")
    tokens = _token_rows(reviews, id_column, text_column, keep, rules, lookup)
    salt = F.struct(F.col(id_column), F.col("pos"))
    found = lookup.join(tokens, F.col("tok"), {"valence": "valence"}, salt)
    hits = found.filter(f"pos < 0 OR (valence IS NOT NULL AND {_counts(rules)})")
    around = ("p1", "p2", "p3", "n1")
    if lookup.listed is not None:
        hits = hits.withColumns({f"k_{name}": F.expr(lookup.holds(name)) for name in around})
    else:
        for name in around:
            hits = lookup.join(hits, F.col(name), {"token": f"_f_{name}"}, salt)
        hits = hits.withColumns({f"k_{name}": F.col(f"_f_{name}").isNotNull() for name in around})
    micro = F.col("micro")
    sums = (
        _word_scores(hits, rules)
        .groupBy(id_column, *keep)
        .agg(
            F.sum("words").alias("_n"),
            F.sum("emph").alias("_e"),
            F.coalesce(F.sum(micro), F.lit(0)).alias("_s"),
            F.coalesce(F.sum(F.when(micro > 0, micro + MICRO)), F.lit(0)).alias("_p"),
            F.coalesce(F.sum(F.when(micro < 0, MICRO - micro)), F.lit(0)).alias("_m"),
            F.count(F.when(micro != 0, 1)).alias("_h"),
        )
    )
    return _totals(sums, [id_column, *keep], rules)


def _totals(sums: DataFrame, keys: Sequence[str], rules: SentimentRules) -> DataFrame:
    c = F.col
    total = F.when(c("_s") > 0, c("_s") + c("_e")).when(c("_s") < 0, c("_s") - c("_e")).otherwise(c("_s"))
    parts = sums.select(
        *keys, "_n",
        (total / float(MICRO)).alias("_x"),
        F.when(c("_p") > c("_m"), c("_p") + c("_e")).otherwise(c("_p")).alias("_pos"),
        F.when(c("_p") < c("_m"), c("_m") + c("_e")).otherwise(c("_m")).alias("_neg"),
        ((c("_n") - c("_h")) * MICRO).alias("_neu"),
    )
    empty = c("_n") == 0
    share = lambda name: rounded_ratio(name, "_pos + _neg + _neu", 3)
    raw = c("_x") / F.sqrt(c("_x") * c("_x") + rules.normaliser)
    scored = parts.select(
        *keys,
        F.when(empty, 0.0).otherwise(share("_pos")).alias("positive"),
        F.when(empty, 1.0).otherwise(share("_neu")).alias("neutral"),
        F.when(empty, 0.0).otherwise(share("_neg")).alias("negative"),
        F.when(empty, 0.0).otherwise(F.round(raw, 4)).alias("compound"),
    )
    return scored.withColumn("label", sentiment_label(c("compound")))


def score_polarity(
    reviews: DataFrame,
    table: DataFrame | None = None,
    id_column: str = "review_id",
    text_column: str = "review_text",
    rules: PolarityRules = DEFAULT_POLARITY,
) -> DataFrame:
    """(id, polarity, subjectivity): the mean over matched words after the rules, 0.0 without any."""
    lookup = Lookup(table if table is not None else seed_polarity(reviews.sparkSession), "token")
    words = F.transform(spoken_words(F.coalesce(F.col(text_column), F.lit(""))), lambda w: F.lower(w))
    # A word gets its two predecessors only if it may be a hit.
    placed = "struct(w AS tok, get(_l, i - 1) AS one, get(_l, i - 2) AS two)"
    if lookup.listed is not None:
        placed = f"IF({lookup.holds('w')}, {placed}, NULL)"
    listed = reviews.select(id_column, words.alias("_l")).select(id_column, F.expr(f"transform(_l, (w, i) -> {placed})").alias("_l"))
    if lookup.listed is not None:
        listed = listed.withColumn("_l", F.filter("_l", lambda w: w.isNotNull()))
    # The leading null is the header row that keeps reviews without a match.
    nothing = F.array(F.lit(None).cast("struct<tok:string,one:string,two:string>"))
    rows = listed.select(id_column, F.posexplode_outer(F.concat(nothing, F.col("_l"))).alias("pos", "w")).select(id_column, "pos", "w.*")
    names = {"polarity": "pol", "subjectivity": "sub"}
    found = lookup.join(rows, F.col("tok"), names, F.struct(F.col(id_column), F.col("pos")))
    factor = F.lit(1.0)
    for word, by in rules.intensifiers:
        factor = F.when(F.col("one") == word, by).otherwise(factor)
    stressed = F.col("one").isin([word for word, _ in rules.intensifiers])
    negated = F.col("one").isin(list(rules.negations)) | (stressed & F.col("two").isin(list(rules.negations)))
    turn = F.when(negated, rules.negated_by).otherwise(1.0)
    hit = F.col("pol").isNotNull()
    polarity = F.when(hit, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("pol") * factor)) * turn)
    subjectivity = F.when(hit, F.least(F.lit(1.0), F.col("sub") * factor))
    micro = lambda value: F.sum(F.round(value * float(MICRO)).cast("bigint"))
    sums = (
        found.filter((F.col("pos") == 0) | F.col("pol").isNotNull())
        .groupBy(id_column)
        .agg(micro(polarity).alias("_p"), micro(subjectivity).alias("_s"), F.count("pol").alias("_n"))
    )

    def mean(name: str) -> Column:
        """Sum / count in whole 1e-6 units, halves up, by exact integer division."""
        doubled, by = F.col(name) * 2 + F.col("_n"), F.col("_n") * 2
        units = F.call_function("div", doubled - F.pmod(doubled, by), by)
        return F.when(F.col("_n") == 0, 0.0).otherwise(units / float(MICRO))

    return sums.select(id_column, mean("_p").alias("polarity"), mean("_s").alias("subjectivity"))


def sentiment_columns(
    reviews: DataFrame,
    lexicon: DataFrame | None = None,
    polarity: DataFrame | None = None,
    rules: SentimentRules = DEFAULT_SENTIMENT,
    id_column: str = "review_id",
    text_column: str = "review_text",
    polarity_rules: PolarityRules = DEFAULT_POLARITY,
) -> DataFrame:
    """Column form: sentiment_label, sentiment_score, polarity, subjectivity per id."""
    scored = score_sentiment(reviews, lexicon, rules, id_column, text_column).select(
        id_column, F.col("label").alias("sentiment_label"), F.col("compound").alias("sentiment_score")
    )
    return scored.join(score_polarity(reviews, polarity, id_column, text_column, polarity_rules), id_column)
