"""The sentiment rules once more, as DuckDB SQL with lag and lead windows."""

from __future__ import annotations

from plaudit.catalog.common import quoted, sql_is_blank
from plaudit.functions.rounding import rounded_ratio_sql
from plaudit.functions.text import SPACE_CLASS
from plaudit.rules import SentimentRules


def words_sql(source: str) -> str:
    """(id, pos, word) rows of a source with columns id and t."""
    bare = "regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')"
    return f"""
      SELECT id, pos, CASE WHEN length({bare}) > 2 THEN {bare} ELSE w END AS word
      FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
            FROM (SELECT id, list_filter(regexp_split_to_array(t, '[{SPACE_CLASS}]+'), lambda x: x <> '') AS ws
                  FROM ({source}) WHERE NOT {sql_is_blank('t')}))"""


def _in(word: str, words) -> str:
    return f"coalesce({word} IN ({quoted(words)}), false)" if words else "false"


def sentiment_sql(source: str, lexicon: dict[str, float], r: SentimentRules) -> str:
    """id, positive, neutral, negative, compound, label for every row of ``source``."""
    values = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in lexicon.items())
    known = quoted(lexicon)

    def booster(word: str) -> str:
        return (
            f"CASE WHEN {_in(word, r.boosters)} THEN {r.raise_by}::DOUBLE "
            f"WHEN {_in(word, r.dampers)} THEN -{r.raise_by}::DOUBLE END"
        )

    def negated(word: str) -> str:
        return f"({_in(word, r.negations)} OR coalesce(contains({word}, '{r.negation_suffix}'), false))"

    steps = [
        f"CASE WHEN u0 AND mixed THEN v + CASE WHEN v > 0 THEN {r.caps_by}::DOUBLE ELSE -{r.caps_by}::DOUBLE END ELSE v END"
    ]
    never, so = _in, r.so_words
    for d, damp in zip((1, 2, 3), r.distance_damp):
        p, active = f"p{d}", f"(p{d} IS NOT NULL AND p{d} NOT IN ({known}))"
        by = booster(p)
        toward = f"(CASE WHEN v < 0 THEN -({by}) ELSE {by} END)"
        shout = (
            f"(CASE WHEN u{d} AND mixed THEN {toward} + CASE WHEN v > 0 THEN {r.caps_by}::DOUBLE "
            f"ELSE -{r.caps_by}::DOUBLE END ELSE {toward} END)"
        )
        steps.append(f"CASE WHEN {active} AND ({by}) IS NOT NULL THEN v + {shout} * {damp}::DOUBLE ELSE v END")
        first, second = {
            1: ("false", "false"),
            2: (
                f"{never('p2', [r.never_word])} AND {_in('p1', so)}",
                f"{_in('p2', [r.without_word])} AND {_in('p1', [r.doubt_word])}",
            ),
            3: (
                f"({never('p3', [r.never_word])} AND {_in('p2', so)}) OR {_in('p1', so)}",
                f"{_in('p3', [r.without_word])} AND ({_in('p2', [r.doubt_word])} OR {_in('p1', [r.doubt_word])})",
            ),
        }[d]
        steps.append(
            f"CASE WHEN NOT {active} THEN v WHEN {first} THEN v * {r.never_so_by}::DOUBLE WHEN {second} THEN v "
            f"WHEN {negated(p)} THEN v * {r.negate_by}::DOUBLE ELSE v END"
        )
    active3 = f"(p3 IS NOT NULL AND p3 NOT IN ({known}))"
    texts = ["tok||' '||n1||' '||n2", "tok||' '||n1", "p1||' '||tok", "p2||' '||p1||' '||tok", "p2||' '||p1",
             "p3||' '||p2||' '||p1", "p3||' '||p2"]
    phrase = lambda t: "CASE " + t + " " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in r.idioms) + " END"
    if r.idioms:
        steps.append(f"CASE WHEN {active3} THEN coalesce({', '.join(phrase(t) for t in texts)}, v) ELSE v END")
    for t in ("p3||' '||p2||' '||p1", "p3||' '||p2", "p2||' '||p1"):
        steps.append(f"CASE WHEN {active3} THEN v + coalesce({booster(t)}, 0.0) ELSE v END")
    steps.append(
        f"CASE WHEN {_in('p1', [r.least_word])} AND p1 NOT IN ({known}) AND NOT {_in('p2', r.least_guards)} "
        f"THEN v * {r.negate_by}::DOUBLE ELSE v END"
    )
    steps.append(
        f"CASE WHEN pos < but THEN v * {r.before_but}::DOUBLE WHEN pos > but THEN v * {r.after_but}::DOUBLE ELSE v END"
    )
    start = (
        f"CASE WHEN {_in('p1', [r.no_word])} OR {_in('p2', [r.no_word])} OR ({_in('p3', [r.no_word])} AND {_in('p1', r.or_words)}) "
        f"THEN valence * {r.negate_by}::DOUBLE WHEN tok = '{r.no_word}' AND coalesce(n1 IN ({known}), false) THEN 0.0 "
        "ELSE valence END"
    )
    over = "OVER (PARTITION BY id ORDER BY pos)"
    upper = "(word = upper(word) AND word <> lower(word))"
    chain = f"SELECT *, {start} AS v FROM hits"
    for step in steps:
        chain = f"SELECT * REPLACE ({step} AS v) FROM ({chain})"
    pos, neg = "(p + CASE WHEN p > m THEN e ELSE 0 END)", "(m + CASE WHEN p < m THEN e ELSE 0 END)"
    size = f"({pos} + {neg} + (n - h) * 1000000)"
    x = "((s + CASE WHEN s > 0 THEN e WHEN s < 0 THEN -e ELSE 0 END) / 1e6)"
    return f"""
      WITH src AS ({source}), words AS ({words_sql(source)}),
      tok AS (
        SELECT id, pos, lower(word) AS tok, {upper} AS u0,
               lag(lower(word), 1) {over} AS p1, lag(lower(word), 2) {over} AS p2, lag(lower(word), 3) {over} AS p3,
               coalesce(lag({upper}, 1) {over}, false) AS u1, coalesce(lag({upper}, 2) {over}, false) AS u2,
               coalesce(lag({upper}, 3) {over}, false) AS u3,
               lead(lower(word), 1) {over} AS n1, lead(lower(word), 2) {over} AS n2 FROM words),
      per AS (
        SELECT id, count(*) AS n, count(*) FILTER (u0) BETWEEN 1 AND count(*) - 1 AS mixed,
               min(pos) FILTER (tok = '{r.but_word}') AS but FROM tok GROUP BY id),
      hits AS (
        SELECT tok.*, l.valence, per.mixed, per.but FROM tok JOIN (VALUES {values}) l(token, valence) ON l.token = tok.tok
        JOIN per ON per.id = tok.id
        WHERE NOT {_in('tok.tok', r.boosters)} AND NOT {_in('tok.tok', r.dampers)}
          AND NOT (tok.tok = '{r.kind_word}' AND coalesce(n1 = '{r.of_word}', false))),
      micro AS (SELECT id, round(v * 1e6)::BIGINT AS k FROM ({chain})),
      sums AS (
        SELECT id, sum(k)::BIGINT AS s, coalesce(sum(k + 1000000) FILTER (k > 0), 0)::BIGINT AS p,
               coalesce(sum(1000000 - k) FILTER (k < 0), 0)::BIGINT AS m, count(*) FILTER (k <> 0) AS h
        FROM micro GROUP BY id),
      marks AS (
        SELECT id, length(t) - length(replace(t, '!', '')) AS bangs, length(t) - length(replace(t, '?', '')) AS asks
        FROM src WHERE NOT {sql_is_blank('t')}),
      al AS (
        SELECT src.id, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(m, 0) AS m,
               coalesce(h, 0) AS h, (least(coalesce(bangs, 0), {r.exclamation_max}) * {r.exclamation_micro}
               + CASE WHEN asks > 3 THEN {r.question_many_micro} WHEN asks > 1 THEN asks * {r.question_micro} ELSE 0 END)::BIGINT AS e
        FROM src LEFT JOIN per ON per.id = src.id LEFT JOIN sums ON sums.id = src.id LEFT JOIN marks ON marks.id = src.id),
      final AS (
        SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE {rounded_ratio_sql(pos, size, 3)} END AS positive,
               CASE WHEN n = 0 THEN 1.0 ELSE {rounded_ratio_sql('(n - h) * 1000000', size, 3)} END AS neutral,
               CASE WHEN n = 0 THEN 0.0 ELSE {rounded_ratio_sql(neg, size, 3)} END AS negative,
               CASE WHEN n = 0 THEN 0.0 ELSE round({x} / sqrt({x} * {x} + {r.normaliser}::DOUBLE), 4) END AS compound FROM al)
      SELECT *, CASE WHEN compound >= 0.05 THEN 'Positive' WHEN compound <= -0.05 THEN 'Negative' ELSE 'Neutral' END AS label
      FROM final"""
