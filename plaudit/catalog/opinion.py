"""Sentiment, polarity, complaints and requests.

The tables hold invented prose, so English word lists would hardly match. The
queries use lists of its frequent words instead; the operators are the same.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from plaudit.catalog.common import Query, quoted, reviews, table
from plaudit.catalog.sqlsentiment import sentiment_sql, words_sql
from plaudit.functions.rounding import rounded_ratio_sql
from plaudit.functions.text import latin1_only, snippet
from plaudit.operators import insights as ins
from plaudit.operators.sentiment import score_polarity, score_sentiment, sentiment_columns
from plaudit.rules import PolarityRules, SentimentRules
from plaudit.sources.readers import small_table

LEXICON = {
    "tion": 1.5, "ing": -1.2, "rewh": 2.4, "orre": -2.6, "thatin": 3.1, "ment": -0.8, "eaux": 1.9, "ier": -1.7,
    "sch": 0.6, "heit": -2.2, "ou": 1.1, "er": -0.5, "re": 0.9, "ha": -1.9, "worthless": -1.9, "nd": 2.0,
    "es": -1.2, "and": 0.3, "os": 1.4, "den": -1.6, "ononst": -3.0, "le": 0.7, "un": -0.9,
}
POLARITY = {
    "tion": (0.35, 0.6), "ing": (-0.45, 0.2), "rewh": (0.9, 1.0), "orre": (-1.0, 0.85), "ment": (-0.15, 0.1),
    "eaux": (0.5, 0.5), "ier": (-0.65, 0.9), "heit": (0.25, 0.33), "ou": (-0.05, 0.0), "la": (0.4, 0.71),
}
POLARITY_RULES = PolarityRules(negations=("to", "pas", "zu", "que"), intensifiers=(("the", 1.3), ("de", 0.5), ("und", 1.5), ("la", 2.0)))
RULES = SentimentRules(
    boosters=("the", "de", "der", "ci", "la en"), dampers=("and", "et", "und", "of the"),
    negations=("to", "pas", "zu", "que"), negation_suffix="nth",
    idioms=(("in la", 2.5), ("that the", -1.5), ("de la ou", 1.25), ("er the", -2.0)),
    no_word="es", or_words=("or", "le"), never_word="on", so_words=("a", "it"), without_word="is",
    doubt_word="that", least_word="was", least_guards=("as", "be"), kind_word="re", of_word="the", but_word="with",
)
GROUPS = (
    ("battery life", ("thaner", "orantion", "hely")), ("shipping and delivery", ("ononst", "eauou")),
    ("product quality", ("rewh", "ungsch", "mentan")), ("user interface and UX", ("ui", "app")),
    ("pricing and value", ("ieraux", "tions.")), ("customer service", ("erst", "ción")),
    ("performance and speed", ("slow", "edes")),
)
DEFAULT = "build and design"
MARKERS = ("thingre", "euxel", "verheit", "enla c", "dark mode")


def lexicon(spark):
    return small_table(spark, {"token": list(LEXICON), "valence": list(LEXICON.values())}, "token string, valence double")


def polarity(spark):
    pol, sub = zip(*POLARITY.values())
    columns = {"token": list(POLARITY), "polarity": pol, "subjectivity": sub}
    return small_table(spark, columns, "token string, polarity double, subjectivity double")


def scored(spark, sf):
    return ins.scored_reviews(reviews(spark, sf), lexicon(spark), RULES, GROUPS, DEFAULT, MARKERS)


def kept(df):
    """Rows that a report reads more than once."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def q_sentiment_scores(spark, sf):
    return score_sentiment(reviews(spark, sf), lexicon(spark), RULES)


def q_sentiment_turns(spark, sf):
    """User turns with a text key: sentiment of short feedback, snippet carried along."""
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"),
        "text",
        latin1_only(snippet(F.col("text"), 120)).alias("snippet"),
    )
    return score_sentiment(turns, lexicon(spark), RULES, "turn_id", "text", keep=["snippet"])


def q_sentiment_columns(spark, sf):
    return sentiment_columns(reviews(spark, sf), lexicon(spark), polarity(spark), RULES, polarity_rules=POLARITY_RULES)


def q_polarity(spark, sf):
    return score_polarity(reviews(spark, sf), polarity(spark), rules=POLARITY_RULES)


def q_sentiment_distribution(spark, sf):
    return ins.sentiment_distribution(score_sentiment(reviews(spark, sf), lexicon(spark), RULES))


def q_sentiment_overview(spark, sf):
    return ins.sentiment_overview(score_sentiment(reviews(spark, sf), lexicon(spark), RULES))


def q_complaint_category(spark, sf):
    text = F.col("review_text")
    return reviews(spark, sf).select(
        "review_id",
        ins.complaint_category(text, GROUPS, DEFAULT).alias("category"),
        ins.category_rank(ins.complaint_category(text, GROUPS, DEFAULT)).cast("bigint").alias("category_rank"),
        snippet(text, 120).alias("snippet"),
    )


def q_default_keywords(spark, sf):
    """The built-in English groups and markers, counted over all reviews."""
    text = F.col("review_text")
    tagged = reviews(spark, sf).select(
        ins.complaint_category(text).alias("category"), ins.is_feature_request(text).alias("is_request")
    )
    return tagged.groupBy("category", "is_request").agg(F.count(F.lit(1)).alias("reviews"))


def _flat(breakdown):
    return breakdown.select(
        "category", "count", F.get("examples", F.lit(0)).alias("example_1"), F.get("examples", F.lit(1)).alias("example_2")
    )


def q_complaint_breakdown(spark, sf):
    return _flat(ins.complaint_breakdown(kept(scored(spark, sf))))


def q_top_complaints(spark, sf):
    """Rank of every category by count, ties by category list order."""
    from pyspark.sql import Window as W

    breakdown = ins.complaint_breakdown(kept(scored(spark, sf)))
    order = W.orderBy(F.desc("count"), ins.category_rank(F.col("category")))
    return breakdown.select(F.row_number().over(order).cast("bigint").alias("place"), "category", "count")


def q_feature_requests(spark, sf):
    return ins.feature_requests(scored(spark, sf))


def q_insight_summary(spark, sf):
    return ins.insight_summary(scored(spark, sf))


def q_insight_job(spark, sf):
    from plaudit.plans.insight import insight_report

    return insight_report(reviews(spark, sf), lexicon(spark), RULES, GROUPS, DEFAULT, MARKERS)


def queries() -> dict[str, Query]:
    return {
        "q_sentiment_scores": q_sentiment_scores,
        "q_sentiment_turns": q_sentiment_turns,
        "q_sentiment_columns": q_sentiment_columns,
        "q_polarity": q_polarity,
        "q_sentiment_distribution": q_sentiment_distribution,
        "q_sentiment_overview": q_sentiment_overview,
        "q_complaint_category": q_complaint_category,
        "q_default_keywords": q_default_keywords,
        "q_complaint_breakdown": q_complaint_breakdown,
        "q_top_complaints": q_top_complaints,
        "q_feature_requests": q_feature_requests,
        "q_insight_summary": q_insight_summary,
        "q_insight_job": q_insight_job,
    }


def sql_category(text: str, groups=GROUPS, default: str = DEFAULT) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), {quoted([w])})" for w in words) + f" THEN '{name}'"
        for name, words in groups
    )
    return f"CASE {whens} ELSE '{default}' END"


def sql_request(text: str, markers=MARKERS) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {quoted([m])})" for m in markers) + ")"


def sql_rank(category: str) -> str:
    from plaudit.rules import COMPLAINT_CATEGORIES

    return f"list_position([{quoted(COMPLAINT_CATEGORIES)}], {category})"


def sql_label(score: str) -> str:
    return f"CASE WHEN {score} >= 0.05 THEN 'Positive' WHEN {score} <= -0.05 THEN 'Negative' ELSE 'Neutral' END"


def sql_mean(total: str, n: str) -> str:
    return f"(CASE WHEN {total} < 0 THEN -1.0 ELSE 1.0 END * {rounded_ratio_sql(f'abs({total})', f'({n}) * 10000', 4)})"


DOCUMENTS = "SELECT doc_id AS id, text AS t FROM documents"


def scored_sql() -> str:
    return f"""
      SELECT s.*, left(d.text, 120) AS snippet, {sql_category('d.text')} AS category, {sql_request('d.text')} AS is_request
      FROM ({sentiment_sql(DOCUMENTS, LEXICON, RULES)}) s JOIN documents d ON d.doc_id = s.id"""


def oracle_sql() -> dict[str, str]:
    sent = sentiment_sql(DOCUMENTS, LEXICON, RULES)
    turns = "SELECT conv_id || '-' || turn AS id, text AS t FROM conversations"
    pol = ", ".join(f"('{k}', {p}::DOUBLE, {s}::DOUBLE)" for k, (p, s) in POLARITY.items())
    factor = " ".join(f"WHEN one = '{w}' THEN {by}::DOUBLE" for w, by in POLARITY_RULES.intensifiers)
    stressed, negations = quoted(w for w, _ in POLARITY_RULES.intensifiers), quoted(POLARITY_RULES.negations)
    negated = f"one IN ({negations}) OR (one IN ({stressed}) AND two IN ({negations}))"
    spoken = f"""
      SELECT *, CASE {factor} ELSE 1.0::DOUBLE END AS f, CASE WHEN {negated} THEN {POLARITY_RULES.negated_by}::DOUBLE ELSE 1.0::DOUBLE END AS turn
      FROM (SELECT id, lower(word) AS word, lag(lower(word)) OVER (PARTITION BY id ORDER BY pos) AS one,
                   lag(lower(word), 2) OVER (PARTITION BY id ORDER BY pos) AS two FROM ({words_sql(DOCUMENTS)}))"""

    def mean(total: str) -> str:
        top = f"(2 * {total} + n)"
        return f"CASE WHEN n = 0 THEN 0.0 ELSE (({top} - ((({top} % (2 * n)) + 2 * n) % (2 * n))) // (2 * n)) / 1e6 END"

    polarity_sql = f"""
      SELECT id, {mean('p')} AS polarity, {mean('s')} AS subjectivity FROM (
        SELECT d.doc_id AS id, coalesce(sum(x.p), 0)::BIGINT AS p, coalesce(sum(x.s), 0)::BIGINT AS s, count(x.p) AS n
        FROM documents d LEFT JOIN (
          SELECT w.id, round(greatest(-1.0, least(1.0, l.p * f)) * turn * 1e6)::BIGINT AS p, round(least(1.0, l.s * f) * 1e6)::BIGINT AS s
          FROM ({spoken}) w JOIN (VALUES {pol}) l(token, p, s) ON l.token = w.word) x ON x.id = d.doc_id GROUP BY d.doc_id)"""
    breakdown = f"""
      SELECT category, count(*) AS count,
             min(snippet) FILTER (r = 1) AS example_1, min(snippet) FILTER (r = 2) AS example_2
      FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS r FROM ({scored_sql()})
            WHERE compound <= -0.05) GROUP BY category"""
    requests = f"""
      SELECT row_number() OVER (ORDER BY id) AS ordinal, id AS review_id, snippet AS request
      FROM ({scored_sql()}) WHERE is_request ORDER BY id LIMIT 10"""
    summary = f"""
      SELECT n AS total_reviews, printf('%.1f%%', {rounded_ratio_sql('neg * 100', 'n', 1)}) AS negative_review_percentage,
             {sql_mean('total', 'n')} AS average_sentiment
      FROM (SELECT count(*) AS n, count(*) FILTER (compound <= -0.05) AS neg,
                   sum(round(compound * 10000)::BIGINT)::BIGINT AS total FROM ({sent}))"""
    columns = "id AS review_id, positive, neutral, negative, compound, label"
    return {
        "q_sentiment_scores": f"SELECT {columns} FROM ({sent})",
        "q_sentiment_turns": f"""
          SELECT s.id AS turn_id, regexp_replace(left(c.text, 120), '[^\\x{{00}}-\\x{{ff}}]', '', 'g') AS snippet,
                 positive, neutral, negative, compound, label
          FROM ({sentiment_sql(turns, LEXICON, RULES)}) s
          JOIN conversations c ON c.conv_id || '-' || c.turn = s.id""",
        "q_sentiment_columns": f"""
          SELECT s.id AS review_id, label AS sentiment_label, compound AS sentiment_score, polarity, subjectivity
          FROM ({sent}) s JOIN ({polarity_sql}) p ON p.id = s.id""",
        "q_polarity": f"SELECT id AS review_id, polarity, subjectivity FROM ({polarity_sql})",
        "q_sentiment_distribution": f"""
          SELECT l.label, count(s.id) AS reviews FROM (VALUES ('Positive'), ('Neutral'), ('Negative')) l(label)
          LEFT JOIN ({sent}) s ON s.label = l.label GROUP BY l.label""",
        "q_sentiment_overview": f"""
          SELECT n AS reviews, {sql_mean('total', 'n')} AS average_compound,
                 {sql_label('total / (n * 10000)')} AS overall_label
          FROM (SELECT count(*) AS n, sum(round(compound * 10000)::BIGINT)::BIGINT AS total FROM ({sent}))""",
        "q_complaint_category": f"""
          SELECT doc_id AS review_id, {sql_category('text')} AS category,
                 {sql_rank(sql_category('text'))}::BIGINT AS category_rank, left(text, 120) AS snippet FROM documents""",
        "q_default_keywords": f"""
          SELECT {_default_category_sql()} AS category, {_default_request_sql()} AS is_request, count(*) AS reviews
          FROM documents GROUP BY ALL""",
        "q_complaint_breakdown": breakdown,
        "q_top_complaints": f"""
          SELECT row_number() OVER (ORDER BY count DESC, {sql_rank('category')}) AS place, category, count
          FROM ({breakdown})""",
        "q_feature_requests": requests,
        "q_insight_summary": summary,
        "q_insight_job": f"""
          SELECT 'summary' AS section, 1::BIGINT AS place, NULL AS name, total_reviews AS n,
                 negative_review_percentage || ' ' || printf('%.4f', average_sentiment) AS detail FROM ({summary})
          UNION ALL SELECT 'complaint', row_number() OVER (ORDER BY count DESC, {sql_rank('category')}), category, count,
                 concat_ws(' | ', example_1, example_2) FROM ({breakdown})
          UNION ALL SELECT 'request', ordinal, NULL, review_id, request FROM ({requests})""",
    }


def _default_category_sql() -> str:
    from plaudit.rules import CATEGORY_KEYWORDS, DEFAULT_CATEGORY

    return sql_category("text", CATEGORY_KEYWORDS, DEFAULT_CATEGORY)


def _default_request_sql() -> str:
    from plaudit.rules import REQUEST_MARKERS

    return sql_request("text", REQUEST_MARKERS)
