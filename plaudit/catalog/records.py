"""Labels, audits, splits, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaudit.catalog.common import Query, labelled, reviews, sql_is_blank, sql_strip, table
from plaudit.catalog.opinion import sql_label, sql_mean
from plaudit.functions.rounding import rounded_ratio_sql
from plaudit.operators import labels as lab
from plaudit.operators import metrics as met
from plaudit.operators import report as rep
from plaudit.operators import splits as spl

SPELLINGS = ("genuine", "FAKE ", "1", " Real", "spam", "maybe", "True", "0", "1.0", "false")


def raw_labels(spark, sf):
    """Every document with a label spelled in ten ways, or none."""
    spelled = F.get(F.array(*[F.lit(s) for s in SPELLINGS]), F.pmod("review_id", F.lit(len(SPELLINGS))).cast("int"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), "toxic")
    joined = reviews(spark, sf).join(labels, "review_id", "left")
    text = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("review_text"))
    label = F.when(F.pmod("review_id", F.lit(11)) == 0, F.lit(None)).otherwise(spelled)
    return joined.select("review_id", text.alias("review_text"), label.alias("label"))


RAW_LABELS = f"""
  SELECT d.doc_id AS review_id, CASE WHEN l.toxic = 1 THEN NULL ELSE d.text END AS review_text,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL
              ELSE [{', '.join("'" + s + "'" for s in SPELLINGS)}][d.doc_id % {len(SPELLINGS)} + 1] END AS label
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _sql_value(label: str) -> str:
    text = f"lower(trim({label}))"
    return f"CASE WHEN {text} IN ('genuine','real','1','true') THEN 1 WHEN {text} IN ('fake','false','0','spam') THEN 0 END"


def _predictions(spark, sf):
    """Line items as judged reviews: a repeatable score beside a true class."""
    price, part = F.col("l_extendedprice"), F.col("l_partkey")
    score = F.pmod((part * 37 + F.col("l_orderkey") * 11).cast("bigint"), F.lit(10_001)) / 10_000.0
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"),
        F.concat_ws(" ", "l_returnflag", "l_shipdate", F.lit("ü→é")).alias("review_text"),
        (F.pmod(part, F.lit(3)) > 0).cast("int").alias("label"),
        (score >= 0.4).cast("int").alias("predicted"),
        score.alias("genuine_probability"),
        F.round(1 - score, 4).alias("fake_probability"),
        (F.pmod(F.floor(price), F.lit(2001)) / 1000.0 - 1).alias("compound"),
    )


PREDICTIONS = """
  SELECT l_orderkey || '-' || l_linenumber AS review_id, l_returnflag AS flag,
         (l_partkey % 3 > 0)::INT AS label, (score >= 0.4)::INT AS predicted, score AS genuine_probability,
         round(1 - score, 4) AS fake_probability, (floor(l_extendedprice)::BIGINT % 2001) / 1000.0::DOUBLE - 1 AS compound,
         CASE WHEN score >= 0.4 THEN 'Genuine' ELSE 'Fake' END AS prediction,
         CASE WHEN score >= 0.4 THEN score ELSE round(1 - score, 4) END AS confidence
  FROM (SELECT *, ((l_partkey * 37 + l_orderkey * 11) % 10001) / 10000.0::DOUBLE AS score FROM lineitem)"""


def _scored(spark, sf):
    from plaudit.operators.scoring import prediction_columns

    return prediction_columns(_predictions(spark, sf), F.col("predicted"), F.col("genuine_probability")).withColumn(
        "sentiment_compound", F.round("compound", 4)
    )


def q_drop_missing(spark, sf):
    return raw_labels(spark, sf).na.drop(subset=["review_text", "label"]).select(
        "review_id", F.length("review_text").cast("bigint").alias("chars"), "label"
    )


def q_label_normalise(spark, sf):
    return lab.normalise_labels(raw_labels(spark, sf)).select("review_id", "label")


def q_label_inverted(spark, sf):
    """Flags of a column that marks fakes, read with their own meaning."""
    return lab.normalise_labels(raw_labels(spark, sf), means="fake").groupBy("label").agg(F.count(F.lit(1)).alias("reviews"))


def q_load_audit(spark, sf):
    return lab.load_audit(raw_labels(spark, sf))


def q_class_balance(spark, sf):
    return spl.class_balance(labelled(spark, sf))


def q_valid_reject(spark, sf):
    """Length bounds and blank texts; every third document is padded."""
    padded = F.when(F.pmod("review_id", F.lit(3)) == 0, F.concat(F.lit(" \n "), "review_text", F.lit("\t"))).when(
        F.pmod("review_id", F.lit(7)) == 0, F.lit("      ")
    ).otherwise(F.col("review_text"))
    checked = lab.check_texts(reviews(spark, sf).select("review_id", padded.alias("review_text")))
    return checked.select(
        "review_id", F.length("review_text").cast("bigint").alias("chars"), "length_ok_before_trim", "status"
    )


def q_corpus_union(spark, sf):
    """Reviews as genuine, conversation turns as fake, in one labelled corpus."""
    genuine = reviews(spark, sf).select("review_text")
    fake = table(spark, sf, "conversations").select(F.col("text").alias("review_text"))
    both = lab.union_labelled(genuine, fake)
    return both.groupBy("label").agg(
        F.count(F.lit(1)).alias("reviews"), F.sum(F.length("review_text")).alias("chars")
    )


def q_stratified_split(spark, sf):
    return spl.stratified_split(labelled(spark, sf)).select("review_id", "label", "is_test")


def q_plain_split(spark, sf):
    return spl.plain_split(reviews(spark, sf)).select("review_id", "is_test")


def q_folds(spark, sf):
    return spl.stratified_folds(labelled(spark, sf)).select("review_id", "label", F.col("fold").cast("bigint").alias("fold"))


def q_confusion_metrics(spark, sf):
    values = met.binary_metrics(_predictions(spark, sf), prediction="predicted")
    return values.select(*[F.round(c, 9).alias(c) for c in values.columns])


def q_class_report(spark, sf):
    rows = met.class_report(_predictions(spark, sf), prediction="predicted")
    return rows.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def q_cv_summary(spark, sf):
    """Mean and spread of F1 over five folds of the orders."""
    folded = _predictions(spark, sf).withColumn("fold", F.pmod(F.split("review_id", "-")[0].cast("bigint"), F.lit(5)))
    spread = met.score_spread(met.fold_metrics(folded, prediction="predicted"))
    return spread.select(F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def q_prediction_columns(spark, sf):
    return _scored(spark, sf).select("review_id", "prediction", "confidence", "genuine_probability", "fake_probability")


def q_genuine_only(spark, sf):
    return _scored(spark, sf).filter("prediction = 'Genuine'").groupBy("prediction").agg(
        F.count(F.lit(1)).alias("reviews"), F.min("confidence").alias("least_confidence")
    )


def q_result_summary(spark, sf):
    return rep.result_summary(_scored(spark, sf))


def q_summary_lines(spark, sf):
    return rep.summary_lines(rep.result_summary(_scored(spark, sf)))


def q_confidence_histogram(spark, sf):
    return rep.confidence_histogram(_scored(spark, sf))


def q_report_rows(spark, sf):
    joined = reviews(spark, sf)
    score = F.pmod(F.col("review_id") * 37, F.lit(10_001)) / 10_000.0
    from plaudit.operators.scoring import prediction_columns

    return rep.report_rows(prediction_columns(joined, (score >= 0.5).cast("int"), score))


def q_preview(spark, sf):
    return rep.preview(reviews(spark, sf)).select("review_id", F.substring("review_text", 1, 40).alias("start"))


def queries() -> dict[str, Query]:
    return {name: value for name, value in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    value = _sql_value("label")
    labelled_sql = "SELECT d.doc_id AS review_id, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
    ranked = f"""
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42' || review_id)) AS r,
             count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS n FROM ({labelled_sql})"""
    train = "(n - CAST(ceil(n * 20 / 100.0) AS BIGINT))"
    per = f"""
      SELECT label, c, n, c * {train} // n + (row_number() OVER (ORDER BY c * {train} % n DESC, label)
             <= {train} - sum(c * {train} // n) OVER ())::BIGINT AS train_rows
      FROM (SELECT DISTINCT label, c, n FROM ({ranked}))"""
    starts = f"SELECT label, c, sum(c) OVER (ORDER BY label) - c AS s FROM (SELECT DISTINCT label, c FROM ({ranked}))"
    sizes = f"""
      SELECT label, f, len(list_filter(range(s::BIGINT, (s + c)::BIGINT), lambda j: j % 5 = f)) AS size
      FROM ({starts}), range(5) t(f)"""
    bounds = f"SELECT label, f, sum(size) OVER (PARTITION BY label ORDER BY f) AS hi, size FROM ({sizes})"
    cm = f"""
      SELECT count(*) FILTER (label = 1 AND predicted = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND predicted = 1)::DOUBLE AS fp,
             count(*) FILTER (label = 1 AND predicted = 0)::DOUBLE AS fn, count(*) FILTER (label = 0 AND predicted = 0)::DOUBLE AS tn
      FROM ({PREDICTIONS})"""
    per_class = f"""
      SELECT 0 AS k, 'Fake' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS s FROM ({cm})
      UNION ALL SELECT 1, 'Genuine', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM ({cm})"""
    f1 = "2 * count(*) FILTER (label = 1 AND predicted = 1) / (2 * count(*) FILTER (label = 1 AND predicted = 1) + count(*) FILTER (label <> predicted))::DOUBLE"
    sums = f"""
      SELECT count(*) AS total, count(*) FILTER (prediction = 'Genuine') AS genuine, count(*) FILTER (prediction = 'Fake') AS fake,
             sum(round(confidence * 10000)::BIGINT)::BIGINT AS conf, sum(round(round(compound, 4) * 10000)::BIGINT)::BIGINT AS comp
      FROM ({PREDICTIONS})"""
    summary = f"""
      SELECT total, genuine, fake, {sql_mean('conf', 'total')} AS mean_confidence, {sql_mean('comp', 'total')} AS mean_compound,
             {sql_label('comp / (total * 10000)')} AS sentiment FROM ({sums})"""
    units = lambda e: rounded_ratio_sql(f"round(({e}) * 10000)::BIGINT", "10000", 2)
    conf = "CASE WHEN score >= 0.5 THEN score ELSE round(1 - score, 4) END"
    return {
        "q_drop_missing": f"""
          SELECT review_id, length(review_text)::BIGINT AS chars, label FROM ({RAW_LABELS})
          WHERE review_text IS NOT NULL AND label IS NOT NULL""",
        "q_label_normalise": f"""
          SELECT review_id, {value} AS label FROM ({RAW_LABELS}) WHERE review_text IS NOT NULL AND {value} IS NOT NULL""",
        "q_label_inverted": f"""
          SELECT CASE WHEN lower(trim(label)) IN ('genuine','real','0','false') THEN 1 ELSE 0 END AS label, count(*) AS reviews
          FROM ({RAW_LABELS}) WHERE review_text IS NOT NULL AND {value} IS NOT NULL GROUP BY 1""",
        "q_load_audit": f"""
          SELECT count(*) FILTER (ok AND v IS NOT NULL) AS rows, count(*) FILTER (ok AND v = 1) AS genuine,
                 count(*) FILTER (ok AND v = 0) AS fake, count(*) FILTER (ok AND v IS NULL) AS bad_labels,
                 count(*) FILTER (NOT ok) AS missing
          FROM (SELECT {value} AS v, review_text IS NOT NULL AND label IS NOT NULL AS ok FROM ({RAW_LABELS}))""",
        "q_class_balance": f"""
          SELECT count(*) AS labels, sum(n)::BIGINT AS rows, min(n) AS minority_rows, min(n) / sum(n)::DOUBLE AS minority_share,
                 min(n) / sum(n)::DOUBLE < 0.35 AS imbalanced
          FROM (SELECT label, count(*) AS n FROM ({labelled_sql}) GROUP BY label)""",
        "q_valid_reject": f"""
          SELECT review_id, length({sql_strip('t')})::BIGINT AS chars, length(t) BETWEEN 5 AND 5000 AS length_ok_before_trim,
                 CASE WHEN {sql_is_blank('t')} THEN 'blank' WHEN length(t) BETWEEN 5 AND 5000 THEN 'valid' ELSE 'length' END AS status
          FROM (SELECT doc_id AS review_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(10) || ' ' || text || chr(9)
                WHEN doc_id % 7 = 0 THEN '      ' ELSE text END AS t FROM documents)""",
        "q_corpus_union": """
          SELECT label, count(*) AS reviews, sum(length(t))::BIGINT AS chars FROM (
            SELECT 1 AS label, text AS t FROM documents
            UNION ALL SELECT 0, text FROM conversations) GROUP BY label""",
        "q_stratified_split": f"""
          SELECT review_id, r.label, r <= r.c - train_rows AS is_test FROM ({ranked}) r JOIN ({per}) p ON p.label = r.label""",
        "q_plain_split": """
          SELECT review_id, r <= ceil(n * 20 / 100.0) AS is_test FROM (
            SELECT doc_id AS review_id, row_number() OVER (ORDER BY md5('42' || doc_id)) AS r, count(*) OVER () AS n FROM documents)""",
        "q_folds": f"""
          SELECT review_id, r.label, b.f AS fold FROM ({ranked}) r JOIN ({bounds}) b
          ON b.label = r.label AND r.r <= b.hi AND r.r > b.hi - b.size""",
        "q_confusion_metrics": f"""
          SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
                 round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM ({cm})""",
        "q_class_report": f"""
          SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, s::BIGINT AS support FROM ({per_class})
          UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / (tp + tn + fp + fn), 9), (tp + tn + fp + fn)::BIGINT FROM ({cm})
          UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), sum(s)::BIGINT FROM ({per_class})
          UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 9), round(sum(r * s) / sum(s), 9),
                 round(sum(f * s) / sum(s), 9), sum(s)::BIGINT FROM ({per_class})""",
        "q_cv_summary": f"""
          SELECT round(avg(s), 9) AS mean, round(stddev_pop(s), 9) AS std FROM (
            SELECT {f1} AS s FROM ({PREDICTIONS}) GROUP BY string_split(review_id, '-')[1]::BIGINT % 5)""",
        "q_prediction_columns": f"""
          SELECT review_id, prediction, confidence, genuine_probability, fake_probability FROM ({PREDICTIONS})""",
        "q_genuine_only": f"""
          SELECT prediction, count(*) AS reviews, min(confidence) AS least_confidence FROM ({PREDICTIONS})
          WHERE prediction = 'Genuine' GROUP BY prediction""",
        "q_result_summary": summary,
        "q_summary_lines": f"""
          SELECT 'Total Reviews: ' || total AS line FROM ({summary})
          UNION ALL SELECT 'Genuine: ' || genuine || '   Fake: ' || fake FROM ({summary})
          UNION ALL SELECT 'Overall Sentiment: ' || sentiment FROM ({summary})""",
        "q_confidence_histogram": f"""
          SELECT prediction, least(floor(confidence * 20), 19)::BIGINT AS bin, count(*) AS reviews FROM ({PREDICTIONS}) GROUP BY ALL""",
        "q_report_rows": f"""
          SELECT review_id, regexp_replace(left(text, 55), '[^\\x{{00}}-\\x{{ff}}]', '', 'g') AS review,
                 CASE WHEN score >= 0.5 THEN 'Genuine' ELSE 'Fake' END AS prediction,
                 printf('%.0f%%', ({conf}) * 100) AS confidence,
                 printf('%.2f', {units('score')}) AS genuine_probability,
                 printf('%.2f', {units('round(1 - score, 4)')}) AS fake_probability
          FROM (SELECT doc_id AS review_id, text, (doc_id * 37 % 10001) / 10000.0::DOUBLE AS score FROM documents)
          ORDER BY review_id LIMIT 50""",
        "q_preview": "SELECT doc_id AS review_id, left(text, 40) AS start FROM documents ORDER BY doc_id LIMIT 5",
    }
