"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.llm import (
    collocation, decontaminate, hostrules, jaccard, lmscore, mixing, order, pages, prefixtrie, secrets, tokencount, toxicity,
    urlfilter,
)
from plaudit.llm.common import new_stage, stage

VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The documents are in several languages; scores go by the vocabulary made for many.
LM_VOCABULARY = os.environ.get("LM_TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SOURCE_WEIGHTS, MAX_REPEATS, MIX_SEED = (5, 2, 1), 3, 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(documents: DataFrame) -> DataFrame:
    """Shards written for all documents, then read back slot by slot; tokens as a digest."""
    spark, config = documents.sparkSession, order.OrderConfig(VOCABULARY)
    path = new_stage(spark)
    order.write_shards(documents, path, config)
    rows = order.read_slots(spark, path, config)
    return rows.withColumn("tokens_md5", F.md5("tokens")).drop("tokens")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = secrets.paths_of(table(spark, sf_dir, "documents"))
    ledger = stage(secrets.scan_unseen(paths, None, secrets.VERSIONS))
    return secrets.report(secrets.findings_of(paths, ledger))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.document_sizes(table(spark, sf_dir, "documents"))
    plan = mixing.plan_mix(sizes, SOURCE_WEIGHTS, MAX_REPEATS, MIX_SEED)
    return mixing.mix_sizes(sizes, plan, MIX_SEED)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(documents, benchmark, slop=decontaminate.SLOP)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of its url, fetched on a day that follows from its id."""
    fetched = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("day"))


def list_events(pages_table: DataFrame) -> DataFrame:
    """A dated block list over the hosts and folders that the pages have.

    Numbers of md5 digests choose the entries and their days: a host is on ``tracking``
    for two spells or on ``spam`` for good, a folder is on ``section`` for one spell.
    """
    host, path = urlfilter.host_and_path(F.col("url"))
    seen = pages_table.select(host.alias("host"), F.regexp_extract(path, "^(/[^/]+/)", 1).alias("folder"))
    hosts = seen.select(F.lit("domain").alias("kind"), F.col("host").alias("pattern")).filter("pattern <> ''").distinct()
    folders = seen.filter("folder <> ''").select(F.lit("prefix").alias("kind"), F.concat("host", "folder").alias("pattern")).distinct()
    entries = hosts.unionByName(folders).withColumn("n", F.conv(F.substring(F.md5("pattern"), 1, 7), 16, 10).cast("long"))

    def events(name, *turns):
        first = F.col("n") % 300
        return F.array(*[F.struct(F.lit(name).alias("list"), (first + after).alias("after"), F.lit(action).alias("action")) for after, action in turns])

    chosen = (
        F.when(F.col("kind") == "prefix", F.when(F.col("n") % 3 == 0, events("section", (0, "add"), (200, "remove"))))
        .when(F.col("n") % 4 == 0, events("tracking", (0, "add"), (90, "remove"), (150, "add"), (300, "remove")))
        .when(F.col("n") % 4 == 1, events("spam", (30, "add"), (60, "add")))
    )
    rows = entries.select("kind", "pattern", F.explode(chosen).alias("e"))
    return rows.select(
        "e.list", "kind", "pattern", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("e.after").cast("int")).alias("day"), "e.action"
    )


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    intervals = urlfilter.intervals_of(list_events(table(spark, sf_dir, "pages")))
    judged = urlfilter.judge_captures(captures(spark, sf_dir), intervals)
    return judged.select("page_id", "url", "day", "blocked", F.array_join("lists", ",").alias("lists"), "since")


def edited(documents: DataFrame) -> DataFrame:
    """Every document with three edits at places that follow from its id: a phrase put in, characters cut, a word replaced."""
    size = F.length(F.coalesce("text", F.lit("")))

    def place(n):
        return F.pmod(F.xxhash64(F.lit(n), "doc_id"), size + 1).cast("int")

    steps = [(place(1), 0, " and one more, don't"), (place(2), 7, ""), (place(3), 4, "word")]
    made = [F.struct(at.alias("at"), F.lit(cut).alias("removed"), F.lit(new).alias("added")) for at, cut, new in steps]
    return documents.withColumn("edits", F.array(*made))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    trees = tokencount.build_trees(documents, VOCABULARY, "edits")
    return tokencount.apply_edits(trees, VOCABULARY).select("doc_id", "n_before", "n_after", "n_encoded")


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(table(spark, sf_dir, "documents"), LM_VOCABULARY)


def queries() -> dict:
    return {name: value for name, value in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_lists": _URL_LISTS, "op10_host_rules": _HOST_RULES, "op11_collocations": _COLLOCATIONS, "op12_prefix_trie": _PREFIX_TRIE}


_URL_LISTS = r"""
WITH seen AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 7919) % 730)::INTEGER AS day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)', 2) AS path FROM pages),
entries AS (
  SELECT DISTINCT 'domain' AS kind, host AS pattern FROM seen WHERE host <> ''
  UNION ALL
  SELECT DISTINCT 'prefix', host || regexp_extract(path, '^(/[^/]+/)', 1) FROM seen WHERE regexp_extract(path, '^(/[^/]+/)', 1) <> ''),
numbered AS (SELECT *, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS n FROM entries),
spells AS (
  SELECT 'section' AS list, kind, pattern, n % 300 AS a, n % 300 + 200 AS b FROM numbered WHERE kind = 'prefix' AND n % 3 = 0
  UNION ALL SELECT 'tracking', kind, pattern, n % 300, n % 300 + 90 FROM numbered WHERE kind = 'domain' AND n % 4 = 0
  UNION ALL SELECT 'tracking', kind, pattern, n % 300 + 150, n % 300 + 300 FROM numbered WHERE kind = 'domain' AND n % 4 = 0
  UNION ALL SELECT 'spam', kind, pattern, n % 300 + 30, NULL FROM numbered WHERE kind = 'domain' AND n % 4 = 1),
dated AS (
  SELECT list, kind, pattern, DATE '2024-01-01' + a::INTEGER AS a, DATE '2024-01-01' + b::INTEGER AS b FROM spells),
met AS (
  SELECT page_id, list, a FROM seen JOIN dated ON day >= a AND (b IS NULL OR day < b) AND
    CASE kind WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern) ELSE starts_with(host || path, pattern) END)
SELECT s.page_id, s.url, s.day, count(m.list) > 0 AS blocked,
       coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists, min(m.a) AS since
FROM seen s LEFT JOIN met m ON s.page_id = m.page_id GROUP BY s.page_id, s.url, s.day
"""


_HOST_RULES = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS at FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM words),
base AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
ruled AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeated FROM base),
failed AS (SELECT *, short OR repeated AS base_failed FROM ruled),
hosts AS (
  SELECT source, count(*) AS n, count_if(short) AS a, count_if(repeated) AS b, count_if(base_failed) AS c FROM failed GROUP BY source),
moments AS (
  SELECT avg(a / n) AS ma, avg(b / n) AS mb, avg(c / n) AS mc,
         var_pop(a / n) AS va, var_pop(b / n) AS vb, var_pop(c / n) AS vc FROM hosts),
prior AS (
  SELECT ma, mb, mc,
    CASE WHEN va > 0 THEN least(greatest(ma * (1 - ma) / va - 1, 2), 10000) ELSE 10000 END AS wa,
    CASE WHEN vb > 0 THEN least(greatest(mb * (1 - mb) / vb - 1, 2), 10000) ELSE 10000 END AS wb,
    CASE WHEN vc > 0 THEN least(greatest(mc * (1 - mc) / vc - 1, 2), 10000) ELSE 10000 END AS wc FROM moments),
rates AS (
  SELECT source, (a + ma * wa) / (n + wa) AS ra, (b + mb * wb) / (n + wb) AS rb, (c + mc * wc) / (n + wc) AS rc
  FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND greatest(ra, rb, rc) <= 0.5 AS kept, round(rc, 6) AS host_rate
FROM failed JOIN rates ON failed.source IS NOT DISTINCT FROM rates.source
"""


# CRC-32 of the decimal conv_id, bit by bit: a byte is put in, then eight shifts (the -1s).
_PREFIX_TRIE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, id, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, id) AS pos FROM turns),
own AS (
  SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id),
bases AS (SELECT o.conv_id, o.h, least(o.h, coalesce(b.n, 0)) AS lent, o.conv_id - o.conv_id % 100 AS base FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
made AS (
  SELECT b.conv_id, p.pos, p.id, p.size FROM bases b JOIN placed p ON p.conv_id = b.base AND p.pos <= b.lent
  UNION ALL SELECT b.conv_id, p.pos - b.h + b.lent, p.id, p.size FROM bases b JOIN placed p ON p.conv_id = b.conv_id AND p.pos > b.h),
paths AS (
  SELECT conv_id, pos AS depth, size, md5(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM made
  UNION ALL SELECT conv_id, 0, 0, '' FROM own),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
linked AS (SELECT p.*, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above, p.depth = l.n AS ends FROM paths p JOIN lengths l USING (conv_id)),
nodes AS (
  SELECT key, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM linked GROUP BY key, depth),
kids AS (SELECT above AS key, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT p.key, p.depth, sum((n.n_convs - 1) * n.size) AS saved, count_if(k.n IS NULL) AS leaves
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.key = n.key AND k.depth = n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM nodes n LEFT JOIN kids k ON k.key = n.key AND k.depth = n.depth JOIN sums s ON s.key = n.key AND s.depth = n.depth
LEFT JOIN nodes u ON u.key = n.above AND u.depth = n.depth - 1
"""


_COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
grams AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM runs),
f AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
found AS (SELECT * FROM f WHERE k > 1 AND a >= 100),
whole AS (
  SELECT * FROM found c WHERE NOT EXISTS (
    SELECT 1 FROM found b WHERE b.lang = c.lang AND b.k > c.k AND b.a >= c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM whole),
scored AS (
  SELECT x.lang, x.phrase, x.a, g.a AS l, h.a AS r, n, c, (1000::HUGEINT * x.a * n) // (g.a::HUGEINT * h.a) AS score
  FROM cuts x JOIN totals USING (lang)
  JOIN f g ON g.lang = x.lang AND g.phrase = array_to_string(list_slice(w, 1, c), ' ')
  JOIN f h ON h.lang = x.lang AND h.phrase = array_to_string(list_slice(w, c + 1, x.k), ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest QUALIFY rank <= 2000
"""
