"""Page extraction, URL lists, token counts, catalogue and pipeline."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, timedelta
from importlib import import_module

import pyarrow as pa
import pytest
from edge import bag, components, edge_docs, empty_docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import difference, duck

from plaudit.llm import catalog, decontaminate, order, pages, tokencount, toxicity, urlfilter
from plaudit.llm.bpe import encoder

SF = "/root/testdata/sf0.001"

# --- pages -----------------------------------------------------------------------------------

CASES = [
    ("<html><body><nav>menu</nav><article><h1>T</h1><p>a <b>b</b>\n c<br>d<p>e</article><footer>f</footer></body></html>", "T\n\na b c d\n\ne"),
    ("<p>x &amp; y&nbsp;z &copy &#169;</p><script>var a='<p>no</p>'</script><style>p{}</style>q", "x & y z © ©\n\nq"),
    ("<body><div class='ad box'>buy</div><div class=\"reader\">r</div><div id=cookie-notice>c</div><section class=comments><p>c</p></section>t", "r\n\nt"),
    ("<main><header>head</header><p>m</p><form>f <input></form><aside>s</aside></main><p>out</p>", "head\n\nm"),
    ("<article><p>one<ul><li>a<li>b</ul>tail</article><article class=comment>no</article>", "one\n\na\n\nb\n\ntail"),
    ("<p>1 < 2 and <3</p><!-- c --><p>d<!-- open", "1 < 2 and <3\n\nd"),
    ("<article><p>cut <a href='x", "cut"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a b\n\nc"),
    ("<div><p>a</div>b</p>c", "a\n\nbc"),
    ("<p>a <span class=ad>no</span>b</p>", "a b"),
    ("", ""), (None, ""), ("   ", ""), ("plain", "plain"), ("</p></div>x", "x"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_main_text_cases(source, text):
    assert pages.Page(source or "").text(set()) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "</table>", "<article>", "</article>", "<script>", "</script>", "x", "&lt;", "<", '"', "<a b='", "<!--", "-->"]), max_size=25))
def test_any_markup_is_read(parts):
    page = pages.Page("".join(parts))
    page.candidates(), page.signature(), page.text({1})


def _site():
    out = []
    for n in range(40):
        body = f"<div><p>story {n} of many</p><p>shared line</p></div>"
        out.append((n, f"https://U@Site.example:80/p/{n}", f"<body><div><span>Best site</span> ever</div>{body}<div>{n} views</div></body>"))
    out += [(100 + n, "http://other.example/", f"<body><div>Best site ever</div><p>page {n}</p></body>") for n in range(4)]
    out += [(200 + n, "http://copies.example/x", "<body><div>same page</div><p>everywhere</p></body>") for n in range(30)]
    return [*out, (None, None, None), (300, "not a url", "<p>x</p>"), (301, "http://e.example", ""), (301, "http://e.example", "")]


def test_templates_are_deleted_where_they_recur(spark):
    frame = spark.createDataFrame([(*r, "x") for r in _site()], "page_id long, url string, html string, `TEXT` string")
    wanted = Counter()
    for i, url, source in _site():
        text = pages.Page(source or "").text(set())
        if url and "Site.example" in url:
            # The banner and the repeated paragraph recur on 40 pages; the copies of one page do not count.
            text = f"story {i} of many\n\n{i} views"
        wanted[(i, url, text, len(text))] += 1
    assert bag(pages.main_texts(frame)) == wanted
    assert bag(pages.main_texts(frame, broadcast_rows=-1)) == wanted
    assert pages.main_texts(frame.limit(0)).count() == 0


def test_shared_prose_of_articles_stays(spark):
    frame = spark.createDataFrame(
        [(n, "http://a.example/", f"<div>banner</div><article><p>text {n}</p><p>passage</p><div>Read more</div></article>") for n in range(20)],
        "page_id long, url string, html string",
    )
    assert {r.text for r in pages.main_texts(frame).collect()} == {f"text {n}\n\npassage" for n in range(20)}


# --- URL lists -------------------------------------------------------------------------------


def test_as_of_join_equals_plain_replay(spark):
    draw = random.Random(4)
    start = date(2024, 1, 1)
    names = ["a.example", "b.a.example", "example", "x.org"]
    entries = [("domain", n) for n in names] + [("prefix", "a.example/p/"), ("prefix", "x.org/"), ("url", "x.org/p/q")]
    events = [(draw.choice("LM"), *draw.choice(entries), start + timedelta(draw.randint(0, 20)), draw.choice(["add", "remove"])) for _ in range(60)]
    urls = ["http://A.example/p/q?x", "https://u@c.b.a.example:8/z", "http://x.org/p/q#f", "http://ba.example/p/", "x.org/p/q", "", None, "http://x.org"]
    days = [None, *[start + timedelta(k) for k in range(0, 24, 3)]]
    captures = [(draw.choice(urls), draw.choice(days), n) for n in range(120)]
    captures += captures[:5]

    def keys(url):
        if not url or "://" not in url:
            return set()
        rest = url.split("://")[1].split("?")[0].split("#")[0].split("/", 1)
        host = rest[0].split("@")[-1].split(":")[0].lower()
        path = "/" + rest[1] if len(rest) > 1 else ""
        labels, steps = host.split("."), (host + path).split("/")[:-1]
        return ({("domain", ".".join(labels[i:])) for i in range(len(labels))}
                | {("prefix", "/".join(steps[: i + 1]) + "/") for i in range(len(steps))} | {("url", host + path)})

    def active(entry, day):
        """Day since when the entry has been active, by replaying its events."""
        since = None
        for when in sorted({e[3] for e in events if e[:3] == entry and e[3] <= day}):
            on = any(e[4] == "add" for e in events if e[:3] == entry and e[3] == when)
            since = (since or when) if on else None
        return since

    wanted = Counter()
    for url, day, n in captures:
        met = {(name, active((name, *k), day)) for name in "LM" for k in keys(url)} if day else set()
        met = {m for m in met if m[1]}
        wanted[(url, day, n, bool(met), tuple(sorted({m[0] for m in met})), min((m[1] for m in met), default=None))] += 1
    log = spark.createDataFrame([*events, *events[:3], (None, "domain", "x.org", start, "add")], "list string, kind string, pattern string, day date, action string")
    frame = spark.createDataFrame(captures, "url string, day date, list int")
    found = urlfilter.judge_captures(frame, urlfilter.intervals_of(log))
    assert Counter((*r[:4], tuple(r.lists), r.since) for r in found.collect()) == wanted
    none = urlfilter.judge_captures(frame, urlfilter.intervals_of(log.limit(0)))
    assert not none.filter("blocked").count() and none.count() == len(captures)
    assert urlfilter.judge_captures(frame.limit(0), urlfilter.intervals_of(log)).count() == 0


# --- token counts ----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 '\n\tsrelv é.漢", max_size=600), st.lists(st.tuples(st.integers(-2, 700), st.integers(0, 300), st.text(alphabet="a '\nrel", max_size=30)), max_size=4))
def test_edited_counts_equal_a_full_count(text, edits):
    encode = encoder(catalog.VOCABULARY)
    (pair,) = encode.count(pa.array([text]))
    tree = tokencount.TokenTree(*[x.tolist() for x in tokencount._leaves(*pair)])
    for at, removed, added in edits:
        text, _ = tree.edit(text, at, removed, added, encode)
        assert tree.tokens == len(encode._library.encode_ordinary(text)) and sum(tree.levels[0][0]) == len(text)
        for low, high in zip(tree.levels, tree.levels[1:]):
            for a, b in zip(low, high):
                assert b == [sum(a[i : i + tokencount.FANOUT]) for i in range(0, len(a), tokencount.FANOUT)]


def test_only_a_region_is_encoded_again():
    encode = encoder(catalog.VOCABULARY)
    text = " ".join(f"word{i}" for i in range(20_000))
    (pair,) = encode.count(pa.array([text]))
    tree = tokencount.TokenTree(*[x.tolist() for x in tokencount._leaves(*pair)])
    _, n = tree.edit(text, len(text) // 2, 3, "new words", encode)
    assert n <= 3 * tokencount.LEAF


def test_token_counts_of_odd_rows(spark):
    edits = spark.createDataFrame(
        [(1, 1, 3, 0, "abc"), (1, 2, 0, 9, None), (3, 1, 5, 2, "x"), (4, 1, 0, 0, "was empty"), (9, 1, 10_000, 50, " y "), (None, 1, 0, 0, "z"), (77, 1, 0, 0, "z"), (10, 1, None, None, "q")],
        "doc_id long, version int, at int, removed int, added string",
    )
    plan = tokencount.with_edits(edge_docs(spark), edits)
    found = tokencount.apply_edits(tokencount.build_trees(plan, catalog.VOCABULARY, "edits"), catalog.VOCABULARY).collect()
    assert len(found) == len(rows())
    encode = encoder(catalog.VOCABULARY)._library.encode_ordinary
    steps = {1: [(3, 0, "abc"), (0, 9, "")], 3: [(5, 2, "x")], 4: [(0, 0, "was empty")], 9: [(10_000, 50, " y ")], 10: [(0, 0, "q")]}
    wanted = Counter()
    for doc_id, text, *_ in rows():
        text = text or ""
        before = len(encode(text))
        for at, removed, added in steps.get(doc_id, []):
            text = text[:at] + added + text[at + removed :]
        wanted[(doc_id, before, text, len(encode(text)))] += 1
    assert Counter((r.doc_id, r.n_before, r.new_text, r.n_after) for r in found) == wanted
    assert all(sum(r.new_tokens) == r.n_after for r in found)
    none = tokencount.with_edits(empty_docs(spark), edits)
    assert tokencount.apply_edits(tokencount.build_trees(none, catalog.VOCABULARY, "edits"), catalog.VOCABULARY).count() == 0


# --- catalogue and pipeline ------------------------------------------------------------------


def test_queries_with_sql_equal_it(spark):
    con = duck(SF)
    wrong = {name: found for name, sql in catalog.oracle_sql().items() if (found := difference(catalog.queries()[name](spark, SF), con, sql))}
    assert not wrong


def test_one_query_for_every_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in catalog.queries()) == list(range(1, 11))


def test_pipeline_keeps_and_drops_as_its_rules_say(spark):
    pipeline = import_module("corpus_pipeline")
    docs = catalog.table(spark, SF, "documents")
    plain = {r.doc_id: r.text for r in docs.collect()}
    left, columns = docs, docs.columns
    after = []
    for name, work in pipeline.STAGES[:-1]:
        left = pipeline.stage(work(spark, left, SF))
        assert left.columns == columns, name
        after.append(Counter(r.doc_id for r in left.collect()))
    model = toxicity.fit_toxicity(docs, catalog.table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.predicted}
    ids = [i for i in sorted(plain) if i not in toxic]
    assert set(after[0]) == set(ids)
    part = components([plain[i] for i in ids])
    firsts = {}
    for i, p in zip(ids, part):
        firsts.setdefault(p, i)
    assert set(after[1]) == set(firsts.values())
    judged = decontaminate.contamination(docs, catalog.table(spark, SF, "benchmark")).collect()
    assert set(after[2]) == set(after[1]) - {r.doc_id for r in judged if r.contaminated}
    assert set(after[3]) <= set(after[2]) and max(after[3].values()) <= 3
    final = pipeline.run(spark, SF).collect()
    encode = encoder(catalog.VOCABULARY)._library.encode_ordinary
    length = order.OrderConfig(catalog.VOCABULARY).length
    wanted = Counter()
    for i, n in after[3].items():
        size = len(encode(plain[i])) + 1
        wanted.update({(i, k): n for k in range(-(-size // length))})
    assert Counter((r.doc_id, r.seq_no) for r in final) == wanted
    assert sorted(r.slot for r in final) == list(range(len(final)))


def test_stages_on_odd_and_empty_documents(spark, tmp_path):
    pipeline = import_module("corpus_pipeline")
    spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "quick brown fox jumps"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, work in pipeline.STAGES[:-1]:
            done = work(spark, docs, str(tmp_path))
            assert done.columns == docs.columns
            assert done.count() <= 3 * max(docs.count(), 0)
        assert (pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0) == (docs.count() > 0)
