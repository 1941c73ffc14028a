"""Templates on hosts of any size, and class words around the main element."""

from __future__ import annotations

import pytest

from plaudit.llm import pages


def test_recurrence_does_not_depend_on_the_size_of_the_host(spark):
    def page(n, extra):
        return f"<body>{extra}<p>story {n}</p></body>"

    large = [(n, "http://large.example/", page(n, "<div>section list</div>" if n < 8 else "")) for n in range(400)]
    small = [(1000 + n, "http://small.example/", page(n, "<div>site name</div>")) for n in range(5)]
    frame = spark.createDataFrame([*large, *small], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.main_texts(frame).collect()} == {i: f"story {i % 1000}" for i, _, _ in [*large, *small]}


@pytest.mark.parametrize("source, text", [
    ("<div class='layout-sidebar'><main><p>a</p></main><div class=ad>no</div></div>", "a"),
    ("<div class='has-widgets'><article><p>a</p></article></div>", "a"),
    ("<div class=related><article>teaser</article></div><article><p>a</p></article>", "a"),
    ("<div class=comments><article class=comment>no</article></div><p>a</p>", "a"),
    ("<aside><div class=widget><main>no</main></div></aside><p>a</p>", "a"),
])
def test_class_words_around_the_main_element(source, text):
    assert pages.Page(source).text(set()) == text


@pytest.mark.parametrize("source, text", [
    ("<article><h2 id='social'>Social history</h2><p>a</p><h2 id='comments'>Comments on the method</h2></article>",
     "Social history\n\na\n\nComments on the method"),
    ("<article><div class='related work'>earlier papers</div><p>a</p></article>", "earlier papers\n\na"),
    ("<article><table class='menu'><tr><td>soup</td></tr></table></article>", "soup"),
    ("<article><p>let <math><mi>x</mi></math> be</p></article>", "let x be"),
    ("<article><p>a</p><div class='ad'>buy</div><div class='ad-slot clearfix'>buy</div></article>", "a"),
    ("<article><p>a</p><ol class='comment-list'><li>first!</li></ol><section id='comments'>no</section></article>", "a"),
    ("<article><div class='has-comments'><p>a</p></div><div class='share'>tweet</div></article>", "a"),
    ("<div class='notice'>cookies</div><h1 class='menu'>Menu</h1><p>a</p>", "Menu\n\na"),
])
def test_words_leave_out_furniture_only(source, text):
    assert pages.Page(source).text(set()) == text


def test_deep_nesting_takes_linear_time():
    import time

    start = time.process_time()
    depth = 20_000
    page = pages.Page("".join(f"<div>{n}" for n in range(depth)))
    assert page.text({1}).count("\n\n") == depth - 1
    main = pages.Page("<main>" + "<div><p>x" * 5_000 + "</main>")
    assert main.text({1}).count("x") == 5_000
    assert time.process_time() - start < 8
