"""Main text of web pages with site templates removed.

1. Each page is cut into elements and blocks of text. Elements that hold no main text by
   their kind (menus, forms, scripts, ...) or by the words of their class, id or role
   (adverts, comments, notices, ...) are left out, as is everything outside ``main`` or
   ``article`` where a page has one. Words of class, id and role never leave out a heading, nor an
   element around the page's ``main``, or around its only articles. Inside ``main`` and ``article``
   they leave out containers and lists only, and only by a whole class or id whose every part names
   such furniture ("comment-list", but not "related work" and not "has-comments").
2. Every other block-level subtree is hashed (tag and text, from the leaves up), and the
   hashes are counted per host: on how many pages with different content each occurs.
3. Subtrees that recur on at least ``MIN_PAGES`` different pages are deleted, whatever the
   size of the host; on a host of ``LEAST_PAGES`` to ``MIN_PAGES`` different pages, those
   that are on all of them. A smaller host shows no recurrence and loses nothing. Prose inside the main element (paragraphs, headings,
   lists, quotations, tables) is never deleted, so a passage that articles share, or an
   article with many copies, is no template; copies of a page count once.

Counting is one aggregate with partial sums, so one host with a third of all pages is no
hot key. Templates are broadcast only below a measured size; otherwise pages take their
templates by a join on a hash of the page, never gathered by host.

Null and empty html give an empty text. A null or broken url is the host ''. Broken and
cut-off markup is read as far as it goes. Repeated rows give equal texts, a null page_id
stays, further columns are ignored, an empty table stays empty.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import BROADCAST_ROWS, columns_of, map_columns, slices, stage

MIN_PAGES, LEAST_PAGES = 8, 5
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)([^>]*)>?""", re.S
)
_WORDS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PROSE = _HEADINGS | {
    "p", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "figure", "figcaption", "caption",
}
_BLOCK = _PROSE | {
    "html", "body", "main", "article", "section", "div", "header", "footer", "nav", "aside", "form", "address", "hr",
    "fieldset", "details", "summary", "dialog", "menu", "hgroup", "search", "center",
}
_DROPPED = _RAW | {
    "head", "nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "search", "svg", "canvas", "object", "audio",
    "video", "template", "datalist", "applet", "map",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
# Words of class, id and role that name what is not the article.
_NAMES = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*"
    r"|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|comments?|disqus|respond|replies|social|share|sharing"
    r"|related|recommended|widgets?|toolbar|pagination|pager|login|signup)"
)
_PLAIN = {"html", "body", "main"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


# Inside an article, parts that may stand beside such a word, and words that name furniture only alone.
_PARTS = re.compile(
    r"(?:list|box|block|wrapper|container|section|area|bar|links?|buttons?|slot|unit|label|item|items|thread|form|posts?|stories|content|inner|\d+)"
)
_ALONE = {"related", "recommended", "social", "share", "sharing", "alert", "notice", "notices", "respond", "replies", "banner", "login", "nav", "menu"}
_CONTAINERS = {"div", "section", "details", "ul", "ol", "center", "address", "fieldset", "hgroup", "span"}


def _named_away(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the words of class, id and role leave an element out; ``inside``: within main or article."""
    if tag in _PLAIN or tag in _HEADINGS or "=" not in attributes or (inside and tag not in _CONTAINERS):
        return False
    for found in _WORDS.finditer(attributes):
        value = "".join(x or "" for x in found.groups()).lower()
        if not inside:
            if any(word in _ROLES or _NAMES.fullmatch(word) for word in re.split(r"[\s_\-]+", value)):
                return True
            continue
        names = value.split()
        for name in names:
            parts = [part for part in re.split(r"[_\-]+", name) if part]
            words = [part for part in parts if part in _ROLES or _NAMES.fullmatch(part)]
            if words and all(part in words or _PARTS.fullmatch(part) for part in parts):
                if len(names) == 1 or not set(words) <= _ALONE:
                    return True
    return False


class Page:
    """Blocks of text with their elements, and the elements' parents, marks and hashes."""

    def __init__(self, source: str) -> None:
        self.exempt: set[int] = set()
        self._parse(source)
        self.exempt = self._holders()
        if self.exempt:  # elements have the same numbers again
            self._parse(source)
        self.main = self._main()

    def _parse(self, source: str) -> None:
        self.tags, self.parents, self.dropped = ["#"], [-1], [False]
        self.inside, self.owners, self.count = [False], [0], Counter()  # within main or article; owner of text; open tags
        self.named: set[int] = set()
        self.kinds: set[int] = set()
        self.parts: list[list[str]] = [[]]
        self.blocks: list[tuple[str, int]] = []
        self.stack, self.pending, self.owner = [0], [], 0
        self._read(source)
        while len(self.stack) > 1:
            self._close()
        self._flush()

    def _holders(self) -> set[int]:
        """Elements left out by their words alone around the page's main element, or else around its only articles."""
        for wanted in ("main", "article"):
            found = [e for e, tag in enumerate(self.tags) if tag == wanted and e not in self.named]
            if any(not self.dropped[e] for e in found):
                return set()
            by_kind = self._below(self.kinds)
            lost = [e for e in found if not by_kind[e]]
            if lost:
                around, seen = set(), set()
                for e in lost:
                    for above in self.above(e):
                        if above in seen:
                            break
                        seen.add(above)
                        if above in self.named:
                            around.add(above)
                return around
        return set()

    def _below(self, marked: set[int]) -> list[bool]:
        """For every element whether it or one above it is marked; parents come before children."""
        found = [False] * len(self.tags)
        for e, parent in enumerate(self.parents):
            found[e] = e in marked or (parent >= 0 and found[parent])
        return found

    def _flush(self) -> None:
        text = " ".join("".join(self.pending).split())
        if text:
            self.blocks.append((text, self.owner))
            self.parts[self.owner].append(text)
        self.pending = []

    def _open(self, tag: str, attributes: str) -> None:
        above = self.stack[-1]
        inside = self.inside[above]
        number = len(self.tags)
        away = tag in _DROPPED or (tag == "header" and not inside)
        if away:
            self.kinds.add(number)
        elif number not in self.exempt and _named_away(tag, attributes, inside):
            self.named.add(number)
            away = True
        self.tags.append(tag)
        self.parents.append(above)
        self.dropped.append(away or self.dropped[above])
        self.inside.append(inside or tag in ("article", "main"))
        self.owners.append(number if tag in _BLOCK or self.dropped[number] else self.owners[above])
        self.parts.append([])
        self.count[tag] += 1
        self.stack.append(number)

    def _close(self) -> None:
        element = self.stack[-1]
        if self.tags[element] in _BLOCK or self.tags[element] in _DROPPED:
            self._flush()
        self.stack.pop()
        self.count[self.tags[element]] -= 1
        self._own()
        if self.parts[element]:
            if self.tags[element] in _BLOCK:
                content = "\x00".join(self.parts[element])
                mark = xxhash.xxh64_intdigest(f"{self.tags[element]}\x00{content}".encode("utf-8", "surrogatepass"))
                self.parts[self.parents[element]].append(f"\x01{mark:x}")
                self.parts[element] = [mark]
                return
        self.parts[self.parents[element]].extend(self.parts[element])
        self.parts[element] = []

    def _own(self) -> None:
        self.owner = self.owners[self.stack[-1]]

    def _close_upto(self, names: set[str], stop: set[str]) -> None:
        if not any(self.count[name] for name in names):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in names:
                while len(self.stack) > depth:
                    self._close()
                return
            if tag in stop:
                return

    def _read(self, source: str) -> None:
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            if found is None:
                break
            self._text(source[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self._close_upto({tag}, {"table"} if tag in _PROSE and tag not in ("table", "thead", "tbody", "tfoot", "tr") else set())
                continue
            if tag in _VOID:
                if tag == "hr":
                    self._flush()
                self.pending.append(" ")
                continue
            if tag in _BLOCK or tag in _DROPPED:
                self._flush()
            if tag in _BLOCK and tag not in ("html", "body"):
                self._close_upto({"p"}, {"table", "button", "object"})
            if tag in _HEADINGS:
                self._close_upto(_HEADINGS, _BLOCK - _HEADINGS)
            if tag in _CLOSES:
                self._close_upto(*_CLOSES[tag])
            if tag in ("td", "th"):
                self.pending.append(" ")
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])|</{tag}$", re.I).search(source, at)
                at = end.start() if end else len(source)
                if end:
                    at = source.find(">", end.end()) + 1 or len(source)
                continue
            self._open(tag, found[3] + found[4])
            self._own()
        self._text(source[at:])

    def _text(self, raw: str) -> None:
        if raw and not self.dropped[self.owner]:
            self.pending.append(entities.unescape(raw) if "&" in raw else raw)
        elif raw:
            # Left-out text still makes the hash of its element.
            self.parts[self.owner].append(" ".join(raw.split()))

    def _main(self) -> set[int]:
        """Outermost main elements, or else articles; empty if a page has neither."""
        for wanted in ("main", "article"):
            found = {e for e, tag in enumerate(self.tags) if tag == wanted and not self.dropped[e]}
            if found:
                within = self._below(found)
                return {e for e in found if not within[self.parents[e]]}
        return set()

    def above(self, element: int):
        while element >= 0:
            yield element
            element = self.parents[element]

    def kept(self) -> list[tuple[str, int]]:
        """Blocks by kind and place, before templates."""
        within = self._below(self.main)
        return [(text, e) for text, e in self.blocks if not self.dropped[e] and (not self.main or within[e])]

    def candidates(self) -> dict[int, int]:
        """Element to hash of all subtrees that may be deleted."""
        found, within, holders = {}, self._below(self.main), set()
        for e in self.main:
            for above in self.above(e):
                if above in holders:
                    break
                holders.add(above)
        for e in range(1, len(self.tags)):
            if not self.parts[e] or self.tags[e] not in _BLOCK or e in holders or self.tags[e] in ("html", "body"):
                continue
            if self.tags[e] in _PROSE and within[e]:
                continue
            if self.parts[e]:
                found[e] = self.parts[e][0]
        return found

    def signature(self) -> int:
        return xxhash.xxh64_intdigest("\n".join(text for text, _ in self.kept()).encode("utf-8", "surrogatepass"))

    def text(self, templates: set[int]) -> str:
        gone = self._below({e for e, mark in self.candidates().items() if mark in templates} if templates else set())
        return "\n\n".join(text for text, e in self.kept() if not gone[e])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _signed(values) -> np.ndarray:
    return np.array(list(values), dtype=np.uint64).view(np.int64)


def templates_of(pages: DataFrame, min_pages: int = MIN_PAGES, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host_key, mark) of the subtrees that recur on many different pages of a host."""

    def count(batches):
        for batch in slices(batches):
            seen = set()
            for host, source in zip(batch.column("host_key").to_pylist(), batch.column("html").to_pylist()):
                page = Page(source or "")
                sign = page.signature()
                seen.add((host, sign, 0))
                seen.update((host, sign, mark) for mark in page.candidates().values())
            hosts = [h for h, _, _ in seen]
            yield pa.RecordBatch.from_pydict({
                "host_key": pa.array(hosts, pa.int64()), "page": pa.array(_signed(s for _, s, _ in seen)), "mark": pa.array(_signed(m for _, _, m in seen)),
            })

    rows = pages.select("host_key", "html").mapInArrow(count, "host_key long, page long, mark long")
    counts = stage(rows.distinct().groupBy("host_key", "mark").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least_pages) | (F.col("mark") == 0)))
    totals = counts.filter("mark = 0").select("host_key", F.col("n").alias("pages"))
    many = counts.filter("mark <> 0").join(totals, "host_key").filter(F.col("n") >= F.least(F.lit(min_pages), "pages"))
    return stage(many.select("host_key", "mark"))


def main_texts(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = columns_of(pages, "page_id", "url", "html")
    rows = rows.withColumn("host_key", F.xxhash64(host_of(F.col("url"))))
    templates = templates_of(rows)
    if templates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        listed: dict[int, set[int]] = {}
        for host, mark in templates.collect():
            listed.setdefault(host, set()).add(mark % (1 << 64))
        shared = pages.sparkSession.sparkContext.broadcast(listed)
        made = _texts(rows, lambda batch: [shared.value.get(h, ()) for h in batch.column("host_key").to_pylist()])
    else:
        made = _texts(_with_marks(rows, templates), lambda batch: [{m % (1 << 64) for m in marks or ()} for marks in batch.column("marks").to_pylist()])
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _with_marks(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with the templates that they hold, by joins on marks and on the page's content."""

    def marks(batches):
        for batch in slices(batches):
            out = {(host, key, mark) for host, key, source in zip(*(batch.column(c).to_pylist() for c in ("host_key", "key", "html")))
                   for mark in Page(source or "").candidates().values()}
            yield pa.RecordBatch.from_pydict({
                "host_key": pa.array([h for h, _, _ in out], pa.int64()), "key": pa.array([k for _, k, _ in out], pa.int64()),
                "mark": pa.array(_signed(m for _, _, m in out)),
            })

    rows = rows.withColumn("key", F.xxhash64("host_key", "html"))
    held = rows.select("host_key", "key", "html").mapInArrow(marks, "host_key long, key long, mark long")
    found = held.join(templates, ["host_key", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("marks"))
    return rows.join(found, "key", "left").select("page_id", "url", "html", "marks")


def _texts(rows: DataFrame, templates) -> DataFrame:
    def make():
        def work(batch):
            sources = batch.column("html").to_pylist()
            return {"text": pa.array([Page(s or "").text(t) for s, t in zip(sources, templates(batch))], pa.string())}

        return work

    return map_columns(rows, make, rows.columns, "text string")
