"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classes each block by
its length, link density and density of stop words as good, bad, short (too short to
tell) or near (nearly good). The second pass gives short and near blocks the label of
their nearest decided neighbours: a run between two good blocks is good, between two
bad ones bad, and in between near blocks are good and short ones bad.

Markup settles only boilerplate (menus, headers and footers, asides, forms, scripts,
adverts, notices, reader comments). An article or main element is a prior for both passes
if it holds at least as much text that is not bad as the good blocks outside hold: blocks
in it that lack stop words are near, its borders count as good neighbours and what markup
settled within it as none; blocks outside it are short at best, so they stay only between
two good ones. Else the article (a teaser, a card) is a block like others.

The stop words are those of the page's language: for each language that pages declare,
the words that make up ``SHARE`` of the words of its pages' blocks at least, so no list
of a language is needed. A page that declares none, or one without words, goes by the
language whose stop words are most of its own words. See ``stop_words``.

Defined cases: a null page is empty and has an empty text; broken markup, unclosed
elements and undefined references are taken as text or closed at the next block; an
unclosed comment or script reaches to the end; where a tag's quotes leave it open to the
end of the page, quotes are plain characters from there on. Pages are read in one pass
whose time grows with their length, also where they nest deeply or close nothing. Ids and
urls pass through as they are, repeated or null; each row is extracted for itself; an
empty table gives an empty result. Columns other than page_id, url and html are not
looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import saved, slices

# Elements by their part in a page.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("script style noscript template svg math canvas iframe object embed applet audio video select option button textarea title head datalist map".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BOILER = frozenset("nav header footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pager|pagination|popup|promo\w*|related|respond|share|sharing|sidebar|side-bar|signup|skip-link|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert alertdialog".split())

#: Thresholds of the first pass (characters, or shares); the last is for blocks in an article.
SHORT, LONG, LINKS, FEW_STOPS, MANY_STOPS, ARTICLE_LINKS = 70, 200, 0.2, 0.1, 0.2, 0.5
#: The share of a language's words that makes a word a stop word; there are 1 / SHARE at most.
SHARE = 0.004

NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([A-Za-z:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
COMMENT = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])", re.I)
LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2})(?![a-z])", re.I)
WORD = re.compile(r"[^\W\d_]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}


def _is_boiler(tag: str, raw: str) -> bool:
    if tag in BOILER:
        return True
    if not raw.strip():
        return False
    a = _attributes(raw)
    style = a.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    names = f"{a.get('class', '')} {a.get('id', '')}"
    hint = COMMENT if tag in MAIN else HINT
    return hidden or a.get("role", "").lower() in ROLES or bool(tag not in ("html", "body") and hint.search(names))


def tokens(page: str):
    """("text", s), ("open", tag, attributes) and ("close", tag) in page order."""
    at, end, quotes = 0, len(page), True
    closers: dict[str, re.Pattern] = {}
    while at < end:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:]
            return
        if start > at:
            yield "text", page[at:start]
        follows = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            at = page.find("-->", start + 2) + 3
            if at < 3:
                return
            continue
        if page.startswith("<![CDATA[", start):
            close = page.find("]]>", start)
            yield "text", page[start + 9 : close if close >= 0 else end]
            at = close + 3 if close >= 0 else end
            continue
        if follows in ("!", "?") and follows:
            at = page.find(">", start) + 1
            if not at:
                return
            continue
        m = NAME.match(page, start + 1 + (follows == "/"))
        if not m:
            yield "text", "<"
            at = start + 1
            continue
        close = -1
        if quotes:
            stop = STOP.search(page, m.end())
            while stop and stop[0] != ">":
                shut = page.find(stop[0], stop.end())
                stop = STOP.search(page, shut + 1) if shut >= 0 else None
            close = stop.start() if stop else -1
            quotes = close >= 0
        if close < 0:
            close = page.find(">", m.end())
            if close < 0:  # no tag ends from here on
                yield "text", page[start:].replace("<", " ")
                return
        at = close + 1
        tag = m[0].lower()
        if follows == "/":
            yield "close", tag
            continue
        yield "open", tag, page[m.end() : close]
        if tag in RAW:
            if tag not in closers:
                closers[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
            found = closers[tag].search(page, at)
            if not found:
                return
            at = found.end()
            yield "close", tag


class Block:
    __slots__ = ("parts", "linked", "boiler", "main", "heading")

    def __init__(self, boiler: bool, main: bool, heading: bool):
        self.parts, self.linked, self.boiler, self.main, self.heading = [], 0, boiler, main, heading


class Open:
    """The open elements: what they are for the text in them, and where each tag's are."""

    def __init__(self):
        self.stack: list[tuple] = []  # tag, and what it adds to the counts
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.counts = [0, 0, 0]  # boilerplate, dropped, main

    def push(self, tag: str, *adds: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, adds))
        for k, x in enumerate(adds):
            self.counts[k] += x

    def cut(self, place: int) -> None:
        """Close all elements from ``place`` on."""
        while len(self.stack) > place:
            tag, adds = self.stack.pop()
            if tag:
                self.places[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
            for k, x in enumerate(adds):
                self.counts[k] -= x

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def end_link(self) -> None:
        """Links do not nest: an open one ends, and what is in it stays open."""
        while self.places.get("a"):
            place = self.places["a"].pop()
            self.stack[place] = ("", self.stack[place][1])

    def state(self) -> tuple[bool, bool, bool]:
        return self.counts[0] > 0, self.counts[1] > 0, self.counts[2] > 0


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, link density, boilerplate by markup, inside an article, heading) of each block with text."""
    out: list[Block] = []
    opened = Open()
    now = Block(False, False, False)

    def fresh(heading=False):
        nonlocal now
        if now.parts:
            out.append(now)
        boiler, _, main = opened.state()
        now = Block(boiler, main, heading)

    for token in tokens(page):
        if token[0] == "text":
            if not opened.counts[1]:
                s = html.unescape(token[1]) if "&" in token[1] else token[1]
                now.parts.append(s)
                if opened.places.get("a"):
                    now.linked += len("".join(s.split()))
            continue
        tag = token[1]
        before = opened.state()
        if token[0] == "close":
            place = opened.last(tag)
            # an inline end tag does not reach out of the block it is in
            if place >= 0 and (tag in BLOCK or not opened.blocks or opened.blocks[-1] < place):
                opened.cut(place)
            if tag in BLOCK or before != opened.state():
                fresh()
            continue
        raw = token[2]
        if tag == "br":
            now.parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                fresh()
            continue
        if raw.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in BLOCK:
            if tag != "head" and opened.last("head") >= 0:
                opened.cut(opened.last("head"))  # an unclosed head ends at the first block
            # a block closes an open paragraph, and an open inline element within it
            if opened.blocks and opened.stack[opened.blocks[-1]][0] == "p":
                opened.cut(opened.blocks[-1])
            if tag in ("li", "dd", "dt", "option", "td", "th", "tr") and opened.stack and opened.stack[-1][0] == tag:
                opened.cut(len(opened.stack) - 1)
        elif tag == "a":
            opened.end_link()
        # a header within an article holds its heading
        own = _is_boiler(tag, raw) and not (tag == "header" and opened.counts[2])
        opened.push(tag, own, tag in DROPPED or tag in RAW, tag in MAIN)
        if tag in BLOCK or before != opened.state():
            fresh(heading=tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    fresh()
    found = []
    for b in out:
        s = " ".join("".join(b.parts).split())
        if s:
            found.append((s, b.linked / max(1, len(s.replace(" ", ""))), b.boiler, b.main, b.heading))
    return found


def first_pass(text: str, link_density: float, stops: frozenset[str], main: bool = False, heading: bool = False) -> str:
    """good, bad, near or short; ``main``: in an article that is a prior."""
    if link_density > (ARTICLE_LINKS if main else LINKS):
        return "bad"
    if len(text) < SHORT:
        if link_density > 0 and not main:
            return "bad"
        return "near" if heading else "short"
    words = WORD.findall(text.lower())
    share = sum(w in stops for w in words) / max(1, len(words))
    if share >= MANY_STOPS:
        return "good" if len(text) > LONG else "near"
    return "near" if share >= FEW_STOPS or main else "bad"


def second_pass(labels: list[str], edge: str = "bad") -> list[str]:
    """good or bad: undecided blocks take the labels of their nearest decided neighbours, ``edge`` beyond the ends."""
    n = len(labels)
    before, last = [edge] * n, edge
    for i in range(n):
        before[i] = last
        if labels[i] in ("good", "bad"):
            last = labels[i]
    out, last = [""] * n, edge
    for i in range(n - 1, -1, -1):
        if labels[i] in ("good", "bad"):
            out[i] = last = labels[i]
        elif before[i] == last:
            out[i] = last
        else:
            out[i] = "good" if labels[i] == "near" else "bad"
    return out


def labelled(found: list[tuple[str, float, bool, bool, bool]], stops: frozenset[str]) -> list[str]:
    """good or bad for each block of a page."""
    first = lambda x, main: "bad" if x[2] else first_pass(x[0], x[1], stops, main, x[4])
    labels = [first(x, x[3]) for x in found]
    inside = sum(len(x[0]) for x, label in zip(found, labels) if x[3] and label != "bad")
    outside = sum(len(x[0]) for x, label in zip(found, labels) if not x[3] and label == "good")
    if not inside or inside < outside:
        return second_pass([first(x, False) if x[3] else label for x, label in zip(found, labels)])
    labels = [label if x[3] or label == "bad" else "short" for x, label in zip(found, labels)]
    at = 0
    while at < len(found):  # the runs of blocks in articles come first
        run = at
        while run < len(found) and found[run][3]:
            run += 1
        own = [i for i in range(at, run) if not found[i][2]]
        for i, label in zip(own, second_pass([labels[i] for i in own], "good")):
            labels[i] = label
        at = run + 1
    return second_pass(labels)


class Stops:
    """Stop words by language."""

    def __init__(self, by_language: dict[str, frozenset[str]]):
        self.by_language = by_language

    def of(self, page: str, texts) -> frozenset[str]:
        """Those of the language that the page declares, or else whose stop words are most of its words."""
        named = language(page)
        if named in self.by_language and named:
            return self.by_language[named]
        if len(self.by_language) < 2:
            return next(iter(self.by_language.values()), frozenset())
        words = Counter(w for t in texts for w in WORD.findall(t.lower()))
        return max(sorted(self.by_language.items()), key=lambda kv: sum(words[w] for w in kv[1] if w in words))[1]


def language(page: str) -> str:
    """The two letters of the language that the page declares, or nothing."""
    m = LANGUAGE.search(page)
    return m[1].lower() if m else ""


def main_text(page: str | None, stops: Stops | frozenset[str]) -> str:
    """The kept blocks of a page, joined by two newlines."""
    found = blocks(page or "")
    if isinstance(stops, Stops):
        stops = stops.of(page or "", (x[0] for x in found if not x[2]))
    return "\n\n".join(x[0] for x, label in zip(found, labelled(found, stops)) if label == "good")


def stop_words(pages: DataFrame, share: float = SHARE) -> Stops:
    """For each declared language (and "" for none) the words that make up ``share`` of its words, or more.

    Counted over all blocks of all pages that markup does not settle. A language has
    1 / share such words at most and two letters, so the driver's lists are bounded.
    """

    def count(batches):
        n: Counter = Counter()
        for b in slices(batches, 64):
            for page in b.column("html").to_pylist():
                lang = language(page)
                for x in blocks(page):
                    if not x[2]:
                        for w, k in Counter(WORD.findall(x[0].lower())).items():
                            n[lang, w] += k
            if len(n) > 150_000:
                yield batch_of(n)
                n = Counter()
        yield batch_of(n)

    def batch_of(n):
        langs, words = zip(*n) if n else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    rows = pages.select(F.col("html").cast("string")).filter("html IS NOT NULL").mapInArrow(count, "lang string, word string, n long")
    counts = saved(rows.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    by: dict[str, set[str]] = {}
    for r in counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= share * F.col("total")).select("lang", "word").collect():  # totals: two letters at most
        by.setdefault(r["lang"], set()).add(r["word"])
    return Stops({k: frozenset(v) for k, v in by.items()})


def extract(pages: DataFrame, stops: Stops | frozenset[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; other columns are left out."""
    stops = stop_words(pages) if stops is None else stops

    def run(batches):
        for b in slices(batches, 64):
            texts = [main_text(x, stops) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
