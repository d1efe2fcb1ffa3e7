"""HTML extraction: the maximum-scoring run of words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED_PAGES = 2000  # pages the weights are learned from, at most
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
RAW_TEXT = {"script", "style", "template", "noscript", "iframe", "svg", "math", "textarea", "title", "select", "object"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BESIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "head"}
BESIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
                "cookie", "cookies", "consent", "disclaimer", "footer", "header", "login", "masthead", "menu", "nav", "navbar",
                "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "replies",
                "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar",
                "complementary", "contentinfo"}
# what readers add, and lists of other pages: beside the text whatever share of the page it has
ADDED_NAMES = {"comment", "comments", "replies", "newsletter", "related"}
QUALIFIERS = {"has", "no", "with", "without", "enabled", "disabled", "price"}  # "has-sidebar" is no sidebar
MAIN = {"article", "main"}
MARKED = r"""(?i)<(article|main)[\s/>]|\b(class|id|role)\s*=\s*("([^"]*\s)?main[\s"]|'([^']*\s)?main[\s']|main[\s>])"""
# where a left-out element other than a script ends if its end tag is missing
BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|html|main|nav|ol|p|"
                   r"pre|section|table|ul)(?=[\s/>])", re.I)


def _names(attributes: str) -> list[str]:
    out = []
    for m in NAMED.finditer(attributes):
        out += (m[2] or m[3] or m[4] or "").split()
    return out


def _named(tag: str, names: list[str], wanted: set[str]) -> bool:
    parts = [SPLIT.split(n.lower()) for n in names]
    return tag not in ("html", "body") and any(not QUALIFIERS.intersection(p) and not wanted.isdisjoint(p) for p in parts)


class _TagEnds:
    """Where tags end. A ``>`` in quotes ends no tag; where a quote stays open, the next ``>`` does.

    What an earlier search has found out about the rest of the page is kept, so all searches together
    take time in proportion to the page.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.open_from = {'"': len(page) + 1, "'": len(page) + 1}  # behind it no such quote closes
        self.dead = set()  # outside of quotes, no end follows these places

    def after(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; -1 without any."""
        if at > self.last:
            return -1
        page, start, seen = self.page, at, []
        while True:
            m = STOP.search(page, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            if m.start() >= self.open_from[m[0]]:
                break
            close = page.find(m[0], m.end())
            if close < 0:
                self.open_from[m[0]] = m.start()
                break
            at = close + 1
            if at in self.dead:
                break
            seen.append(at)
        self.dead.update(seen)
        return page.find(">", start)


class _Element:
    def __init__(self, key: str, parent: _Element | None, start: int, tag: str, names: list[str]):
        self.key, self.parent, self.start, self.end, self.tag = key, parent, start, -1, tag
        # the open paragraph that a new one closes, if only inline elements stand between
        self.paragraph = self if tag == "p" else parent.paragraph if parent and tag in INLINE else None
        self.hard = tag in BESIDE and tag != "form"  # beside the text whatever it holds
        self.named = not self.hard and (tag == "form" or _named(tag, names, BESIDE_NAMES))
        self.added = self.named and _named(tag, names, ADDED_NAMES)
        self.titled = False  # holds a heading of the first level
        self.main = (tag in MAIN or "main" in [x.lower() for x in names]) and not self.hard and not self.named
        self.under_hard = self.hard or bool(parent and parent.under_hard)
        self.under_named = self.named or bool(parent and parent.under_named)


def tokens(page: str) -> list[tuple[str, str, bool, str]]:
    """The page as tags and texts in order: (feature, text, beside, zone, parent).

    A tag has the text " " if it divides blocks and "" if it does not; ``beside``: it stands in a
    part that is no main text by its tag or name; ``zone``: inside the page's main element, outside of
    it, or on a page without one. Comments and the content of scripts and the like are left out.
    A name (or ``form``) sets a part beside only if that holds no main element and less than half of
    the words: else it wraps the text. A part named as readers' comments and the like is beside at any
    share, unless it holds a main element or the title. Main elements below such a name count where no other is.
    Time and memory are in proportion to the page, however malformed.
    """
    out, stack, elements, at, n = [], [], [], 0, len(page)
    ends, open_tags, unclosed = _TagEnds(page), Counter(), set()

    def put(feature: str, text: str, parent: str = "", left_out: bool = False) -> None:
        out.append((feature, text, stack[-1] if stack else None, parent, left_out))

    def pop(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            e.end = len(out)
            open_tags[e.tag] -= 1

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            put("#text", page[at:lt], stack[-1].key if stack else "")
        if lt >= n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = TAG_NAME.match(page, lt)
        end = ends.after(m.end()) if m else -1
        if end < 0:
            put("#text", "<", stack[-1].key if stack else "")
            at = lt + 1
            continue
        at, tag, attributes = end + 1, m[2].lower(), page[m.end():end]
        gap = "" if tag in INLINE else " "
        if m[1]:
            if not open_tags[tag]:
                put("/" + tag, gap)
                continue
            i = len(stack) - 1
            while stack[i].tag != tag:
                i -= 1
            put("/" + stack[i].key, gap)
            pop(i)
            continue
        names = _names(attributes)
        key = f"{tag}.{names[0].lower()}" if names else tag
        if tag in RAW_TEXT and not attributes.endswith("/"):
            closing = None if tag in unclosed else re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            close = -1 if not closing else page.find(">", closing.end())
            if close < 0:
                unclosed.add(tag)
            if close < 0 and tag not in ("script", "style"):
                block = BLOCK.search(page, at)
                at = block.start() if block else n
            else:
                at = n if close < 0 else close + 1
            put(key, gap, left_out=True)
            continue
        if tag == "p" and stack and stack[-1].paragraph:  # a paragraph ends where another one begins
            while stack[-1] is not stack[-1].paragraph:
                pop(len(stack) - 1)
            pop(len(stack) - 1)
        if tag == "h1":
            for e in reversed(stack):
                if e.titled:
                    break
                e.titled = True
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(_Element(key, stack[-1] if stack else None, len(out), tag, names))
            elements.append(stack[-1])
            open_tags[tag] += 1
        put(key, gap)
    pop(0)
    words = np.concatenate([[0], np.cumsum([len(t[1].split()) if t[0] == "#text" and not (t[2] and t[2].under_hard) else 0
                                            for t in out], dtype=np.int64)])
    found = [e for e in elements if e.main and not e.under_hard]
    clear = [e for e in found if not e.under_named]
    mains = set(clear or found)
    holds = set()
    for e in mains:
        up = e.parent
        while up and up not in holds:
            holds.add(up)
            up = up.parent
    for e in elements:  # parents come first
        wraps = e in holds or 2 * (words[e.end] - words[e.start]) >= words[-1] > 0 and (e.titled or not e.added)
        e.inside = e in mains or bool(e.parent and e.parent.inside)
        e.beside = e.hard or bool(e.parent and e.parent.beside) or e.named and not wraps
        if e in mains:
            e.beside = False
    rest = "out" if mains else "none"
    return [(feature, text, left_out or bool(e and e.beside), "in" if e and e.inside else rest, parent)
            for feature, text, e, parent, left_out in out]


def _feature(kind: str, beside: bool, zone: str, parent: str) -> str:
    if kind == "#text":
        return f"{zone} words beside" if beside else f"{zone} words {parent.split('.')[0]}"
    return f"{zone} <{kind}{' beside' if beside else ''}"


def _general(feature: str) -> str:
    """The feature without its element: what stands in for one not seen on a labelled page."""
    zone, kind = feature.split(" ")[:2]
    return f"{zone} words" if kind == "words" else f"{zone} <{' beside' if feature.endswith(' beside') else ''}"


def labelled_counts(page: str) -> Counter:
    """(feature, in main text?) counts of a page that marks its main text with an element.

    Each part counts with its zone, and once more as on a page whose main element is hidden: that
    is what pages without one are scored with.
    """
    out = Counter()
    parts = tokens(page)
    if any(t[3] == "in" for t in parts):
        for kind, text, beside, zone, parent in parts:
            if zone == "in" and beside:
                continue  # left out wherever the run ends, so it says nothing about that
            n = len(text.split()) if kind == "#text" else 1
            hidden = kind.lstrip("/").split(".")[0] in MAIN or kind.lower().endswith(".main")
            if hidden or parent.split(".")[0] in MAIN:  # stands on marked pages only
                kinds = [_feature(kind, beside, zone, parent)]
            else:
                kinds = [_feature(kind, beside, zone, parent), _feature(kind, beside, "none", parent)]
            for f in kinds:
                out[f, zone == "in"] += n
                out[_general(f), zone == "in"] += n
    return out


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Words score 0 to 1 and tags -8 to -0.01, by the log odds of standing in main text."""
    out = {}
    for f in {f for f, _ in counts}:
        odds = math.log((counts.get((f, True), 0) + 0.5) / (counts.get((f, False), 0) + 0.5))
        out[f] = min(1.0, max(0.0, odds)) if f.split(" ")[1] == "words" else max(-8.0, min(-0.01, odds))
    return out


# for features no labelled page has: words of unmarked pages and of main elements count, others hardly
UNSEEN = {"in words": 1.0, "none words": 1.0, "out words": 0.2, "in <": -0.01, "none <": -0.3, "out <": -2.0,
          "in < beside": -0.001, "none < beside": -0.01, "out < beside": -4.0}


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: the contiguous run of words and tags with the highest sum, without what in it
    stands beside the text, references decoded, blocks in order, one blank for any white space."""
    parts = tokens(page or "")
    if not parts:
        return ""
    scores = np.zeros(len(parts))
    for i, (kind, text, beside, zone, parent) in enumerate(parts):
        f = _feature(kind, beside, zone, parent)
        w = weights.get(f)
        if w is None:
            w = UNSEEN[_general(f)] if beside or zone != "out" else weights.get(_general(f), UNSEEN[_general(f)])
        if kind == "#text":
            w = 0.0 if beside else w * len(text.split())
        scores[i] = w
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lows = np.minimum.accumulate(sums)[:-1]
    end = int(np.argmax(sums[1:] - lows))
    if sums[end + 1] - lows[end] <= 0:
        return ""
    start = int(np.argmin(sums[:end + 1]))
    text = [" " if kind != "#text" and gap else "" if kind != "#text" or beside else entities.unescape(gap)
            for kind, gap, beside, _, _ in parts[start:end + 1]]
    return " ".join("".join(text).split())


def learn_weights(pages: DataFrame, bound: int = LABELLED_PAGES) -> dict[str, float]:
    """Tag and word weights from at most ``bound`` pages that mark their main text (article, main).

    Of these, the pages with the smallest hashes are taken; a few counts per tag name reach the driver.
    """
    pages = pages.where(F.col("html").rlike(MARKED))
    rank = F.xxhash64("page_id", "url")
    chosen = pages.select(rank.alias("h")).orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    if chosen is None:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(labelled_counts(page or ""))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                                          pa.array([total[k] for k in keys], pa.int64())], ["feature", "inside", "n"])

    rows = (pages.where(rank <= chosen).select("html").limit(bound).mapInArrow(count, "feature string, inside boolean, n long")
            .groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect())
    return weights_of({(r.feature, r.inside): r.n for r in rows})


def main_text(html: Column, weights: dict[str, float]) -> Column:
    """The main text of a page; the empty string for a null page or one without any."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(p, weights) for p in pages], dtype=object)
    return run(html)


def extract_pages(pages: DataFrame, bound: int = LABELLED_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Nulls: a null html has an empty text; null ids and urls are handed on. Repeated rows are
    extracted each; other columns are ignored; an empty table gives no rows.
    """
    weights = learn_weights(pages, bound)
    return (pages.select("page_id", "url", main_text(F.col("html"), weights).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
