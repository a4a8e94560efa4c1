"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is read as a sequence of words and tags.  A word scores between 0 and 1, the more the likelier its place (block and
class words around it) is to lie inside an article; a tag costs up to ten words, the more the likelier it (with its class
words) stands outside of articles.  A linear scan finds the contiguous region with the largest sum, and elements that are
no article text are left out of it.  An article
element is evidence only: text outside it counts an eighth, and its bounds cost the region, so an article element that is
a teaser loses to a longer main text in plain elements.

The weights come from pages that label themselves: those with one article or main element.  Spark counts their words and
tags inside and outside it by place; a weight is the share inside or outside.  Known class words (``HINTS``) serve as labels
there, of adverts within an article for example; pages are read without them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

# How HTML elements behave and what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("nav aside form button select option input label head menu dialog fieldset footer".split()) | RAW
ARTICLE = ("article", "main")
#: Words of class, id and role names that mark an element as no article text.
HINTS = frozenset(
    "ad ads adv adsbygoogle advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login search searchbox sidebar side rail menu nav navbar navigation breadcrumb "
    "breadcrumbs toc pagination pager footer masthead topbar toolbar share sharing social follow related recommended recommendations more-stories "
    "trending widget comment comments reply replies respond disqus discussion complementary contentinfo copyright legal disclaimer skip hidden".split()
)
#: A labelled place within articles of whose words a smaller share is their text is none of it.
OUTSIDE = 0.2
#: End tags that an opening tag implies: an open element of the set is closed first.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|([^<]+|<)", re.S)
NAMES = re.compile(r"""\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
CLASSES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def marks_boilerplate(name: str, attributes: str, hints: frozenset[str]) -> bool:
    """Whether an element is no article text by its name or by the words (``hints``) of its class, id or role."""
    if name in NEVER:
        return True
    for m in NAMES.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key in ("class", "id", "role") and name not in ("html", "body", *ARTICLE):
            parts = {x.lower() for x in PARTS.findall(value)}
            if hints & parts and not {"has", "with", "no", "without"} & parts:  # "has-sidebar" names what the element holds
                return True
        if key in ("class", "id", "role") and name == "article" and {"comment", "comments", "reply"} & {x.lower() for x in PARTS.findall(value)}:
            return True
    return False


def label_of(attributes: str) -> str:
    """The words of an element's class, id and role, sorted, after a dot; empty without any."""
    words = {x.lower() for m in CLASSES.finditer(attributes) for x in PARTS.findall(m[1])} if attributes else ()
    return "." + " ".join(sorted(words)) if words else ""


@dataclass
class Page:
    """A page's tokens: words by block, and the tags between, in page order."""

    kinds: list[str] = field(default_factory=list)  # "word <place><label>" or "tag <name><label>"
    size: list[int] = field(default_factory=list)  # words of a text, 1 for a tag
    texts: list[str | None] = field(default_factory=list)  # a text as it stands, decoded; None for a tag
    inside: list[bool] = field(default_factory=list)  # in an article or main element
    barred: list[bool] = field(default_factory=list)  # in an element that is no article text
    articles: int = 0  # outermost article or main elements that are not barred


def read_page(source: str | None, hints: frozenset[str] | None = None) -> Page:
    """Tokens of ``source``; unclosed, crossed and stray tags are taken as browsers do in the common cases."""
    page, source, hints = Page(), source or "", HINTS if hints is None else hints
    stack: list[tuple[str, bool, str, str]] = []  # open elements, whether each bars, its own label, and the nearest one from it outwards
    bars = arts = links = heads = at = 0

    def close(to: int) -> None:
        nonlocal bars, arts, links, heads
        while len(stack) > to:
            name, barring, _, _ = stack.pop()
            bars -= barring
            arts -= name in ARTICLE
            links -= name == "a"
            heads -= name == "header"

    def add(kind: str, size: int, text: str | None) -> None:
        page.kinds.append(kind)
        page.size.append(size)
        page.texts.append(text)
        page.inside.append(arts > 0)
        page.barred.append(bars > 0 or heads > 0 and not arts)

    n = len(source)
    while at < n:
        m = TOKEN.match(source, at)
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if m[7] is not None:
            text = html.unescape(m[7])
            place = "barred" if bars or heads and not arts else ("inside " if arts else "outside ") + ("link" if links else stack[-1][0] if stack and stack[-1][0] in BLOCK else "run")
            add(f"word {place}{stack[-1][3] if stack else ''}", len(text.split()), text)
        elif name and (m[1] or m[4]):
            label = ""
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    label = stack[k][2]
                    close(k)
                    break
            add(f"tag {name}{label}", 1, None)
        elif name:
            attributes = m[3] or m[6] or ""
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            if name in IMPLIED:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in IMPLIED[name]:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                        break
            barring = marks_boilerplate(name, attributes, hints)
            page.articles += name in ARTICLE and not arts and not bars and not barring
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(source, at) if not attributes.endswith("/") else None
                at = end.end() if end else at if attributes.endswith("/") else n
                add(f"tag {name}", 1, None)
                continue
            label = label_of(attributes)
            add(f"tag {name}{label}", 1, None)
            if name not in VOID and not attributes.endswith("/"):
                stack.append((name, barring, label, label or (stack[-1][3] if stack else "")))
                bars += barring
                arts += name in ARTICLE
                links += name == "a"
                heads += name == "header"
    return page


Weights = dict[str, float]


def count_kinds(pages: DataFrame) -> DataFrame:
    """``kind, inside, outside``: words and tags of self-labelled pages by place, inside and outside the article.

    Elements that never are article text are passed over; what stands in an element with known class words counts as
    outside; ``nested`` kinds have the words within articles alone, by whether they do.  Kind ``page`` has the number of
    these pages.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for source in b["html"]:
                p = read_page(source, frozenset())
                if p.articles == 1:
                    total[1]["page"] += 1
                    for kind, size, inside, barred, hinted in zip(p.kinds, p.size, p.inside, p.barred, read_page(source).barred):
                        if not barred:
                            kind = kind.replace("inside ", "").replace("outside ", "")
                            total[inside and not hinted][kind] += size
                            if inside and "." in kind and kind.startswith("word "):
                                total[not hinted]["nested " + kind] += size
        kinds = sorted(total[0].keys() | total[1].keys())
        yield pd.DataFrame({"kind": kinds, "inside": [total[1][k] for k in kinds], "outside": [total[0][k] for k in kinds]}).astype({"kind": str, "inside": "int64", "outside": "int64"})

    rows = pages.select(F.col("html").cast("string").alias("html")).mapInPandas(work, "kind string, inside long, outside long")
    return rows.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def fit(pages: DataFrame, sample: int = 2_000) -> Weights:
    """Weights from at most ``sample`` pages, those whose page_ids hash lowest.

    A word's weight is the share of its place's words that are inside an article.  A tag's is between -10.02 and -0.02, by
    the share of such tags outside.  An article's bound (``edge``) costs a sixteenth of the words of the mean article.  A
    label that the sample lacks gives way to the place (with any label) or tag (without one); where the sample shows
    nothing of that either, :func:`weight_of` has a default.
    """
    ids = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = count_kinds(pages.select("page_id", "html").join(F.broadcast(ids), "page_id")).collect()
    counts = {r["kind"]: (r["inside"], r["outside"]) for r in rows}
    out = {k: a / (a + b) for k, (a, b) in counts.items() if k.startswith("nested ") and a + b}
    counts = {k: v for k, v in counts.items() if not k.startswith("nested ")}
    if labelled := counts.pop("page", (0, 0))[0]:
        out["edge"] = -sum(a for kind, (a, _) in counts.items() if kind.startswith("word ")) / labelled / 16
    total: dict[str, list[int]] = {}
    for kind, (a, b) in counts.items():
        for k in {kind, kind.partition(".")[0] if kind.startswith("word ") else kind}:
            both = total.setdefault(k, [0, 0])
            both[0] += a
            both[1] += b
    for kind, (a, b) in total.items():
        out[kind] = (a + 1) / (a + b + 2) if kind.startswith("word ") else -0.02 - 10 * (b + 1) / (a + b + 2) * (b > 0)
    return out


def _known(weights: Weights, kind: str) -> float | None:
    """The weight of a kind, else of the kind without its label."""
    return weights[kind] if kind in weights else weights.get(kind.partition(".")[0])


def weight_of(weights: Weights, kind: str, labelled: bool, inside: bool, barred: bool) -> float:
    """A token's score for each of its words, or of the tag.

    On a page with article elements (``labelled``) words outside them count an eighth, those inside a half at least, and
    crossing an outermost one's bound costs the edge.  What is barred is left out of the region anyway: it costs little, and nothing inside an article.
    """
    if barred and inside:
        return 0.0
    if kind.startswith("tag "):
        if not (inside or barred) and kind[4:].partition(".")[0] in ARTICLE:
            return weights.get("edge", -25.0)
        cost = _known(weights, kind)
        return -0.1 if cost is None else cost
    if barred:
        return -0.05
    worth = _known(weights, kind.replace("inside ", "").replace("outside ", ""))
    if worth is None:
        worth = 0.0 if " link" in kind and not inside else 0.5
    return max(worth, 0.5) if inside else worth / 8 if labelled else worth


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous run with the largest sum (the first, then the longest of equal ones)."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best and start == begin and total > 0:
            best, begin, end = total, start, k + 1
    return begin, end


def scores_of(page: Page, weights: Weights) -> list[float]:
    """The score of each token of the page."""
    return [weight_of(weights, k, page.articles > 0, i, b) * n for k, n, i, b in zip(page.kinds, page.size, page.inside, page.barred)]


def text_of(page: Page, begin: int, end: int, weights: Weights | None = None) -> str:
    """The text of a region without elements that are no article text, by themselves or, within articles, by the ``weights`` of their labels."""
    parts: list[str] = []
    for kind, text, barred in zip(page.kinds[begin:end], page.texts[begin:end], page.barred[begin:end]):
        if text is None:
            if kind[4:].partition(".")[0] in BLOCK:
                parts.append(" ")
        elif not barred and not (weights and weights.get("nested " + kind.replace("inside ", "").replace("outside ", ""), 1.0) < OUTSIDE):
            parts.append(text)
    return " ".join("".join(parts).split())


def extract(source: str | None, weights: Weights) -> str:
    """The main text: blocks in page order joined by one space, white space inside a block as one space."""
    page = read_page(source, frozenset())
    return text_of(page, *best_region(scores_of(page, weights)), weights)


def main_texts(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html, ...)``; other columns are ignored.

    Null, empty and wordless pages have an empty text; repeated rows are all returned.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(x, weights) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(work, "page_id long, url string, text string, n_chars long")
