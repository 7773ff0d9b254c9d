"""Main text of HTML pages by tag-path ratios.

A page is cut into text blocks, each below a path of block elements from the root. Text length and
punctuation are summed per path and divided by the path's blocks; both ratios are smoothed in page
order and multiplied. The paths over a threshold, a share of the scores' deviation, show where the
content lies: the closest article or main element around the best path, else the best path's
parent. Every path inside it is content, headings and short paragraphs too, unless one of its
elements is page furniture by tag or role, or hidden. A form, a listed word in a class or id, and an
article inside another one are hints. Plain hints are forms, nested articles, and names of listed words
with or without words for boxes (``ad``, ``ad-slot``, ``comment-thread``, but not ``no-banner``). Where
there is prose outside of all plain hints, such an element is furniture however long its own text is,
unless it holds an article or main and its name is not one for reader comments. Without such prose, and
for all other hints, an element is furniture if it holds no article or main, and neither one of its
paths nor all of them together reach the threshold; where an article or main has text of its own, a
plain hint outside of it is furniture, and one inside has to reach the best path without hints.

Defined results: null and empty pages, and pages without content, give the empty text; broken
markup ends where the page ends; nothing is cut off or dropped for its length. A page is one row's
work, and memory is in proportion to it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trendspark.llm.common import as_bytes, batches_by_size

# Element names and words of classes.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p",
    "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
FURNITURE = {
    "nav", "aside", "footer", "menu", "dialog", "select", "button", "head", "search", "svg", "canvas",
    "object", "audio", "video", "datalist", "fieldset",
}
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu",
    "menubar", "toolbar",
}
CLASS_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie",
    "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing",
    "social", "related", "recommended", "comment", "comments", "disqus", "pagination", "pager", "widget", "login",
}
TALK_WORDS = {
    "comment", "comments", "disqus", "reply", "replies", "response", "responses", "respond", "discussion", "discussions",
}
BOX_WORDS = {
    "area", "block", "body", "box", "card", "container", "content", "entry", "group", "holder", "inner", "item",
    "items", "list", "outer", "panel", "section", "slot", "space", "thread", "threads", "unit", "wrap", "wrapper", "zone",
}
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: An end tag that is implied never reaches beyond these.
HOLDS = {"ul", "ol", "dl", "table", "article", "main", "section", "body", "div", "blockquote", "select", "menu"}
CONTAINER = {"article", "main"}

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]*))?""")
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？、]")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}

#: Weights of the smoothing window and the threshold's share of the deviation.
WINDOW = (0.25, 0.5, 0.25)
SHARE = 0.5
#: Prose: characters and punctuation marks of paths outside of plain hints, and their least share of a hinted text.
PROSE, PROSE_MARKS, PROSE_SHARE = 150, 3, 0.02


#: What an element's tag and attributes say of it; ``TALK`` is a plain hint at reader comments.
PLAIN, WEAK, STRONG, TALK, FURNISHED = range(5)


def attributes_of(source: str) -> dict[str, str]:
    """Values by lower-case name, without quotes; of equal names the first counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), value.strip(value[:1]) if value[:1] in ("'", '"') else value)
    return found


def furniture(tag: str, attributes: dict[str, str]) -> int:
    """Menus, adverts and the like by tag, role, class or id."""
    roles = WORD.findall(attributes.get("role", "").lower())
    if tag in FURNITURE or tag in RAW or not ROLES.isdisjoint(roles):
        return FURNISHED
    if "hidden" in attributes or HIDDEN.search(attributes.get("style", "")):
        return FURNISHED
    listed = TALK_WORDS if tag == "article" else CLASS_WORDS | TALK_WORDS
    if tag in ("body", "html", "main"):
        return PLAIN
    if tag == "form" or "form" in roles:
        return STRONG
    found = PLAIN
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = WORD.findall(name)
        if not listed.isdisjoint(words):
            plain = (listed | BOX_WORDS).issuperset(words)
            found = max(found, WEAK if not plain else STRONG if TALK_WORDS.isdisjoint(words) else TALK)
    return found


class Paths:
    """Tag paths of one page: parent, furniture, hint, closest container and measures of each."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, str, int], int] = {}
        self.parent, self.bad, self.hint, self.holder = [-1], [False], [PLAIN], [-1]
        self.length, self.marks, self.blocks, self.within = [0], [0], [0], [False]

    def below(self, parent: int, tag: str, label: str, kind: int) -> int:
        if tag == "article" and kind == PLAIN and self.within[parent]:
            kind = TALK
        key = (parent, label, kind)
        if key not in self.ids:
            new = self.ids[key] = len(self.parent)
            self.parent.append(parent)
            # A page's banner is furniture, a header inside an article holds its title.
            banner = tag == "header" and self.holder[parent] < 0
            self.bad.append(kind == FURNISHED or banner or self.bad[parent])
            self.hint.append(kind)
            self.within.append(self.within[parent] or tag == "article")
            self.holder.append(new if tag in CONTAINER else self.holder[parent])
            for counts in (self.length, self.marks, self.blocks):
                counts.append(0)
        return self.ids[key]

    def decide(self, threshold: float, total: int) -> None:
        """Hinted paths without a container and below their threshold become furniture."""
        many = len(self.parent)
        sums, best, holds = [(0, 0, 0)] * many, [0.0] * many, [False] * many
        hinted, contained = [False] * many, -1.0

        def score(n_chars: int, n_marks: int, n_blocks: int) -> float:
            return n_chars / n_blocks * (n_marks / n_blocks + 0.1) * math.sqrt(n_chars / total)

        marked = [False] * many
        self.prose = self.prose_marks = 0
        for p in range(many):  # parents come before what is below them
            marked[p] = self.hint[p] in (STRONG, TALK) or (p > 0 and marked[self.parent[p]])
            if self.blocks[p] and not self.bad[p] and not marked[p] and self.marks[p]:
                self.prose += self.length[p]
                self.prose_marks += self.marks[p]
            hinted[p] = self.hint[p] != PLAIN or (p > 0 and hinted[self.parent[p]])
            if self.blocks[p] and not self.bad[p]:
                sums[p] = self.length[p], self.marks[p], self.blocks[p]
                best[p] = score(*sums[p])
                if self.holder[p] >= 0 and not hinted[p]:
                    contained = max(contained, best[p])
        for p in range(many - 1, 0, -1):
            if self.bad[p] or not sums[p][2]:
                continue
            up = self.parent[p]
            if self.hint[p] != PLAIN:
                best[p] = max(best[p], score(*sums[p]))
            sums[up] = tuple(a + b for a, b in zip(sums[up], sums[p], strict=True))
            best[up] = max(best[up], best[p])
            holds[up] |= holds[p] or (self.holder[p] == p and self.hint[p] == PLAIN)
        for p in range(1, many):
            up = self.parent[p]
            least, plain = threshold, self.hint[p] in (STRONG, TALK)
            if plain and self.prose >= max(PROSE, PROSE_SHARE * sums[p][0]) and self.prose_marks >= PROSE_MARKS:
                self.bad[p] |= self.bad[up] or self.hint[p] == TALK or not holds[p]
                continue
            if plain and contained >= 0:
                least = max(threshold, contained) if self.holder[up] >= 0 else math.inf
            self.bad[p] |= self.bad[up] or (self.hint[p] != PLAIN and not holds[p] and best[p] < least)


def text_blocks(page: str, paths: Paths) -> list[tuple[int, str, bool]]:
    """Blocks of visible text with their path, in page order; true if only inline tags part it from the last."""
    blocks: list[tuple[int, str, bool]] = []
    stack: list[tuple[str, int]] = []
    piece: list[str] = []
    path = at = 0
    joined = False

    def flush(inline: bool = False) -> None:
        nonlocal joined
        raw = "".join(piece)
        raw = html.unescape(raw) if "&" in raw else raw
        text = " ".join(raw.split())
        if text:
            blocks.append((path, text, joined and not raw[0].isspace()))
            joined = True
        joined = joined and inline and not raw[-1:].isspace()
        piece.clear()

    while match := TOKEN.search(page, at):
        if match.start() > at:
            piece.append(page[at:match.start()])
        at = match.end()
        if match[2] is None:
            if match[0].startswith("<![CDATA["):
                piece.append(html.escape(match[0][9:-3]))
            continue
        tag, end = match[2].lower(), bool(match[1])
        if not end and tag in RAW:
            close = RAW_END[tag].search(page, at)
            at = close.start() if close else len(page)
            continue
        if tag in RAW:
            continue
        block = tag in BLOCK
        if block or tag in ("br", "hr"):
            flush()
        if tag in VOID:
            continue
        if end:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag), None)
            if depth is not None:
                flush(not block)
                del stack[depth:]
                path = stack[-1][1] if stack else 0
            continue
        attributes = attributes_of(match[3]) if match[3] else {}
        kind = furniture(tag, attributes)
        if not block and kind == PLAIN:
            continue
        flush(not block)
        if tag in CLOSES or (block and tag not in ("html", "body")):
            closing = CLOSES.get(tag, {"p"})
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in closing:
                    del stack[depth:]
                    if tag not in ("tr", "td", "th", "dt", "dd"):
                        break
                elif stack[depth][0] in HOLDS:
                    break
            path = stack[-1][1] if stack else 0
        label = f"{tag} {attributes['class'].lower()}" if "class" in attributes else tag
        if kind in (WEAK, STRONG, TALK):
            label += f"#{attributes.get('id', '').lower()}"
        path = paths.below(path, tag, label, kind)
        stack.append((tag, path))
    piece.append(page[at:])
    flush()
    return blocks


def scores(order: list[int], paths: Paths) -> list[float]:
    """Smoothed length ratio times smoothed punctuation ratio, for paths in page order."""
    ratios = [
        ([paths.length[p] / paths.blocks[p] for p in order]),
        ([paths.marks[p] / paths.blocks[p] for p in order]),
    ]
    smooth = []
    for values in ratios:
        padded = [values[0], *values, values[-1]]
        smooth.append([sum(w * padded[i + k] for k, w in enumerate(WINDOW)) for i in range(len(values))])
    # The share of all text keeps a long menu item below an article of short lines.
    total = sum(paths.length[p] for p in order)
    return [
        a * (b + 0.1) * math.sqrt(paths.length[p] / total)
        for a, b, p in zip(*smooth, order, strict=True)
    ]


def threshold_of(score: list[float]) -> float:
    mean = sum(score) / len(score)
    return SHARE * math.sqrt(sum((s - mean) ** 2 for s in score) / len(score))


def main_text(page: str) -> str:
    """Blocks of the content, joined by one space."""
    if not page:
        return ""
    paths = Paths()
    blocks = text_blocks(page, paths)
    for path, text, _ in blocks:
        paths.length[path] += len(text)
        paths.marks[path] += len(PUNCTUATION.findall(text))
        paths.blocks[path] += 1
    order = list(dict.fromkeys(path for path, _, _ in blocks if not paths.bad[path]))
    if not order:
        return ""
    score = scores(order, paths)
    if any(paths.hint):
        paths.decide(threshold_of(score), sum(paths.length[p] for p in order))
        # If hints alone would empty the page, none counts.
        order = [p for p in order if not paths.bad[p]] or order
        score = scores(order, paths)
    threshold = threshold_of(score)
    content = [p for p, s in zip(order, score, strict=True) if s >= threshold]
    best = max(zip(score, order, strict=True), key=lambda x: x[0])[1]
    holder = paths.holder[best] if paths.holder[best] >= 0 else max(paths.parent[best], 0)
    inside: dict[int, bool] = {holder: True, -1: False}

    def is_inside(path: int) -> bool:
        trail = []
        while path not in inside:
            trail.append(path)
            path = paths.parent[path]
        for p in trail:
            inside[p] = inside[path]
        return inside[path]

    # Content paths outside the holder count if they have a container of their own, such as a second article.
    chosen = {p for p in content if paths.holder[p] >= 0 or paths.holder[best] < 0}
    chosen |= {p for p in order if is_inside(p)}
    parts: list[str] = []
    last = False
    for path, text, joined in blocks:
        if path in chosen:
            parts += (text,) if (joined and last) or not parts else (" ", text)
        last = path in chosen
    return "".join(parts)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_size(batches, page, 1 << 23):
            texts = [main_text(value.decode()) for value in as_bytes(batch.column(page))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), batch.column(url), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=[key, url, "text", "n_chars"],
            )

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, page).mapInArrow(
        run, f"`{key}` {kind}, `{url}` string, text string, n_chars bigint"
    )
