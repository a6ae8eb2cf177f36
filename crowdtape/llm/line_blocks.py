"""Main text of pages by line-block distribution.

Markup is stripped into lines, one per block of text. Each line carries its text length, or zero where
its element cannot be article text (menus, headers, footers, sidebars, notices, adverts, forms,
comments; told by element, role or class). Lengths are summed over a sliding window of lines. Text begins
where the sums surge from zero or above the threshold, and ends where they dive back to zero; the span
with the most text is kept whole, short lines included, and so are the further spans of the same
container (the smallest that holds all of that span) and spans nearly as heavy. If the page marks its article
or main part, lines outside it count as zero; articles that hold neither half of the text nor a first-level
heading (teaser cards) mark nothing.

Character references are decoded, white space inside a block becomes one blank, blocks are joined by one
newline. Null and empty pages, and pages without such text, give an empty text. Unclosed and stray tags,
comments, CDATA and doctypes are tolerated. Repeated rows give repeated rows; other columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, query, read

WINDOW = 3
SURGE = 0.35  # of the largest window sum: a span must reach it somewhere

# --- fixed values: kinds of elements ---
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
DROPPED = frozenset("""aside button dialog footer form head header input label menu nav optgroup option select template textarea""".split())
BOXES = frozenset("body main article section div td center details fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|svg|iframe|object|canvas|title|math|audio|video|textarea|template"
CLOSED_BY_BLOCK = frozenset("p dt dd".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist
consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promos
promotion related replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split())

#: What stands in a tag after its name. An unclosed tag ends at the next "<", so a page full of them is still
#: read in linear time; quoted values may hold "<" up to these bounds.
_QUOTED_MOST, _QUOTED_TIMES = 4000, 4
_PLAIN_ATTRS = r"(?>\"[^\"<]*+\"|'[^'<]*+'|[^'\"<>])*+"
_ATTRS = rf"{_PLAIN_ATTRS}(?>(?:\"[^\"]{{0,{_QUOTED_MOST}}}+\"|'[^']{{0,{_QUOTED_MOST}}}+'){_PLAIN_ATTRS}){{0,{_QUOTED_TIMES}}}+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    rf"|<(?P<raw>{RAW})\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>{_ATTRS})>|<[!?][^<>]*+>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")


def _is_aside(name: str, attrs: str, in_article: bool) -> bool:
    if name in DROPPED:
        return not (name == "header" and in_article)
    if not attrs.strip():
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return True
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for token in value.split():
                if name == "article" and token not in ASIDE_WORDS:  # an article's own class names say less
                    continue
                words = _PARTS.findall(token)
                if words and (words[0] in ASIDE_WORDS or words[-1] in ASIDE_WORDS):
                    return True
    return False


def lines_of(page: str) -> tuple[list[str], list[bool], list[int], list[int], list[int], set[int]]:
    """Blocks of text in page order, whether each may be article text, the number of the article or
    main element around it (0: none) and of its box; the box around each box; and which of those elements are
    main or have a first-level heading."""
    texts: list[str] = []
    fine: list[bool] = []
    part: list[int] = []
    box: list[int] = []
    around = [0]
    sure: set[int] = set()
    stack: list[tuple[str, bool, int, int]] = []  # name, aside, container, box
    now: list[str] = []
    containers = 0

    def flush() -> None:
        if now:
            text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
            now.clear()
            if text:
                texts.append(text)
                fine.append(not (stack and stack[-1][1]))
                part.append(stack[-1][2] if stack else 0)
                box.append(stack[-1][3] if stack else 0)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            now.append(page[at:m.start()])
        at = m.end()
        if m["cdata"] is not None:
            now.append(html.escape(m["cdata"]))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in BLOCKS:
            flush()
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][1] != (k > 0 and stack[k - 1][1]) or stack[k][2] != (stack[k - 1][2] if k else 0):
                        flush()
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body", "td", "table") and name not in ("html", "body", "article", "main", "div", "section", "table", "tr"):
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCKS and name != "br":
            # an open paragraph ends where another block begins, with the inline elements in it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSED_BY_BLOCK and stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
            for k in range(len(stack) - 1, -1, -1):
                if name in SELF_CLOSING and stack[k][0] in SELF_CLOSING[name]:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        aside, inside, within = stack[-1][1:] if stack else (False, 0, 0)
        attrs = m["attrs"]
        if name in ("article", "main") and not aside and not inside:
            containers += 1
            inside = containers
        if inside and not aside and name in ("main", "h1"):
            sure.add(inside)
        was = aside
        aside = aside or _is_aside(name, attrs, bool(inside))
        if aside != was:
            flush()
        if not attrs.endswith("/"):
            if name in BOXES:
                around.append(within)
                within = len(around) - 1
            stack.append((name, aside, inside, within))
    if at < len(page):
        now.append(page[at:])
    flush()
    return texts, fine, part, box, around, sure


def _boxes(box: int, around: list[int]) -> list[int]:
    """A box and those around it, the outermost (0) last."""
    out = [box]
    while out[-1]:
        out.append(around[out[-1]])
    return out


def _box_of(lines: list[int], box: list[int], around: list[int]) -> set[int]:
    """The smallest box that holds all these lines, with the boxes in it."""
    inner = list(dict.fromkeys(box[i] for i in lines))
    common = _boxes(inner[0], around)
    for b in inner[1:]:
        own = set(_boxes(b, around))
        common = [x for x in common if x in own]
    held = {common[0]}
    for b in range(1, len(around)):  # a box comes after the one around it
        if around[b] in held:
            held.add(b)
    return held


def _covered(spans: list[tuple[int, int]], weight: list[int], least: float, n: int) -> list[bool]:
    """For each of n lines, whether a span of at least this weight holds it."""
    out = [False] * n
    for (a, b), w in zip(spans, weight):
        if w >= least:
            out[a:b] = [True] * (b - a)
    return out


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    texts, fine, part, box, around, sure = lines_of(page or "")
    if not texts:
        return ""
    ok, container = np.array(fine), np.array(part)
    length = np.array([len(t) for t in texts], np.int64) * ok
    inside = container > 0
    named = np.isin(container, list(sure)) & inside
    marked = bool((length * named).any()) or bool(inside.any() and 2 * (length * inside).sum() >= length.sum() > 0)
    if marked:
        # the page names its article: the container with the most text, and what else it names as such
        length = length * inside
    if not length.any():
        return ""
    # sums over windows that begin at each line
    padded = np.concatenate((length, np.zeros(window - 1, np.int64)))
    sums = np.convolve(padded, np.ones(window, np.int64), "valid")
    live = sums > 0
    begin = np.flatnonzero(live & ~np.append(False, live[:-1]))
    end = np.flatnonzero(live & ~np.append(live[1:], False)) + 1
    spans = [(a + int(np.flatnonzero(length[a:b])[0]) if length[a:b].any() else b, b) for a, b in zip(begin.tolist(), end.tolist())]
    weight = [int(length[a:b].sum()) for a, b in spans]
    most = max(weight)
    if marked:
        kept = [s for s, w in zip(spans, weight) if w > 0]
    else:
        a, b = spans[weight.index(most)]
        held = _box_of([i for i in range(a, b) if length[i]], box, around)
        length = length * np.array([near or box[i] in held for i, near in enumerate(_covered(spans, weight, surge * most, len(texts)))])
        kept = spans
    return "\n".join(texts[i] for a, b in kept for i in range(a, b) if length[i] > 0)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    arrow_rows(pages.sparkSession)
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op8_line_blocks")
def op8_line_blocks(spark, sf_dir):
    return extracted(read(spark, sf_dir, "pages"))
