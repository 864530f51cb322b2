"""Main-text extraction from HTML by line-block distribution.

The markup of a page is stripped into lines, one per block element; scripts,
styles and other unseen content vanish, and lines inside containers that are
not the article by their element, role, class or id (menus, page headers and
footers, sidebars, notices, adverts, forms, reader comments) do not count.
Names that say what the content is (comments, replies, notices, cookies,
adverts, sharing) hide it whatever its share, unless the page's ``main`` lies
in it. Names of layout (a sidebar, a header, a form) do not hide a container
that holds the page's article (more than half of the text in its ``article``
and ``main`` elements) or, without such elements, is named by role, class or id
only and holds more than half of all text.
Over the lines left, the text lengths (without link text) are summed in a
sliding window of ``WINDOW`` lines. A surge is the first line of a window sum
of at least ``SURGE_CHARS`` after sparse text, a dive the line after which the
window sums fall to zero; the text between a surge and its dive is kept, with
the headings that lead into it. Short lines before a surge, or a stretch
without one, are kept if they hold at least ``ARTICLE_SHARE`` of the text that
follows the surge, or of the page's largest stretch. If the page names its
article (``article`` or ``main``), a span with ``ARTICLE_SHARE`` of its text in
one is cut to it and extended to that article's first and last line, and if
all spans together have that share, spans outside go. A page without any surge
keeps the lines that are not link lists (those of its article, by the same
share).

Inside a kept line, character references are decoded and white space becomes
one space; lines are joined by a blank line. Nothing is capped.

Defined results: null or empty HTML gives an empty text; plain text is one
line; unclosed elements end where their parent's neighbour or the page ends,
and an unseen element or container that is self-closed or never closed hides
nothing (only scripts, styles and comments reach to the page's end); repeated
rows give repeated results. Work and memory are linear in one page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
SURGE_CHARS = 86
ARTICLE_SHARE = 0.5

# Element names and the words that name what is not the article.
UNSEEN = frozenset("noscript template svg textarea title iframe object select button canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog search".split())
NEVER_TEXT = OUTSIDE - {"form"} | {"header"}                 # elements that most of a page's text does not make its article
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
LAYOUT = frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar popup modal overlay "
    "signup login search widget pagination pager toolbar".split())
CONTENT = frozenset(
    "ad ads advert advertisement advertising adbox adsense promo promotion sponsor sponsored cookie cookies consent gdpr notice "
    "notices alert newsletter subscribe subscription share sharing social related recommended recommendations comment comments "
    "commentlist disqus reply replies respond".split())
CONTENT_ROLES = frozenset("alert alertdialog".split())
HEADER_WORDS = frozenset("header".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])[^<>]*>.*?(?:</\1(?=[\s/>])[^<>]*>|\Z)"
    r"|<(title|textarea)(?=[\s/>])(?:[^<>]*[^<>/])?>(?:[^<]++|<(?!/?(?:title|textarea)[\s/>]))*+</\2(?=[\s/>])[^<>]*>"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>",
    re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
STATE = re.compile(r"(?:(?<!\S)|(?<=[-_]))(?:has|no|with|without|hide|show)[-_]\S*"      # a word on what is there, no name
                   r"|\S+[-_](?:open|closed|enabled|disabled|allowed|free|off)(?!\S)", re.I)


def _outside(tag: str, attributes: str, in_article: bool) -> str:
    """What an element holds instead of the article: ``content`` if its name
    says so, ``layout`` if it may be a wrapper, or nothing."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return "layout"
    if tag in ("html", "body", "main") or not attributes:
        return ""
    found = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            if value.lower() in ROLES:
                found = "content" if value.lower() in CONTENT_ROLES else found or "layout"
            continue
        parts = {p.lower() for p in NAME_PART.findall(STATE.sub("", value))}
        if tag == "article":                                 # a comment or a teaser, but not a post with comments
            if parts & {"comment", "comments", "reply", "ad", "promo", "related"} and not parts & {"post", "entry", "story"}:
                return "content"
        elif parts & CONTENT:
            return "content"
        elif parts & LAYOUT or (not in_article and parts & HEADER_WORDS):
            found = found or "layout"
    return found


def _closed(tokens) -> dict[int, int]:
    """Numbers of the start tags with an end tag of their own, and of that."""
    opened: dict[str, list[int]] = {}
    closes = {}
    for k, m in enumerate(tokens):
        if m[4] and not m[5].endswith("/"):
            stack = opened.setdefault(m[4].lower(), [])
            if m[3] != "/":
                stack.append(k)
            elif stack:
                closes[stack.pop()] = k
    return closes


def _hidden(html: str, tokens, closes: dict[int, int]) -> set[int]:
    """Numbers of the start tags whose content is not the article: those named
    by content, and of those named by layout the ones that hold neither the
    article (most of the text inside article tags) nor, on a page without one,
    most text. Text under a content name counts nowhere."""
    mains = [k for k, m in enumerate(tokens) if k in closes and (m[4] or "").lower() == "main"]
    named, total, inside = [], [], []                        # characters outside links, and open articles, before each token
    n_named = n_total = articles = links = end = 0
    unseen, wrappers, hidden = -1, [], set()
    for k, m in enumerate(tokens):
        if k > unseen and not links and m.start() > end:
            n = len(html[end:m.start()].strip())
            n_total += n
            n_named += n if articles else 0
        end = m.end()
        named.append(n_named)
        total.append(n_total)
        inside.append(articles)
        tag = (m[4] or "").lower()
        if not tag or k <= unseen:
            continue
        if m[3] == "/":
            if tag in ("article", "main"):
                articles = max(0, articles - 1)
            elif tag == "a":
                links = max(0, links - 1)
            continue
        kind = _outside(tag, m[5], articles > 0) if k in closes and tag not in VOID and tag not in UNSEEN else ""
        if kind == "content" and not any(k < x < closes[k] for x in mains[:1]):
            hidden.add(k)
            unseen = closes[k]
        elif k in closes and tag in UNSEEN:
            unseen = closes[k]
        else:
            if kind:
                wrappers.append((k, tag))
            if tag in ("article", "main"):
                articles += 1
            elif tag == "a":
                links = 1
    if not links:
        n = len(html[end:].strip())
        n_total += n
        n_named += n if articles else 0
    for k, tag in wrappers:
        if tag in NEVER_TEXT and (inside[k] or not n_named):
            shown = False
        elif n_named:
            shown = 2 * (named[closes[k]] - named[k]) > n_named
        else:
            shown = 2 * (total[closes[k]] - total[k]) > n_total
        if not shown:
            hidden.add(k)
    return hidden


def page_lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters outside links, inside article, heading) of the lines
    that may belong to the article."""
    tokens = list(TOKEN.finditer(html))
    closes = _closed(tokens)
    hidden = _hidden(html, tokens, closes)
    lines: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    plain = links = articles = 0
    heading = False
    skip = -1                                                # number of the end tag of unseen or hidden content
    end = 0

    def close():
        nonlocal plain, heading
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                lines.append((line, plain, articles > 0, heading))
            text.clear()
        plain, heading = 0, False

    for k, m in enumerate(tokens):
        if k > skip and m.start() > end:
            piece = html[end:m.start()]
            text.append(piece)
            if not links:
                plain += len(piece.strip())
        end = m.end()
        if k <= skip:
            continue
        tag = (m[4] or "").lower()
        if not tag:
            if m[1] or m[2]:                                 # unseen content: a gap between words
                text.append(" ")
            continue
        if tag in BLOCKS:
            close()
        elif tag == "br":
            text.append(" ")
        if m[3] == "/":
            if tag in ("article", "main"):
                articles = max(0, articles - 1)
            elif tag == "a":
                links = max(0, links - 1)
            continue
        if tag in UNSEEN and k in closes:
            text.append(" ")
            skip = closes[k]
        elif k in hidden:
            close()
            skip = closes[k]
        elif tag in ("article", "main"):
            articles += 1
        elif tag == "a":
            links = 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            heading = True
    if end < len(html):
        piece = html[end:]
        text.append(piece)
        if not links:
            plain += len(piece.strip())
    close()
    return lines


def _spans(lines, lengths) -> list[tuple[int, int]]:
    """[surge, dive) of every dense stretch of a page's lines."""
    sums = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths))]
    stretches, i = [], 0                                     # [first line, surge or none, dive)
    while i < len(lines):
        if not lengths[i]:
            i += 1
            continue
        first, surge = i, None
        while i < len(lines) and sums[i]:                    # dive: WINDOW lines without text
            if surge is None and lengths[i] and sums[i] >= SURGE_CHARS:
                surge = i
            i += 1
        stretches.append((first, surge, i))
    if all(surge is None for _, surge, _ in stretches):
        return []
    most = max(sum(lengths[first:end]) for first, _, end in stretches)
    spans: list[tuple[int, int]] = []
    for first, surge, end in stretches:
        if surge is None:                                    # many short lines are an article too
            if sum(lengths[first:end]) < ARTICLE_SHARE * most:
                continue
            surge = first
        elif sum(lengths[first:surge]) >= ARTICLE_SHARE * sum(lengths[surge:end]):
            surge = first
        while surge and lines[surge - 1][3] and (not spans or surge > spans[-1][1]):
            surge -= 1
        spans.append((surge, end))
    return spans


def _regions(lines) -> list[tuple[int, int]]:
    """[first, end) of every run of lines inside an article."""
    starts = [i for i, line in enumerate(lines) if line[2] and not (i and lines[i - 1][2])]
    ends = [i + 1 for i, line in enumerate(lines) if line[2] and not (i + 1 < len(lines) and lines[i + 1][2])]
    return list(zip(starts, ends))


def main_text(html: str | None) -> str:
    """The article of one page."""
    lines = page_lines(html or "")
    lengths = [plain for _, plain, _, _ in lines]
    spans = _spans(lines, lengths)

    def in_article(some) -> bool:
        inside = [i for i in some if lines[i][2]]
        return bool(inside) and sum(lengths[i] for i in inside) >= ARTICLE_SHARE * sum(lengths[i] for i in some)

    dense = [i for a, b in spans for i in range(a, b)] or range(len(lines))
    bounded = in_article(dense)
    if not spans:
        keep = {i for i, n in enumerate(lengths) if (lines[i][2] if bounded else n)}
    else:
        keep, regions = set(), _regions(lines)
        for a, b in spans:
            if bounded or in_article(range(a, b)):           # cut to the articles it touches, extended to their ends
                for first, end in regions:
                    if first < b and end > a:
                        keep.update(range(first, end))
            else:
                keep.update(range(a, b))
    return "\n\n".join(lines[i][0] for i in sorted(keep))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType),
                           T.StructField(url_col, pages.schema[url_col].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                texts = [main_text(h) for h in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[f.name for f in schema])

    return pages.select(id_col, url_col, pages[html_col].cast("string")).mapInArrow(run, schema)
