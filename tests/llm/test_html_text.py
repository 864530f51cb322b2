"""Main text: hand-made pages, every page of the table against the document it shows, edges."""

import re

from tessera.llm import html_text
from tessera.llm.html_text import main_text

SF = "/root/testdata/sf0.01"
LONG = "A paragraph of the article with quite a lot of words in it, more than the surge needs."


def test_named_article_is_whole():
    html = ("<html><body><nav><ul><li><a href=/>Home</a></ul></nav><main><h1>Title</h1><p>Short.</p><p>" + LONG +
            "</p><aside>Side</aside><ul><li>one</li><li>two</li></ul><p>x</p><form><p>Name</p></form></main><footer>f</footer>")
    assert main_text(html).split("\n\n") == ["Title", "Short.", LONG, "one", "two", "x"]


def test_surge_and_dive_without_article():
    html = ("<div id=top-menu><a href=a>A</a></div><div><a href=b>B</a></div><div><a href=c>C</a></div><div><a>D</a></div>"
            "<h2>Head</h2><p>" + LONG + "</p><p>tail</p><p>" + LONG + "</p>" + "<div><a href=x>link</a></div>" * 5 +
            "<div class='comment-list'><p>" + LONG + "</p></div><div class=\"cookieNotice cookie\">" + LONG + "</div>")
    assert main_text(html).split("\n\n") == ["Head", LONG, "tail", LONG]


def test_markup_scripts_entities_and_white_space():
    html = ("<article><p>a <b>bold</b>&amp;&eacute;&#x41;&nbsp; b<br>c\n\td</p><script>var t='</p>';</script><!-- <p>no</p> -->"
            "<style>p{}</style><P CLASS=lead title='1 > 0'>e</P><section class=comments><p>reader</p></section>"
            "<div class=ad>buy</div></article>")
    assert main_text(html).split("\n\n") == ["a bold&éA b c d", "e"]


def test_unclosed_containers_hide_nothing():
    assert main_text("<nav><a href=x>m</a><p>" + LONG) == LONG
    assert main_text("<div class=ad><div>" + LONG + "</div>") == LONG
    assert len(main_text("<nav>" * 20_000 + LONG)) == len(LONG)


def test_edges(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 50_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain &amp; text"), (4, "u", "<p></p>"), (5, "u", long), (5, "u", long),
            (None, "u", "<a href='" * 30_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(frame).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["", "", "plain & text", ""]
    assert got[5].n_chars == 50_000 * len(LONG) + 2 * 49_999 and html_text.extract_text(frame).count() == 7
    assert html_text.extract_text(frame.limit(0)).collect() == []


def test_every_page_shows_its_document(spark):
    docs = {tuple(" ".join(x.split()) for x in r.text.split("\n") if x.strip())
            for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()}
    got = html_text.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == 250
    for r in got:
        blocks = tuple(r.text.split("\n\n"))
        assert blocks[1:] in docs and blocks[1].startswith(blocks[0]) and r.n_chars == len(r.text)
        assert not re.search(r"&(amp|quot);", r.text)


def _blocks(text):
    return tuple(text.split("\n\n"))


def test_spans_on_the_pages_without_their_article_tag(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    tagged = [_blocks(main_text(h)) for h in pages]
    bare = [_blocks(main_text(re.sub(r"</?article\b[^>]*>", "", h))) for h in pages]
    assert sum(a == b for a, b in zip(tagged, bare)) >= 0.99 * len(pages)
    assert all(set(b) <= set(a) for a, b in zip(tagged, bare))


def test_spans_run_on_pages_with_an_article():
    spans = html_text._spans
    seen = []
    html_text._spans = lambda *x: seen.append(spans(*x)) or seen[-1]
    try:
        assert main_text(f"<p>Lead</p><article><h1>T</h1><p>x</p><p>{LONG}</p></article><p>after</p>").split("\n\n") == ["T", "x", LONG]
    finally:
        html_text._spans = spans
    assert seen == [[(1, 5)]]


def test_article_bounds_and_extends_one_span_of_several():
    gap = "<div><a href=x>link</a></div>" * 5
    html = f"<p>w</p><article><p>s</p><p>{LONG}</p><p>t</p></article>{gap}" + f"<div><p>{LONG} other</p></div>" * 3
    assert main_text(html).split("\n\n") == ["s", LONG, "t"] + [LONG + " other"] * 3


def test_article_of_short_lines_beside_a_long_line():
    verse = [f"Line {i} of a poem." for i in range(20)]
    lines = "".join(f"<p>{x}</p>" for x in verse)
    assert main_text(lines + f"<p>{LONG}</p>").split("\n\n") == verse + [LONG]
    gap = "<div><a href=x>link</a></div>" * 5
    assert main_text(lines + gap + f"<p>{LONG}</p>").split("\n\n")[:20] == verse


def test_unseen_elements_that_are_not_closed_hide_nothing():
    rest = f"<article><p>{LONG}</p></article>"
    for start in ("<svg/>", "<iframe src='x' />", "<button>", "<select><option>", "<object data=x>", "<title>", "<textarea>", "<template>",
                  "<video-player src=x></video-player>", "<select-box>", "<titles>", "<script-loader></script-loader>"):
        assert main_text(f"<body>{start}{rest}<button>b</button>") == LONG, start
    for start in ("<script>", "<style>", "<script/>"):
        assert main_text(f"<article><p>{LONG}</p></article>{start} p {{}} <p>{LONG}") == LONG
    assert main_text(f"<article><p>a <svg><svg/><title>no</title><svg>no</svg></svg>b<textarea><p></textarea > c</p><p>{LONG}</p></article>") \
        == f"a b c\n\n{LONG}"


def test_unclosed_elements_are_linear():
    import time
    for start in ("<title>", "<textarea>", "<svg>", "<button>", "<form>", "<div class=ad>"):
        at = time.perf_counter()
        assert main_text(start * 60_000 + LONG) == LONG
        assert time.perf_counter() - at < 5


def test_containers_of_the_article_are_not_hidden():
    page = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"
    for wrap in ("<div class='site has-sidebar'>{}</div>", "<div class=layout-sidebar>{}</div>", "<div id=entry-no-comments>{}</div>", "<form action=x>{}</form>",
                 "<div role=dialog><div class='nav-open'>{}</div></div>"):
        for article in (page, f"<article>{page}</article>", f"<main>{page}<aside>side</aside></main>", f"<article class='has-comments'>{page}</article>",
                        f"<main><article class='post-comments'>{page}</article></main>"):
            html = wrap.format(article + "<div class=comments><p>reader</p></div>") + f"<footer>{LONG[:40]}</footer>"
            assert main_text(html).split("\n\n") == ["T", LONG, LONG], html
    assert main_text(f"<article><div class=has-sidebar>{page}</div></article>").split("\n\n") == ["T", LONG, LONG]
    # what does not hold the article stays hidden, however long
    assert main_text(f"<article><p>{LONG}</p><p>{LONG}</p><section class='comments'>{page * 9}</section></article>") == f"{LONG}\n\n{LONG}"
    assert main_text(f"<div class=post><p>{LONG}</p></div><div id='comments' class='comments'>{page * 9}</div>") == LONG
    assert main_text(f"<div class='cookie-notice'>{page * 9}</div><p>{LONG}</p>") == LONG
    assert main_text(f"<p>{LONG}</p><div class='ad-box'>{page * 9}</div><div role=alert>{page * 9}</div><ul class=replies>{page * 9}</ul>") == LONG
    assert main_text(f"<div id=comments>{f'<article>{page}</article>' * 9}</div><article><p>{LONG}</p></article>") == LONG
    assert main_text(f"<div class='site ads'><main><p>{LONG}</p></main></div>") == LONG
    assert main_text(f"<div class='page comments-open'><p>{LONG}</p></div>") == LONG
    assert main_text(f"<article><p>{LONG}</p></article><div class=comments>{page * 3}</div>") == LONG
    assert main_text(f"<p>{LONG}</p><footer>{page * 3}</footer>") == LONG
    assert main_text(f"<article><p>{LONG}</p><aside>{page * 3}</aside></article>") == LONG
    comments = f"<ol class=comment-list><li><article class=comment-body>{page}</article></li></ol>" * 5
    assert main_text(f"<div class=layout-sidebar><article><p>{LONG}</p></article></div>{comments}") == LONG


class _Plain(__import__("html.parser").parser.HTMLParser):
    """Second implementation for well-formed pages: a tree walk with a stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.lines, self.text = [], [], []

    def close_line(self):
        text = " ".join("".join(t for t, _ in self.text).split())
        if text:
            self.lines.append((text, sum(len(t.strip()) for t, link in self.text if not link), any(t == "article" for t, _ in self.stack)))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.close_line()
        if tag == "br":
            self.text.append((" ", True))
        if tag not in html_text.VOID:
            words = set(re.findall("[a-z]+", " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()))
            bad = tag in ("nav", "footer", "aside", "form", "menu", "script", "style", "title", "noscript", "button", "select") or \
                (tag == "header" and not any(t == "article" for t, _ in self.stack)) or \
                (tag not in ("html", "body", "main", "article") and bool(words & (html_text.CONTENT | html_text.LAYOUT)))
            self.stack.append((tag, bad))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.close_line()
        while self.stack and tag in [t for t, _ in self.stack]:
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if not any(bad for _, bad in self.stack):
            self.text.append((data, any(t == "a" for t, _ in self.stack)))


def plain_text(html):
    """The article's lines around every place where three lines sum to a surge."""
    page = _Plain()
    page.feed(html)
    page.close()
    page.close_line()
    size = [n for _, n, _ in page.lines]
    dense = [i for i in range(len(size)) if sum(size[i:i + 3]) >= html_text.SURGE_CHARS and size[i]]
    if not any(page.lines[i][2] for i in dense):
        return None
    inside = [i for i, line in enumerate(page.lines) if line[2]]
    return "\n\n".join(page.lines[i][0] for i in inside)


def test_pages_against_a_second_implementation(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    want = [plain_text(h) for h in pages]
    assert sum(w is not None for w in want) >= 0.9 * len(pages)
    for html, text in zip(pages, want):
        if text is not None:
            assert main_text(html) == text
