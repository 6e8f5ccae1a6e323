import time

import pytest

from chronoweave.llm import html

PROSE = "".join(f"<p>Sentence number {k} of the article, long enough to count. And one more.</p>" for k in range(12))
TEXT = "\n".join(f"Sentence number {k} of the article, long enough to count. And one more." for k in range(12))


def own(page):
    best = html.best_path(page)
    return html.main_text(page, best[0] if best else None)[0]


def test_page_wide_form_and_named_wrappers_are_layout():
    menu = "<nav><a href=/>Home</a></nav>"
    for before, after in (
        ('<form id="aspnetForm">', "</form>"), ('<div class="layout-sidebar-right">', "</div>"), ('<div class="menu-page">', "</div>"),
        ('<div class="widget-area">', "</div>"),
    ):
        page = f"<body>{before}{menu}<article><h1>Title</h1>{PROSE}</article><footer>Site</footer>{after}</body>"
        assert own(page) == f"Title\n{TEXT}"
    page = f'<body><form id="aspnetForm">{menu}<div class=x>{PROSE}</div><div class="sidebar"><p>Aside.</p></div></form></body>'
    assert own(page) == TEXT
    assert own(f"<body><form><main>{PROSE}</main></form><form>Your name.<input></form></body>") == TEXT


def test_soft_names_inside_an_article_need_evidence():
    for tag in ('section class="related-work"', 'p class="social-history"', 'div class="alert"'):
        extra = f"<{tag}>This belongs to the article. It is prose.</{tag.split()[0]}>"
        assert own(f"<body><article>{PROSE}{extra}</article></body>") == f"{TEXT}\nThis belongs to the article. It is prose."
    assert own(f'<body><article><div class="banner"><h1>Big title</h1></div>{PROSE}</article></body>') == f"Big title\n{TEXT}"
    for extra in ('<div class="share">Share this</div>', '<ul class="related"><li><a href=/x>Another page to read. Now.</a></ul>', '<div class="ad">Buy now. It is cheap.</div>'):
        assert own(f"<body><article>{PROSE}{extra}</article></body>") == TEXT


def test_furniture_stays_out():
    teasers = "".join(f"<article><p>Teaser {k}. Read on.</p></article>" for k in range(9))
    assert own(f'<body><div class=content>{PROSE}</div><div class="related">{teasers}</div></body>') == TEXT
    talk = "".join(f"<article class=comment-body><p>I agree with this, number {k}. {'Really so. ' * 9}</p></article>" for k in range(30))
    assert own(f'<body><article>{PROSE}</article><div id="comments">{talk}</div></body>') == TEXT
    assert own(f'<body><div class=post>{PROSE}</div><div id="comments">{talk}</div></body>') == TEXT
    assert own("<body><form>Your name. Your mail.</form></body>") == ""


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 300_000, "<div>" * 100_000 + "x. ", '<a ">" ' * 150_000, "<![CDATA[>" * 100_000, "<b>" * 100_000 + "<div></div>" * 50_000,
        "<a><div>" * 50_000 + "</a>" * 100_000, "<ul>" + "<b>" * 50_000 + "<li></li>" * 50_000, "<!--" * 200_000, "</x>" * 200_000,
        "<script>" * 100_000, "<p>" * 50_000 + "</i>" * 50_000 + "<td>" * 50_000,
    ],
    ids=range(11),
)
def test_a_megabyte_of_hostile_markup_takes_seconds(page):
    start = time.process_time()
    own(page)
    assert time.process_time() - start < 15


def test_text_of_unclosed_tags():
    assert html.main_text("<p>One. <a href=x", None)[0] == "One. <a href=x"
    assert html.main_text('<p>One. <a href="x>two</a> three. <b>Four.</b>', None)[0] == "One. two three. Four."
