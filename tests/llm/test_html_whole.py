from chronoweave.llm import html

LONG = "<div class=body>" + "<p>A long sentence of the body, word after word. Another one.</p>" * 30 + "</div>"
BODY = "\n".join(["A long sentence of the body, word after word. Another one."] * 30)


def own(page):
    return html.main_text(page, html.best_path(page)[0])[0]


def test_title_lead_and_small_sections_stay():
    inside = f"<h1>Title</h1><p>Lead text.</p>{LONG}<section><h2>More</h2><p>End.</p></section>"
    want = f"Title\nLead text.\n{BODY}\nMore\nEnd."
    menu = "<nav><a href=/>Home</a></nav>"
    for before, after in (("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<div id=page>", "</div>")):
        page = f"<body>{menu}{before}{inside}{after}<footer>Site</footer></body>"
        assert own(page) == want and html.main_text(page, None)[0] == want
    links = "<a href=/x>Some other page of the site</a> " * 9
    assert own(f"<body><div id=x>{links}<div id=page>{inside}</div></div></body>") == want


def test_host_path_without_text_falls_back():
    page = f"<body><div class=post><nav>Menu.</nav></div><div class=talk>{LONG}</div></body>"
    assert html.main_text(page, "html>body>div.post") == (BODY, False)
