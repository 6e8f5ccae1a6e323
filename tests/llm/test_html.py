from html import escape

from chronoweave.llm import html

PARAGRAPHS = ["First paragraph. It has two sentences.", "Second & third <tags>. More text here.", "The end of it all. Goodbye."]


def page(k, wrapper=("<div class='post-12'>", "</div>")):
    body = "".join(f"<p>{escape(x)}</p>" for x in [*PARAGRAPHS, f"Page number {k}. Indeed."])
    return f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li><li><a href="/a">News of the day. And more. And more.</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept.</div>
    {wrapper[0]}<h2>Head&nbsp;line {k}</h2>{body}<form>Your name. Your mail.<input></form><div class="ad box">Buy now. Cheap.</div>
    <script>if (a < b) x = "</p>";</script>{wrapper[1]}<aside>Side notes. Many.</aside>
    <section id="comments"><p>I agree. Nice post. Very long comment. {"Really so. " * 40}</p></section><footer>&copy; Site</footer></body></html>"""


def text(k):
    return "\n".join([f"Head line {k}", *PARAGRAPHS, f"Page number {k}. Indeed."])


def test_article_comes_out_of_each_form():
    for wrapper in (("<article>", "</article>"), ("<main>", "</main>"), ("<div id=a><div class=b>", "</div></div>"), ("<table><tr><td>", "</table>")):
        html_page = page(1, wrapper)
        assert html.main_text(html_page, html.best_path(html_page)[0])[0] == text(1)


def test_broken_markup():
    assert html.main_text("<body><article><p><b>One.<br>two <p>Three</b> four.<ul><li>x.<li>y.</ul>tail.", None)[0] == "One. two\nThree four.\nx.\ny.\ntail."
    assert html.main_text("<body><p>a < b and c > d. Yes.", None)[0] == "a < b and c > d. Yes."
    assert html.main_text("<p>open <!-- never closed. Nothing follows.", None)[0] == "open"
    for empty in (None, "", "   ", "<nav>Only. A menu.</nav>", "<script>x. y.", "<"):
        assert html.main_text(empty, "html>body")[0] in ("", "<")
    deep = "<div>" * 3000 + "Deep text. Here." + "</div>" * 3000
    assert html.main_text(deep, None)[0] == "Deep text. Here."
    assert html.main_text("<p>" + "word. " * 100000, None)[0] == ("word. " * 100000).strip()


def test_host_votes_decide(spark):
    rows = [(k, f"http://h.net/{k}", page(k)) for k in range(6)]
    # on its own this page would give its long comment section another path
    odd = page(6).replace('<section id="comments">', '<section class="talk">')
    rows += [(6, "http://H.net/6", odd), (7, "http://other.net/", odd), (8, None, page(8)), (9, "http://h.net/", None), (9, "http://h.net/", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract_main_text(pages).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for k in (*range(7), 8):
        assert by_id[k]["text"] == text(k) and by_id[k]["n_chars"] == len(text(k))
    assert by_id[6]["agreed"] and by_id[7]["text"] != text(6)
    assert by_id[9]["text"] == "" and by_id[9]["n_chars"] == 0
    html.BROADCAST_BYTES, kept = 0, html.BROADCAST_BYTES
    assert sorted(map(tuple, html.extract_main_text(pages).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    html.BROADCAST_BYTES = kept
    assert html.extract_main_text(pages.limit(0)).count() == 0
