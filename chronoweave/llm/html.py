"""Main text of web pages by consensus paths of their host.

Pass one parses every page, scores its containers by their prose (text outside
links, weighed by sentence ends and paragraphs, less what is linked) and votes
for the generalised path of the best one: tag and class names from the root,
with digits and long numbers taken out.  Spark adds up the votes of each host.
Pass two parses the pages again and takes the elements at the winning path; a
page without such an element gives its own best container.

Only votes are shuffled, and they are added up before that; pages never move
for them.  The winners are broadcast behind a check of their size and joined by
shuffle beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.urls import url_host
from chronoweave.session import cut_lineage

# Winners of this many bytes at most are sent to every task.
BROADCAST_BYTES = 16_000_000

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math select option object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tags that end an open element of these names.
CLOSES = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
# Tags and words of class, id or role that mark what is not the article, by how sure they are.
HARD_TAGS = frozenset("nav footer aside menu dialog button head search".split()) | RAW
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies".split())
NAME_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu menus modal "
    "nav navbar navigation newsletter notice notices pagination popup promo promotion sponsor sponsored subscribe contentinfo "
    "complementary".split()
)
LAYOUT_WORDS = frozenset("sidebar sidebars".split())
SOFT_WORDS = frozenset("alert banner banners related reply respond share sharing skip social toolbar widget widgets".split())
HEADER_TOKENS = frozenset("header site-header page-header main-header top-header".split())
# Words that make such a name say something about the page, and tags never judged by name.
NOT_FURNITURE = frozenset("has no with without open".split())
CONTENT_TAGS = frozenset("html body article main".split())
# Marks of an element, from none to certain furniture.
PLAIN, SOFT, LAYOUT, NAMED, COMMENTS, HARD = range(6)
# A wrapper judged by its volume holds at least so many characters of prose; less than SHORT without a sentence is a label.
LEAST_PROSE, SHORT = 200, 40

_OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_NUMBERS = re.compile(r"[0-9>]+")
_SENTENCE = re.compile(r"[.!?。！？](?:\s|$)")
_ENDS_LIST = frozenset("ul ol dl table".split()) | (CONTAINER - {"tr", "td"})


class _Element:
    """A node of the page; what its ancestors say about it is carried down, so nothing climbs."""

    __slots__ = ("tag", "name", "parent", "mark", "number", "depth", "container", "in_link", "link_below", "heading_below", "in_article", "furniture")

    def __init__(self, tag: str, name: str, parent: _Element | None, mark: int, number: int):
        self.tag, self.name, self.parent, self.mark, self.number = tag, name, parent, mark, number
        self.depth = parent.depth + 1 if parent else 0
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.furniture = False
        if tag in CONTAINER or parent is None:
            # the nearest container, and what lies between it and this element
            self.container, self.link_below, self.heading_below = self, False, False
        else:
            self.container = parent.container
            self.link_below = parent.link_below or tag == "a"
            self.heading_below = parent.heading_below or tag in HEADING

    def path(self) -> str:
        names, at = [], self
        while at is not None:
            names.append(at.name)
            at = at.parent
        return ">".join(reversed(names))


def _mark_of(token: str) -> int:
    words = set(_WORD.findall(token))
    if token in HEADER_TOKENS:
        return NAMED
    if words & NOT_FURNITURE:
        return PLAIN
    for mark, names in ((COMMENTS, COMMENT_WORDS), (NAMED, NAME_WORDS), (LAYOUT, LAYOUT_WORDS), (SOFT, SOFT_WORDS)):
        if words & names:
            return mark
    return PLAIN


@lru_cache(maxsize=4096)
def _names(tag: str, attributes: str) -> tuple[str, int]:
    """(generalised name of an element, mark by its attributes)."""
    if not attributes.strip(" /"):
        return tag, PLAIN
    classes, mark = "", PLAIN
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "class":
            classes = ".".join(sorted({_NUMBERS.sub("", x) for x in value.split()} - {""}))
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            mark = HARD
        elif tag not in CONTENT_TAGS and name in ("class", "id", "role"):
            mark = max([mark, *map(_mark_of, value.split())])
    return (f"{tag}.{classes}" if classes else tag), mark


class _Stack:
    """Open elements, with the places of each tag, so no look-up walks over them."""

    def __init__(self, root: _Element):
        self.open = [root]
        self.of_tag: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.blocks: list[int] = []
        self.list_ends: list[int] = []

    def _kinds(self, tag: str) -> list[list[int]]:
        kinds = [self.of_tag.setdefault(tag, [])]
        for names, places in ((CONTAINER, self.containers), (BLOCK, self.blocks), (_ENDS_LIST, self.list_ends)):
            if tag in names:
                kinds.append(places)
        return kinds

    def push(self, element: _Element) -> None:
        for places in self._kinds(element.tag):
            places.append(len(self.open))
        self.open.append(element)

    def cut(self, at: int) -> None:
        """Ends the elements from place `at` on."""
        while len(self.open) > at:
            for places in self._kinds(self.open.pop().tag):
                places.pop()

    def last(self, tag: str) -> int:
        places = self.of_tag.get(tag)
        return places[-1] if places else 0

    def close_implied(self, tag: str) -> None:
        """Ends the open elements that a start tag ends."""
        if tag in BLOCK and self.blocks and self.open[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])  # a block ends an open paragraph, with the inline elements inside it
        ended = max((self.last(t) for t in CLOSES.get(tag, ())), default=0)
        if ended > (self.list_ends[-1] if self.list_ends else 0):
            self.cut(ended)


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order: kinds text, start, end; one pass.

    A tag whose quotes run to the end of the page ends at its first >, and so do
    all tags after it; without any > the rest is text.
    """
    at = start = 0
    quotes = cdata = True
    raw = None
    while True:
        if raw is not None:  # the content of a raw element, up to its end tag
            end = re.compile(rf"</{raw}\b", re.I).search(html, at)
            at = start = end.start() if end else len(html)
            raw = None
        found = _OPENING.search(html, at)
        if found is None:
            break
        opened, head = found.start(), found.group()
        if head == "<!--":
            end = html.find("-->", found.end())
            after, token = (end + 3 if end >= 0 else len(html)), None
        elif head == "<![CDATA[" and cdata and (end := html.find("]]>", found.end())) >= 0:
            after, token = end + 3, ("text", html[found.end() : end], "")
        else:
            cdata = cdata and head != "<![CDATA["
            is_tag = found.group(2) is not None
            rest = _TAG_REST.match(html, found.end()) if is_tag and quotes else None
            quotes = quotes and not (is_tag and rest is None)
            end = rest.end() - 1 if rest else html.find(">", found.end())
            if end < 0:
                break
            after = end + 1
            token = ("end" if found.group(1) else "start", found.group(2).lower(), html[found.end() : end]) if is_tag else None
        if opened > start:
            yield "text", html[start:opened], ""
        if token is not None:
            yield token
            if token[0] == "start" and token[1] in RAW and not token[2].endswith("/"):
                raw = re.escape(token[1])
        at = start = after
    if start < len(html):
        yield "text", html[start:], ""


def _parse(html: str) -> tuple[list[_Element], list[tuple[_Element, str | None]]]:
    """Elements, parents first, and (element, text) in page order; text None stands for a block border."""
    root = _Element("html", "html", None, PLAIN, 0)
    elements, parts, stack = [root], [], _Stack(root)
    for kind, tag, attributes in _tokens(html):
        here = stack.open[-1]
        if kind == "text":
            parts.append((here, tag))
        elif kind == "end":
            place = stack.last(tag)
            # an end tag inside a container does not close what is around the container
            crossed = tag not in BLOCK and stack.containers and stack.containers[-1] > place
            if place and not crossed:
                if tag in BLOCK:
                    parts.append((stack.open[place], None))
                stack.cut(place)
        elif tag == "html" or (tag in ("body", "head") and stack.last(tag)):
            pass
        elif tag in VOID:
            if tag in ("br", "hr"):
                parts.append((here, " " if tag == "br" else None))
        else:
            stack.close_implied(tag)
            parent = stack.open[-1]
            name, mark = _names(tag, attributes)
            if tag in HARD_TAGS or (tag == "header" and not parent.in_article):
                mark = HARD
            elif tag == "form":
                mark = max(mark, LAYOUT)
            if tag in BLOCK:
                parts.append((parent, None))
            element = _Element(tag, name, parent, mark, len(elements))
            elements.append(element)
            stack.push(element)
    _settle(elements, parts)
    return elements, parts


def _settle(elements: list[_Element], parts: list[tuple[_Element, str | None]]) -> None:
    """Decides which marked elements are furniture; everything inside one is furniture too.

    Hard marks and comments always are.  A wrapper named like furniture, or a
    form, is layout if it holds the page's `main`, or if no article stands
    outside furniture and at least half of the page's prose is inside it.  A
    soft name inside an article needs evidence: mostly links, or a short label.
    """
    n = len(elements)
    plain, linked, sentences = [0] * n, [0] * n, [0] * n
    for element, text in parts:
        length = len(text.strip()) if text else 0
        if length:
            (linked if element.in_link else plain)[element.number] += length
            sentences[element.number] += bool(_SENTENCE.search(text))
    main = [e.tag == "main" for e in elements]
    article = [e.tag == "article" for e in elements]
    heading = [e.tag in HEADING for e in elements]
    marked = [False] * n  # below or at a mark
    for e in elements:
        marked[e.number] = e.mark > PLAIN or (e.parent is not None and marked[e.parent.number])
    for e in reversed(elements[1:]):
        if e.mark < COMMENTS:
            up, k = e.parent.number, e.number
            for sums in (plain, linked, sentences):
                sums[up] += sums[k]
            main[up], article[up], heading[up] = main[up] or main[k], article[up] or article[k], heading[up] or heading[k]
    free = any(e.tag in ("article", "main") and not marked[e.number] and plain[e.number] for e in elements)
    for e in elements[1:]:
        k = e.number
        e.furniture = e.parent.furniture
        if e.furniture or e.mark == PLAIN:
            continue
        most = not free and plain[k] >= LEAST_PROSE and 2 * plain[k] >= plain[0]
        if e.mark >= COMMENTS:
            e.furniture = True
        elif e.mark == SOFT and e.parent.in_article:
            label = plain[k] < SHORT and not sentences[k] and not heading[k]
            e.furniture = linked[k] >= max(plain[k], 1) or label
        else:
            e.furniture = not (main[k] or (most and (article[k] or e.mark <= LAYOUT)))


def _score(parts: list[tuple[_Element, str | None]]) -> tuple[_Element, float] | None:
    """(the container with the most prose, its score); prose counts half for each container further up."""
    containers: dict[int, _Element] = {}
    prose: dict[int, float] = {}
    links: dict[int, float] = {}
    for element, text in parts:
        length = 0 if text is None or element.furniture else len(text.strip())
        if not length:
            continue
        weight = 0.0 if element.heading_below else length + 25.0 * len(_SENTENCE.findall(text))
        share, level = 1.0, element.container
        while level is not None and share > 0.05:
            k = level.number
            containers[k] = level
            if element.link_below:
                links[k] = links.get(k, 0.0) + length * share
            else:
                prose[k] = prose.get(k, 0.0) + weight * share
            share /= 2
            level = level.parent.container if level.parent is not None else None
    worth = {k: prose.get(k, 0.0) - links.get(k, 0.0) for k in containers}
    best = max(containers, key=lambda k: (worth[k], -containers[k].depth), default=None)
    return (containers[best], worth[best]) if best is not None and worth[best] > 0 else None


def _whole(elements: list[_Element], parts: list[tuple[_Element, str | None]], best: _Element) -> _Element:
    """The element that holds the whole article around its densest container.

    That is the nearest article or main; without one, the highest container whose
    text besides what is below it is there and not mostly links, with none that
    is mostly links in between.
    """
    chain = [best]
    while chain[-1].parent is not None:
        if chain[-1].tag in ("article", "main"):
            return chain[-1]
        chain.append(chain[-1].parent)
    level, in_link = [-1] * len(elements), [False] * len(elements)
    for i, e in enumerate(chain):
        level[e.number] = i
    for e in elements:
        if level[e.number] < 0:
            level[e.number] = level[e.parent.number]
            in_link[e.number] = e.tag == "a" or in_link[e.parent.number]
    added = [[0, 0] for _ in chain]
    for element, text in parts:
        if text is not None and not element.furniture:
            added[level[element.number]][in_link[element.number]] += len(text.strip())
    whole = best
    for element, (plain, links) in list(zip(chain, added, strict=True))[1:]:
        if links > plain:
            break
        if plain and element.tag in CONTAINER:
            whole = element
    return whole


def best_path(html: str | None) -> tuple[str, float] | None:
    """(generalised path, score) of a page's best container; None without prose."""
    if not html:
        return None
    elements, parts = _parse(html)
    best = _score(parts)
    return (_whole(elements, parts, best[0]).path(), best[1]) if best is not None else None


def _tops(elements: list[_Element], path: str) -> list[_Element | None]:
    """For each element the outermost element at `path` around it, itself included."""
    names = path.split(">")
    fits = [0] * len(elements)  # names of the path met from the root on; -1 once it left the path
    tops: list[_Element | None] = [None] * len(elements)
    for e in elements:
        k, up = e.number, e.parent.number if e.parent is not None else None
        tops[k] = tops[up] if up is not None else None
        before = fits[up] if up is not None else 0
        fits[k] = before + 1 if 0 <= before < len(names) and names[before] == e.name else -1
        if fits[k] == len(names):
            tops[k] = e
    return tops


def main_text(html: str | None, path: str | None) -> tuple[str, bool]:
    """(blocks of the elements at `path` joined by newlines, whether there were any).

    Without text at `path` the page's own best container is taken.
    """
    if not html:
        return "", False
    elements, parts = _parse(html)
    tops = _tops(elements, path) if path else []
    blocks = _blocks(parts, tops) if any(t is not None for t in tops) else []
    if blocks:
        return "\n".join(blocks), True
    best = _score(parts)
    if best is None:
        return "", False
    return "\n".join(_blocks(parts, _tops(elements, _whole(elements, parts, best[0]).path()))), False


def _blocks(parts: list[tuple[_Element, str | None]], tops: list[_Element | None]) -> list[str]:
    """The text below each top; one that is mostly links is a menu of the same form."""
    runs: dict[int, list[str | None]] = {}
    linked: dict[int, list[int]] = {}
    for element, text in parts:
        top = tops[element.number]
        if top is None:
            continue
        run = runs.setdefault(top.number, [])
        if text is None:
            run.append(None)
        elif not element.furniture:
            run.append(text)
            linked.setdefault(top.number, [0, 0])[element.in_link] += len(text.strip())
    prose = {k for k, (plain, links) in linked.items() if plain >= links}
    blocks: list[str] = []
    for key, run in runs.items():
        if key not in prose and prose:
            continue
        piece: list[str] = []
        for text in [*run, None]:
            if text is not None:
                piece.append(text)
            elif piece:
                block = " ".join(unescape("".join(piece)).split())
                if block:
                    blocks.append(block)
                piece = []
    return blocks


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            best = best_path(html)
            if best is not None:
                hosts.append(host)
                paths.append(best[0])
                scores.append(best[1])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(_host, _path): the path with most votes of each host; ties to the lesser path."""
    votes = pages.select(url_host(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "path")).getField("path")
    return counted.groupBy(F.col("host").alias("_host")).agg(best.alias("_path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html, paths = batch.column("_html").to_pylist(), batch.column("_path").to_pylist()
        done = [main_text(h, p) for h, p in zip(html, paths, strict=True)]
        kept = [c for c in batch.schema.names if c not in ("_html", "_path")]
        added = [pa.array([t for t, _ in done], pa.string()), pa.array([a for _, a in done], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, [*kept, "text", "agreed"])


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` of every page plus text, agreed (taken at the host's path) and n_chars.

    Null, empty and textless pages give an empty text.  Pages with a null url or
    one without a host form a group of their own.  Every row stays, repeated ones
    too; an empty table gives no rows.  Whole pages are read, in time and memory
    that grow with their length, whatever their nesting.  Of equal containers the
    one nearer to the root wins, of paths with equal votes the lesser.  Columns
    of `pages` that are not in `keep` are left out, so none can clash.
    """
    winners = cut_lineage(winning_paths(pages))
    size = winners.agg(F.sum(F.octet_length("_host") + F.octet_length("_path"))).first()[0] or 0
    winners = F.broadcast(winners) if size <= BROADCAST_BYTES else winners
    rows = pages.select(*keep, F.col("html").alias("_html"), url_host(F.col("url")).alias("_host"))
    joined = rows.join(winners, "_host", "left").drop("_host")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep).schema.fields]
    done = joined.mapInArrow(_extract, ", ".join([*fields, "text string", "agreed boolean"]))
    return done.withColumn("n_chars", F.length("text").cast("long"))
