"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element is a node that is content or not. A node's own evidence (tag, words of its class, id and role, length
of its text, share of its text in links) and a potential between parent and child make a tree-structured Markov random
field; messages go up from the leaves and down from the root, and the products are the exact marginals. Text whose block
is content with probability over one half is kept. Both kinds of potentials are counted on labelled pages, which this
module writes itself from layouts (``labelled_pages``), with known parts.

Inline elements are transparent: their text belongs to the block around them. Scripts, styles, heads and form controls
are no text; an unclosed one ends with the block around it, a raw one (script, style, textarea, title, iframe) with the
page. A page is read in one pass; unclosed and stray tags are borne as browsers bear them, roughly.

Defined cases: null and empty html give an empty text, as does a page without content; repeated rows agree; text outside
any block belongs to the page's root, which is judged by the amount of such text, its share of the page and its links.
"""

from __future__ import annotations

import html as html_
import math
import random
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
REST = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")
# Element kinds of HTML.
SILENT = frozenset("script style noscript template textarea select svg math iframe object head title button".split())
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset figure figcaption blockquote pre address details summary dialog center".split()
)
#: Silent elements whose text has no tags: they end at the next literal end tag, or with the page.
RAW = frozenset("script style textarea iframe title".split())
#: Start tags that end a drawing or formula, except within the parts of it that hold HTML.
BREAK_OUT = frozenset("body blockquote center dd div dl dt h1 h2 h3 h4 h5 h6 li ol p pre table ul".split())
HOLDS_HTML = frozenset("foreignobject desc annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    text: int = 0
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("#root", -1)])
    segments: list[tuple[int, str]] = field(default_factory=list)


class Tags:
    """The tags of a page from a place on; a page is read once, whatever is left open in it."""

    def __init__(self, source: str) -> None:
        self.source, self.last, self.open_quotes, self.unclosed = source, source.rfind(">"), 0, {}

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether an end tag, lower-case name or None for a comment or declaration, attributes) of the next."""
        source = self.source
        while m := OPENING.search(source, at):
            if source.startswith("<!--", m.start()):
                end = source.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(source), False, None, ""
            if m.end() > self.last + 1:
                return None
            if m[2] is None:
                return m.start(), source.find(">", m.start()) + 1, False, None, ""
            rest = REST.match(source, m.end()) if self.open_quotes < PATIENCE else None
            if rest:
                return m.start(), rest.end(), bool(m[1]), m[2].lower(), rest[1]
            # A quote that nothing closes: the tag ends at the next bracket.
            self.open_quotes += 1
            end = source.find(">", m.end() - 1)
            if end >= 0:
                return m.start(), end + 1, bool(m[1]), m[2].lower(), source[m.end() : end]
            at = m.end()
        return None


#: Scans to the end of a page for a closing quote, or for each end tag, that may fail before the rest does without.
PATIENCE = 32


def raw_end(source: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
    return end.end() if end else len(source)


def silent_end(tags: Tags, tag: str, at: int, around: set[str]) -> tuple[int, bool]:
    """Where a silent element ends that may hold others, and whether by its end tag; ``around``: the blocks it is in.

    An unclosed one ends with the block around it, a drawing or formula at a tag that breaks out of it.
    """
    depth, inner, html = 1, [], 0
    if tags.unclosed.get(tag, 0) >= PATIENCE:
        return at, False
    while found := tags.next(at):
        start, at, closing, name, attributes = found
        if name is None:
            continue
        if closing:
            depth -= name == tag
            if not depth:
                return at, True
            html -= name in HOLDS_HTML and html > 0
            if name in inner:
                del inner[len(inner) - 1 - inner[::-1].index(name) :]
            elif name in around:
                return start, False
        elif not empty(attributes):
            if name in RAW:
                at = raw_end(tags.source, name, at)
            elif name in BREAK_OUT and tag in ("svg", "math") and not html:
                return start, False
            elif name in BLOCKS and len(inner) < 512:
                inner.append(name)
            depth += name == tag
            html += name in HOLDS_HTML
    tags.unclosed[tag] = tags.unclosed.get(tag, 0) + 1
    return len(tags.source), False


def empty(attributes: str) -> bool:
    """Whether a start tag closes itself; a slash at the end of a bare value belongs to the value."""
    return attributes.endswith("/") and not re.search(r"=\s*[^\s\"'>]*/$", attributes)


def parse(source: str) -> Page:
    """Block elements in page order, and the text segments between their edges."""
    page, tags = Page(), Tags(source)
    nodes, stack, pieces = page.nodes, [0], []
    open_at: dict[str, list[int]] = {}  # places in the stack of each open block's tag
    at, links, size = 0, 0, len(source)

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(html_.unescape("".join(pieces)).split())
            if text:
                page.segments.append((stack[-1], text))
                nodes[stack[-1]].text += len(text)
            pieces.clear()
        links = 0

    def last(*names: str) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    def close(place: int) -> None:
        """End the block at a place of the stack and all inside it."""
        flush()
        while len(stack) > place:
            open_at[nodes[stack.pop()].tag].pop()

    while at < size:
        found = tags.next(at)
        chunk = source[at : found[0]] if found else source[at:]
        if chunk:
            pieces.append(chunk)
            if links:
                nodes[stack[-1]].linked += len(chunk.strip())
        if not found:
            break
        _, at, closing, tag, attributes = found
        if tag is None:
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                if place := last(tag):
                    close(place)
                else:
                    flush()
        elif tag in SILENT:
            if tag in RAW:
                at = raw_end(source, tag, at)
            elif tag not in ("svg", "math") or not empty(attributes):
                end, closed = silent_end(tags, tag, at, {t for t, places in open_at.items() if places})
                if closed or tag not in ("head", "button", "object", "noscript"):
                    at = end
        elif tag == "a":
            links += 1
        elif tag in ("br", "hr", "wbr", "img", "input"):
            pieces.append(" " if tag != "wbr" else "")
            if tag == "hr":
                flush()
        elif tag in BLOCKS:
            flush()
            if place := last("p"):
                close(place)
            if tag in CLOSES and (place := last(*CLOSES[tag].split())) > last("table", "ul", "ol", "dl"):
                close(place)
            words = tuple(dict.fromkeys(w for a in ATTRIBUTE.finditer(attributes) for w in WORDS.findall((a[2] or a[3] or a[4] or "").lower()))) if attributes else ()
            nodes.append(Node(tag, stack[-1], words))
            if not attributes.endswith("/") or tag not in ("p", "div"):
                open_at.setdefault(tag, []).append(len(stack))
                stack.append(len(nodes) - 1)
    flush()
    return page


def evidence(page: Page) -> list[list[str]]:
    """The features of each node."""
    nodes = page.nodes
    text, linked, paragraphs = [n.text for n in nodes], [min(n.linked, n.text) for n in nodes], [int(n.tag == "p") for n in nodes]
    titles = [int(n.tag == "h1") for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        text[p] += text[i]
        linked[p] += linked[i]
        paragraphs[p] += paragraphs[i]
        titles[p] += titles[i]
    out = []
    for i, n in enumerate(nodes):
        share = linked[i] / text[i] if text[i] else 0.0
        f = [f"tag={n.tag}", f"links={0 if share < 0.02 else 1 if share < 0.3 else 2 if share < 0.7 else 3}", f"size={min(6, int(math.log2(text[i] + 1) / 2))}"]
        if n.tag not in ("p", "li"):
            f.append(f"paragraphs={min(3, paragraphs[i])}")
            # Of the page's text, and whether its title is inside, beside or elsewhere.
            f.append(f"{n.tag} share={int(4.99 * text[i] / max(text[0], 1))}")
            f.append(f"title={'inside' if titles[i] else 'beside' if titles[n.parent] else 'elsewhere' if titles[0] else 'none'}")
        out.append(f + [f"word={w}" for w in n.words])
    # The root is judged by the text that is in no block.
    n, share = nodes[0], min(nodes[0].linked, nodes[0].text) / max(nodes[0].text, 1)
    out[0] = [f"root links={0 if share < 0.02 else 1 if share < 0.3 else 2 if share < 0.7 else 3}", f"root size={min(6, int(math.log2(n.text + 1) / 2))}", f"root share={int(3.99 * n.text / max(text[0], 1))}"]
    return out


@dataclass
class Model:
    odds: dict[str, float]
    child: tuple[tuple[float, float], tuple[float, float]]
    tempering: float = 0.65

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node, by messages up and down the tree."""
        nodes, n = page.nodes, len(page.nodes)
        (p00, p01), (p10, p11) = self.child
        own = []
        for f in evidence(page):
            z = max(-30.0, min(30.0, self.tempering * sum(self.odds.get(x, 0.0) for x in f)))
            q = 1 / (1 + math.exp(-z))
            own.append((1 - q, q))
        if not nodes[0].text:
            own[0] = (1.0, 0.0)  # nothing is outside of blocks
        up, message = [list(x) for x in own], [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b = up[i]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            total = m0 + m1
            message[i] = (m0 / total, m1 / total)
            p = up[nodes[i].parent]
            x, y = p[0] * message[i][0], p[1] * message[i][1]
            p[0], p[1] = x / (x + y), y / (x + y)
        belief = [tuple(up[0])] * n
        for i in range(1, n):
            b0, b1 = belief[nodes[i].parent]
            c0, c1 = b0 / max(message[i][0], 1e-300), b1 / max(message[i][1], 1e-300)
            a, b = up[i]
            x, y = a * (c0 * p00 + c1 * p10), b * (c0 * p01 + c1 * p11)
            belief[i] = (x / (x + y), y / (x + y))
        return [b[1] for b in belief]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        keep = self.marginals(page)
        return "\n\n".join(text for i, text in page.segments if keep[i] > 0.5)


# ------------------------------------------------------------- labelled pages

MARK = "labelledcontent"
CONTENT_NAMES = "article content post entry story main body text page single blog news".split()
PARTS = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc links",
    "header": "header masthead top banner logo branding site toolbar",
    "footer": "footer bottom copyright legal colophon credits imprint",
    "aside": "sidebar aside widget related recommended more popular trending teaser",
    "ad": "ad ads advert advertisement adslot sponsor sponsored promo promotion commercial",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe paywall disclaimer warning privacy",
    "form": "form search login signup contact",
    "comments": "comment comments discussion replies reply disqus respond reader",
    "share": "share social sharing tags meta byline author",
}


def labelled_pages(n: int = 1000, seed: int = 11) -> list[str]:
    """Pages of many layouts; content elements have the class ``MARK``."""
    r = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi))).capitalize() + "."

    def element(tag: str, inner: str, names: str = "", content: bool = False) -> str:
        names = f"{names} {MARK}" if content else names
        attribute = f" class='{names.strip()}'" if names.strip() and (content or r.random() < 0.9) else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def linked(k: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{i}'>{words(1, 3)}</a></{tag}>" for i in range(k))

    def part(kind: str) -> str:
        name = r.choice(PARTS[kind].split()) + r.choice(["", "", " box", " block", " inner", " wrap"])
        if kind == "nav":
            return element(r.choice(["nav", "nav", "div", "ul"]), element("ul", linked(r.randint(2, 9))), name)
        if kind == "header":
            return element(r.choice(["header", "header", "div"]), element(r.choice(["div", "h1", "p"]), words(1, 4)) + r.choice(["", element("p", words(2, 7)), element("ul", linked(3))]), name)
        if kind == "footer":
            return element(r.choice(["footer", "footer", "div"]), r.choice([f"&copy; {words(2, 12)}", element("p", f"&copy; {words(2, 16)}"), element("ul", linked(4)) + element("p", words(3, 9))]), name)
        if kind == "aside":
            return element(r.choice(["aside", "aside", "div", "section"]), r.choice([element("h3", words(1, 3)) + element("ul", linked(r.randint(2, 7))), element("p", words(4, 18)), element("h4", words(1, 4)) + element("p", words(4, 25))]), name)
        if kind in ("ad", "notice"):
            return element(r.choice(["div", "div", "section", "aside", "p", "dialog"] if kind == "notice" else ["div", "div", "section", "aside"]), r.choice([words(3, 14), element("p", words(3, 25)), element("p", words(3, 14)) + "<a href='#'>ok</a>", f"<a href='/x'>{words(2, 6)}</a>"]), name)
        if kind == "form":
            return f"<form class='{name}'>{r.choice([words(2, 6), element('p', words(2, 9)), element('div', words(1, 4))])}<input type='text'></form>"
        if kind == "comments":
            one = lambda: element(r.choice(["div", "li", "div", "p", "li", "div", "li", "p", "section", "article"]), r.choice([words(4, 30), element("p", words(4, 40)), element("p", words(1, 2)) + element("p", words(6, 40))]), r.choice(["comment", "reply", "", "comment body"]))
            return element(r.choice(["section", "div", "div", "ol"]), r.choice(["", element("h2", words(1, 3))]) + "".join(one() for _ in range(r.randint(1, 5))), name)
        return element("div", r.choice([linked(3, "p"), words(1, 5), element("ul", linked(3))]), name)

    def content() -> str:
        kinds = [element("h1", words(2, 9), content=True)] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 1, 2, 3, r.randint(3, 14)])):
            x = r.random()
            if x < 0.72:
                kinds.append(element("p", words(1, r.choice([2, 6, 20, 70])) + (f" <a href='/y'>{words(1, 2)}</a> {words(1, 20)}" if r.random() < 0.15 else ""), content=True))
            elif x < 0.8:
                kinds.append(element(r.choice(["h2", "h3"]), words(1, 6), content=True))
            elif x < 0.85:
                kinds.append(element("ul", "".join(element("li", words(2, 14), content=True) for _ in range(r.randint(2, 5))), content=True))
            elif x < 0.89:
                kinds.append(element("blockquote", element("p", words(5, 30), content=True), content=True))
            elif x < 0.91:
                kinds.append(element("table", element("tr", element("td", words(1, 4), content=True) + element("td", words(1, 4), content=True), content=True), content=True))
            elif x < 0.93:
                kinds.append(element("div", words(8, 60), content=True))
            elif x < 0.95:
                kinds.append(element("pre", words(4, 30), content=True))
            else:
                kinds.append(part(r.choice(["ad", "aside", "share", "form", "notice"])))
        inner = "".join(kinds)
        if r.random() < 0.25:
            inner = element(r.choice(["div", "section"]), inner, r.choice(["", *CONTENT_NAMES]), content=True)
        return element(r.choice(["article", "article", "article", "main", "div", "div", "section"]), inner, r.choice(["", "", *CONTENT_NAMES]), content=True)

    out = []
    for _ in range(n):
        before = "".join(part(k) for k in ("notice", "header", "nav", "ad") if r.random() < 0.6)
        after = "".join(part(k) for k in ("share", "aside", "comments", "form", "ad", "notice", "nav", "footer") if r.random() < 0.45)
        body = before + content() + after
        if r.random() < 0.1:  # a fragment that is all content
            out.append(content() if r.random() < 0.5 else element(r.choice(["article", "main", "div", "section"]), element("p", words(1, r.choice([2, 6, 20])), content=True), content=True))
            continue
        if r.random() < 0.5:
            body = element("div", body, r.choice(["", "wrapper", "container", "page", "layout", "row"]))
        out.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>")
    return out


def labelled_roots(n: int = 200, seed: int = 12) -> list[tuple[str, int]]:
    """Pages with text outside all blocks, and whether it is content: fragments and plain texts, or strays around a page."""
    r = random.Random(seed)
    words = lambda lo, hi: " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi))).capitalize() + "."
    out = []
    for page in labelled_pages(n // 2, seed):
        lines = [words(3, 60) for _ in range(r.choice([1, 1, 2, r.randint(3, 12)]))]
        if r.random() < 0.3:
            lines.append(f"{words(5, 30)} <a href='/y'>{words(1, 2)}</a> {words(5, 20)}")
        out.append((r.choice(["<br>", "<br><br>", " ", "<hr>"]).join(lines) + r.choice(["", f"<p>{words(4, 30)}</p>", f"<ul><li>{words(2, 9)}</li></ul>"]), 1))
        stray = r.choice([words(1, 5), f"<a href='/x'>{words(1, 5)}</a>", " | ".join(f"<a href='/{i}'>{words(1, 2)}</a>" for i in range(r.randint(2, 8)))])
        out.append(((stray + page) if r.random() < 0.5 else page + stray, 0))
    return out


def train(pages: list[str] | None = None) -> Model:
    """Potentials by counts over labelled pages, one added to each count."""
    seen: dict[str, list[int]] = {}
    total, pairs = [0, 0], [[1, 1], [1, 1]]
    for source in pages if pages is not None else labelled_pages():
        page = parse(source)
        label = [int(MARK in n.words) for n in page.nodes]
        for n in page.nodes:
            n.words = tuple(w for w in n.words if w != MARK)
        for i, f in enumerate(evidence(page)):
            if i:
                total[label[i]] += 1
                pairs[label[page.nodes[i].parent]][label[i]] += 1
                for x in f:
                    seen.setdefault(x, [0, 0])[label[i]] += 1
    odds = {x: math.log((c[1] + 1) / (total[1] + 2)) - math.log((c[0] + 1) / (total[0] + 2)) for x, c in seen.items()}
    roots: dict[str, list[int]] = {}
    made, count = labelled_roots(), [0, 0]
    for source, content in made:
        count[content] += 1
        for x in evidence(parse(source))[0]:
            roots.setdefault(x, [0, 0])[content] += 1
    odds |= {x: math.log((c[1] + 1) / (count[1] + 2)) - math.log((c[0] + 1) / (count[0] + 2)) for x, c in roots.items()}
    return Model(odds, tuple(tuple(c / sum(row) for c in row) for row in pairs))


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [own.extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
