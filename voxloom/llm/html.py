"""Main text of web pages from a tree-structured graphical model over the DOM.

Nodes are block elements and runs of text; each is content or not. A node's features (tag, words of its
class and id, length, share of links, punctuation) give its own potential, parent and child share a
potential that depends on the kinds of both. Messages go up and down the tree once (sum-product, exact
on a tree), and a run of text is kept when its marginal for content is over one half.

Potentials are counted on labelled pages: the seed pages below, whose elements say what they are, and a
bounded sample of the pages at hand that name their parts (``article`` or ``main`` around the content).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.words import slices, text_bytes

#: Most pages of the table that train the potentials, drawn by hash.
TRAINING_PAGES = 500
SEED_WEIGHT = 20
#: Features of a node overlap, so most count for less than independent ones would.
EVIDENCE = {"tag": 0.3, "in": 0.1, "size": 0.25, "ends": 0.25, "links": 0.5, "hint": 1.0, "word": 0.5}
TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<rest>[^>]*+)>|\Z)|<[!?][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S,
)
HINTS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Fixed: element kinds of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript iframe object svg math canvas audio video textarea select option datalist button title".split())
RAW = frozenset("script style textarea title iframe noscript noframes xmp".split())
#: Unseen elements that end where the next of their kind begins.
ALONE = frozenset("button select option datalist textarea".split())
PAGE = frozenset("#root html body".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul hr".split()
)
ENDS_P = BLOCK - frozenset("html body dd dt li thead tbody tfoot tr td th caption legend".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}
P_WALLS = frozenset("html body article aside section div main header footer nav form table td th li dd blockquote figure figcaption details dialog fieldset center address".split())


class Node:
    """A block element or, with ``text``, a run of text."""

    __slots__ = ("tag", "hints", "parent", "children", "text", "linked", "label", "attrs", "plain")

    def __init__(self, tag, parent, attrs="", text=None, linked=0):
        self.tag, self.parent, self.attrs, self.text, self.linked = tag, parent, attrs, text, linked
        self.children, self.label, self.plain = [], None, False
        self.hints = ()
        if parent is not None:
            parent.children.append(self)


def _tokens(page: str) -> list[tuple[str | None, bool, str]]:
    """``tag, closing, attrs`` of each tag, and ``None, False, text``; raw elements are ``#raw``, whatever lies between."""
    out = []
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m["tag"] is None:
            if m["text"] is not None:
                out.append((None, False, m["text"]))
            continue
        tag, closing, attrs = m["tag"].lower(), m["close"] == "/", m["attrs"] or m["rest"] or ""
        if tag in RAW and not closing:  # its end is the next closing tag
            if not attrs.endswith("/") or tag in ("script", "style"):
                end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            tag = "#raw"
        out.append((tag, closing, attrs))
    return out


def _skips(tokens: list[tuple[str | None, bool, str]]) -> dict[int, int]:
    """For each unseen element that is closed, where it begins and ends; one that is not hides nothing."""
    ends, opened = {}, defaultdict(list)
    for i, (tag, closing, attrs) in enumerate(tokens):
        if tag not in UNSEEN:
            continue
        if closing:
            if opened[tag]:
                ends[opened[tag].pop()] = i
        elif not attrs.endswith("/"):
            if tag in ALONE:
                opened[tag].clear()
            opened[tag].append(i)
    return ends


def tree(page: str) -> Node:
    """The block elements and runs of text of a page; broken markup never raises."""
    root = Node("#root", None)
    stack = [root]  # open elements that are blocks
    parts: list[str] = []
    links = 0  # open links
    linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                Node("#text", stack[-1], text=text, linked=linked)
            parts.clear()
        linked = 0

    def pop_to(node):
        while stack[-1] is not node:
            stack.pop()
        stack.pop()

    tokens = _tokens(page)
    skips = _skips(tokens)
    at = 0
    while at < len(tokens):
        tag, closing, attrs = tokens[at]
        at = skips.get(at, at) + 1
        if tag is None:
            text = html.unescape(attrs)
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        if tag == "#raw":
            parts.append(" ")
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                for node in reversed(stack):
                    if node.tag == tag:
                        pop_to(node)
                        links = 0
                        break
            continue
        if tag in UNSEEN:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            links += 1
            continue
        if tag not in BLOCK:
            continue
        flush()
        links = 0
        if tag in ENDS_P:
            for node in reversed(stack):
                if node.tag == "p":
                    pop_to(node)
                    break
                if node.tag in P_WALLS:
                    break
        if tag in SIBLINGS:
            for node in reversed(stack):
                if node.tag in SIBLINGS[tag]:
                    pop_to(node)
                    break
                if node.tag in WALLS[tag]:
                    break
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if tag == "hr":
            continue
        node = Node(tag, stack[-1], attrs)
        node.hints = tuple(w for f in HINTS.finditer(attrs) for w in re.findall("[a-z]+", (f[2] or f[3] or f[4] or "").lower())) if attrs else ()
        stack.append(node)
    flush()
    _tell_plain(root)
    return root


def _tell_plain(root: Node) -> None:
    """Mark the page nodes of a page whose text lies in the body itself, in no part that holds an article."""
    order = _order(root)
    page = [n for n in order if n.tag in PAGE]
    if not any(n.tag in ("article", "main") for n in order) and any(c.tag in ("p", "#text") for n in page for c in n.children):
        for n in page:
            n.plain = True


def features(node: Node) -> list[tuple[str, str]]:
    """What is seen of a node, as (kind, value)."""
    if node.text is None:
        return [("tag", node.tag), *(("hint", h) for h in node.hints)]
    n = len(node.text)
    share = node.linked / n
    out = [("in", node.parent.tag), ("size", str(min(int(math.log2(n + 1)), 9))), ("links", "none" if share == 0 else "some" if share < 0.5 else f"most in {node.parent.tag}")]
    out.append(("ends", "stop" if node.text[-1] in ".!?:;\"'”»…" else "open"))
    if "©" in node.text or "copyright" in node.text.lower():
        out.append(("word", "copyright"))
    return out


def _order(root: Node) -> list[Node]:
    """Parents before children, in page order among runs of text."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def _kind(node: Node) -> str:
    if node.text is not None:
        return "text"
    if node.tag in PAGE:
        return "plain page" if node.plain else "page"
    return "sectioning" if node.tag in ("article", "main") else "form" if node.tag == "form" else "block"


class Potentials:
    """Counted potentials, as logarithms: ``own[feature]`` and ``pair[kinds][parent label][child label]``."""

    def __init__(self, labelled: list[tuple[Node, int]]) -> None:
        seen = [defaultdict(Counter), defaultdict(Counter)]
        nodes = [Counter(), Counter()]  # elements and runs of text: what a feature that may be absent is counted against
        pair: dict[tuple[str, str], list[list[float]]] = {}
        for root, weight in labelled:
            for node in _order(root):
                for kind, value in features(node):
                    seen[node.label][kind][value] += weight
                nodes[node.label][node.text is None] += weight
                if node.parent is not None:
                    table = pair.setdefault((_kind(node.parent), _kind(node)), [[1.0, 1.0], [1.0, 1.0]])
                    table[node.parent.label][node.label] += weight
        self.own: dict[tuple[str, str], tuple[float, float]] = {}
        for kind in {*seen[0], *seen[1]}:
            values = {*seen[0][kind], *seen[1][kind]}
            for v in values:
                p = []
                for y in (0, 1):
                    of = nodes[y][kind == "hint"] + 1 if kind in ("hint", "word") else sum(seen[y][kind].values()) + 0.5 * len(values)
                    p.append(EVIDENCE[kind] * math.log((seen[y][kind][v] + 0.5) / of))
                self.own[kind, v] = (p[0], p[1])
        self.pair = {k: [[c / sum(row) for c in row] for row in t] for k, t in pair.items()}

    def node(self, node: Node) -> tuple[float, float]:
        a = b = 0.0
        for f in features(node):
            p = self.own.get(f)
            if p:
                a, b = a + p[0], b + p[1]
        top = max(a, b)
        return math.exp(a - top), math.exp(b - top)


EVEN = [[0.5, 0.5], [0.5, 0.5]]


def marginals(root: Node, potentials: Potentials) -> list[tuple[Node, float]]:
    """Probability of content for each run of text, in page order, by one pass up and one pass down."""
    order = _order(root)
    place = {id(n): i for i, n in enumerate(order)}
    belief = [potentials.node(n) for n in order]
    up: list[tuple[float, float]] = [(1.0, 1.0)] * len(order)
    tables = [potentials.pair.get((_kind(n.parent), _kind(n)), EVEN) if n.parent is not None else EVEN for n in order]
    for i in range(len(order) - 1, 0, -1):
        b, t = belief[i], tables[i]
        m0, m1 = t[0][0] * b[0] + t[0][1] * b[1], t[1][0] * b[0] + t[1][1] * b[1]
        s = m0 + m1
        up[i] = (m0 / s, m1 / s)
        p = place[id(order[i].parent)]
        x, y = belief[p][0] * up[i][0], belief[p][1] * up[i][1]
        s = x + y
        belief[p] = (x / s, y / s) if s > 0 else (0.5, 0.5)
    out = []
    for i, node in enumerate(order):
        if i:
            p, t = belief[place[id(node.parent)]], tables[i]
            x, y = p[0] / max(up[i][0], 1e-300), p[1] / max(up[i][1], 1e-300)
            d0, d1 = x * t[0][0] + y * t[1][0], x * t[0][1] + y * t[1][1]
            x, y = belief[i][0] * d0, belief[i][1] * d1
            s = x + y
            belief[i] = (x / s, y / s) if s > 0 else (0.5, 0.5)
        if node.text is not None:
            out.append((node, belief[i][1]))
    return out


def blocks(root: Node, potentials: Potentials) -> list[str]:
    """The kept blocks in page order."""
    return [n.text for n, p in marginals(root, potentials) if p > 0.5]


# labels


def _spread(root: Node) -> Node:
    """Elements are content when they hold a run of text that is."""
    for node in reversed(_order(root)):
        if node.label is None:
            node.label = int(any(c.label for c in node.children))
    return root


def labelled_seed(page: str) -> Node:
    """A seed page: what lies in elements with ``data-main`` is content, but for ``data-aside`` in them."""
    root = tree(page)
    inside = {id(root): 0}
    for node in _order(root)[1:]:
        mark = 1 if "data-main" in node.attrs else 0 if "data-aside" in node.attrs else inside[id(node.parent)]
        inside[id(node)] = mark
        if node.text is not None:
            node.label = mark
    return _spread(root)


OUTSIDE = frozenset("nav header footer aside form menu dialog".split())


def labelled_by_parts(page: str) -> Node | None:
    """A page that has ``article`` or ``main``: text in it is content, but for menus, asides, forms and the like in it."""
    root = tree(page)
    inside, found = {id(root): 0}, False
    for node in _order(root)[1:]:
        up = inside[id(node.parent)]
        if node.tag in ("article", "main"):
            found, up = True, max(up, 1)
        elif node.tag in OUTSIDE and not (node.tag == "header" and up == 1) or SEED_HINTS & set(node.hints):
            up = -1
        inside[id(node)] = up if inside[id(node.parent)] >= 0 else -1
        if node.text is not None:
            node.label = int(inside[id(node)] == 1)
    return _spread(root) if found else None


def _seeds() -> list[str]:
    """Labelled pages in the usual layouts; class names take turns so that each is seen in its role."""
    long = "A paragraph of running text goes on for several clauses, with commas, and it ends as sentences do. " * 3
    short = "A short closing sentence."
    menus, sides = ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "pagination", "toc", "topbar", "skip"], ["sidebar", "side", "aside", "widget", "related", "recommended", "trending", "popular", "rail", "more"]
    adverts, notices = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sponsor"], ["cookie", "notice", "consent", "alert", "popup", "modal", "overlay", "message", "gdpr", "disclaimer", "paywall", "toast"]
    replies, forms = ["comments", "comment", "reply", "replies", "discussion", "responses", "disqus", "reader", "feedback"], ["form", "newsletter", "subscribe", "login", "signup", "search", "contact", "register", "poll"]
    heads, feet = ["header", "masthead", "branding", "logo", "site", "hero"], ["footer", "copyright", "legal", "colophon", "credits"]
    shares, mains = ["share", "social", "tags", "meta", "byline", "toolbar", "actions"], ["content", "article", "post", "entry", "main", "story", "body", "text"]
    out = []
    for i in range(24):
        pick = lambda words, i=i: words[i % len(words)]
        box = [f'<article data-main class="{pick(mains)}">', f'<div data-main class="{pick(mains)}" id="{mains[(i + 3) % len(mains)]}">', f'<main data-main><div class="{pick(mains)}">', f'<div id="page"><section data-main class="{pick(mains)}">'][i % 4]
        end = ["</article>", "</div>", "</div></main>", "</section></div>"][i % 4]
        lead = ["<header><h1>Title</h1></header>", "<h1>Title of the page</h1>", f"<h1>News</h1><p>{short}</p><h3>Part</h3>"][i % 3]
        body = f"{lead}<p>{long}</p><p>{short}</p><h2>A heading</h2><p>{long}</p><ul><li>One point of a list in the text.</li><li>Another point, somewhat longer than the first one.</li></ul><blockquote><p>{long}</p></blockquote><p>{long}</p><table><tr><td>12</td><td>A cell</td></tr></table><pre>code = 1</pre><figure><figcaption>What the picture shows.</figcaption></figure><p>Short one</p><ol><li>First do this.</li><li>Then do that</li><li>And <a href='/r'>this</a> as well.</li><li>Done</li></ol><p>As <a href='/q'>was said before</a>, {long}</p><ul><li>Plain point</li></ul><div>{long}</div>"
        inner = f'<div data-aside class="{pick(adverts)}"><p>Buy this now, it is cheap. {short}</p></div>' if i % 2 else f'<aside data-aside class="{pick(sides)}"><h3>More</h3><ul><li><a href="/x">Another story</a></li><li>{short}</li></ul></aside>'
        share = f'<div data-aside class="{pick(shares)}"><a href="/s">Share</a> <a href="/t">Post</a></div>'
        reply = f'<section data-aside class="{pick(replies)}" id="{replies[(i + 2) % len(replies)]}"><h3>Comments</h3><div class="{replies[(i + 1) % len(replies)]}"><p>{long}</p></div><ol><li><p>I do not agree with this at all, and here is why. {short}</p></li></ol></section>'
        form = f'<form class="{pick(forms)}"><label>Your address</label><p>Sign up for letters. {short}</p><input></form>' if i % 2 else f'<div class="{pick(forms)}"><form><label>Name</label><p>{short}</p></form></div>'
        menu = f'<nav class="{pick(menus)}"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li>About</li></ul></nav>' if i % 2 else f'<div class="{pick(menus)}"><a href="/a">Home</a> <a href="/b">News and more</a></div><ul class="{pick(menus)}"><li><a href="/c">World</a></li></ul>'
        head = f'<header class="{pick(heads)}"><p>Name of the site</p><h1>The Daily</h1></header>' if i % 2 else f'<div id="{pick(heads)}"><h1><a href="/">The Daily</a></h1><p>{short}</p></div>'
        foot = f'<footer class="{pick(feet)}"><p>&copy; 2024 The owner. All rights reserved.</p><p>{long}</p></footer>' if i % 2 else f'<div class="{pick(feet)}">&copy; The owner &middot; <a href="/p">Privacy</a><p>{short}</p></div>'
        note = f'<div class="{pick(notices)}"><p>We use cookies to make this better. {short}</p></div>'
        side = f'<aside class="{pick(sides)}"><h3>Popular</h3><p>{short}</p><ul><li><a href="/p">A popular story</a></li></ul></aside>' if i % 3 else f'<div class="{pick(sides)}"><h3>Popular</h3><p>{long}</p></div>'
        advert = f'<div class="{pick(adverts)}">{short} {long if i % 3 else ""}</div>'
        within = [inner, share, inner + share, ""][i % 4]
        if i % 2:
            out.append(f"<html><body>{note}{head}{menu}{advert}{box}{body}{within}{reply if i % 3 else ''}{end}{'' if i % 3 else reply}{side}{form}{foot}</body></html>")
        else:
            out.append(f"<html><body>{head}{menu}<div>{box}{within}{body}{end}{reply}</div>{side}{advert}{form}{foot}{note}</body></html>")
    return out


def _plain_seeds() -> list[str]:
    """Labelled pages without any part that holds the article: text in the body, with menus and the like beside it."""
    long = "A paragraph of running text goes on for several clauses, with commas, and it ends as sentences do. " * 3
    middle, short = "This paragraph has two clauses, of which this one ends it.", "A short closing sentence."
    links = '<ul data-main><li><a href="/1">A first source that the text names</a></li><li><a href="/2">The second one</a></li></ul>'
    menu = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul>'
    out = []
    texts = [long, middle, short, middle[:-1] + ", and here comes another one.", long[:180] + "."]
    for i in range(20):
        text = texts[i % 5]
        body = "".join(f"<p data-main>{text}</p>" for _ in range([1, 2, 5][i // 5 % 3]))
        lead = ["", "<h1 data-main>Title of the page</h1>", "<h2 data-main>Title</h2><h3 data-main>Part</h3>"][i % 3]
        before = ["", f'<nav class="menu">{menu}</nav>', f'<div class="nav">{menu}</div>', f'<header class="header"><h1>The Daily</h1>{menu}</header>'][i % 4]
        after = ["", f"<footer><p>&copy; 2024 The owner. All rights reserved. {short}</p></footer>", f'<div class="footer"><p>&copy; The owner. {short}</p></div>', f'<div class="sidebar"><h3>Popular</h3><p>{middle}</p>{menu}</div>'][(i + 1) % 4]
        lists = "<ul data-main><li>One point of a list in the text.</li><li>Another point</li></ul>" if i % 2 else ""
        out.append(f"<html><body>{before}{lead}{body}{lists}{after}</body></html>")
        # Line breaks instead of paragraphs: the page's own text.
        out.append(f"<html><body data-main>{text}<br>{middle}<br><br>{long}</body></html>")
        # A table that lays the page out.
        cells = f'<td><a href="/a">Home</a> <a href="/b">News</a></td><td data-main><h1>Title</h1>{body}<p>{middle}</p></td>'
        out.append(f"<html><body><table><tr>{cells}</tr></table></body></html>")
        beside = f"<form data-aside><p>Sign up for letters. {short}</p></form>"
        out.append(f'<html><body><article data-main><h1>Title</h1><p>{text}</p>{links}<p>{middle}</p>{beside if i % 4 == 1 else ""}</article><aside class="related">{menu}</aside></body></html>')
    return out


SEED_HINTS = frozenset(
    "menu navbar breadcrumb breadcrumbs sidebar widget related ad ads advert advertisement sponsored promo cookie notice consent popup modal comments comment reply replies newsletter subscribe login share social footer".split()
)


def seed_pages() -> list[tuple[Node, int]]:
    """All seed pages with their weight."""
    return [(labelled_seed(p), SEED_WEIGHT) for p in _seeds() + _plain_seeds()]


def train(pages: DataFrame, most: int = TRAINING_PAGES) -> Potentials:
    """Potentials from the seed pages and from at most ``most`` pages of ``pages``, drawn by hash.

    The draw leaves about ``most`` pages before they are ordered, so tasks have little to send.
    """
    every = max(1, pages.count() // most)
    drawn = pages.where("html is not null").select("html", F.xxhash64("html").alias("h")).where(F.pmod("h", F.lit(every)) == 0)
    sample = drawn.orderBy("h", "html").limit(most)
    labelled = seed_pages()
    labelled += [(root, 1) for row in sample.select("html").collect() if (root := labelled_by_parts(row.html)) is not None]
    return Potentials(labelled)


def extract(pages: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row; null and empty pages have the empty text. Other columns are not read."""
    shared = pages.sparkSession.sparkContext.broadcast(potentials or train(pages))

    def run(batches):
        for b in batches:
            _, offsets = text_bytes(b.column(2))
            for rows in slices(offsets):
                texts = ["\n\n".join(blocks(tree(p), shared.value)) if p else "" for p in b.column(2).slice(rows.start, len(rows)).to_pylist()]
                own = [b.column(i).slice(rows.start, len(rows)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op1_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_html": op1_html}
ORACLE: dict[str, str] = {}
