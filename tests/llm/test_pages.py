"""Page operators: extraction on labelled pages, archives there and back."""

import hashlib
from collections import Counter

import pytest

from voxloom.llm import html, warc
from voxloom.session import ship_package

PAGES = "page_id long, url string, html string, name string, digest string, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    ship_package(spark)
    big = "".join(f"<p>Paragraph {k} of a long page, with some words in it.</p>" for k in range(3000))
    rows = [(1, "http://a/ b\r\n", "<article><p>Hello &amp; bye</p></article>" * 5), (2, None, None), (3, "u", ""), (4, "u", "<p>x"), (5, "u", "<p>x"), (6, "u", big), (7, "u", big), (8, "u", "é" * 60)]
    rows += [(9, "u", "é" * 60), (9, "u", "é" * 60), (None, "u", "é" * 60), (10, "u", "<article><p>Hello &amp; bye</p></article>" * 5), (11, "u", big + "1")]
    return spark.createDataFrame([(*r, "n", "d", "p") for r in rows], PAGES).repartition(3).cache()


# extraction

CASES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></ul></nav><main><h1>A title</h1><p>One <b>bold</b>\n word.<p>Two&nbsp;&eacute; &lt;x&gt;</main><footer>&copy; x</footer></body></html>", ["A title", "One bold word.", "Two é <x>"]),
    ('<body><div class="sidebar"><p>Side story about something else entirely.</p></div><div class="post-content"><p>The text goes on, and ends.</p><div class="ad"><p>Buy now.</p></div><p>More of it here, as usual.</p></div><div id="comments"><p>I do not agree at all with this.</p></div></body>', ["The text goes on, and ends.", "More of it here, as usual."]),
    ('<article><h1>Head</h1><p>Body of the story, a sentence.</p><form><p>Sign up for letters.</p><input></form><ul><li>A point made in the text.</li></ul><script>var a = "</p><p>no";</script><section class="comments"><h3>Comments</h3><p>Some reader says something.</p></section></article>', ["Head", "Body of the story, a sentence.", "A point made in the text."]),
    ("<article><p>Broken <b>markup <i>here</p><p>goes on</article><footer>end", ["Broken markup here", "goes on"]),
    ("<article><table><tr><td>1<td>2<tr><td>3</table><pre>x  y</pre></article>", ["1", "2", "3", "x y"]),
    ("<html><head><title>t</title><meta name=x><article><p>No end of the head here.</p></article>", ["No end of the head here."]),
    ("<head><script>if (a <b && c) x = '<!-- ';</script></head><article><p>After the script.</p></article>", ["After the script."]),
    ("<head><template><div>unseen</div></template><link rel=x></head><article><p>After the template.</p></article>", ["After the template."]),
    *[(f"<article><p>Before it, a sentence.</p><{t}></article><article><p>After it, a sentence.</p></article>", ["Before it, a sentence.", "After it, a sentence."]) for t in ("button", "select", "object", "video", "svg")],
    ("<article><button>a<p>After one that is open.</p><button>b</button><p>After one that is closed.</p></article>", ["a", "After one that is open.", "After one that is closed."]),
    ("<article><svg><svg></svg><script>var x = '</svg>';</script><p>unseen</p></svg><p>After the picture.</p></article>", ["After the picture."]),
    (f"<article data-x='{'{' + 'y' * 9000}><p>no</p>'><p>After a long value.</p></article>", ["After a long value."]),
    ("", []),
    ("<!-- <p>no</p> --><article><p>yes</article>", ["yes"]),
]


@pytest.fixture(scope="module")
def potentials():
    return html.Potentials([(html.labelled_seed(p), html.SEED_WEIGHT) for p in html._seeds()])


@pytest.mark.parametrize("page,want", CASES)
def test_extraction(potentials, page, want):
    assert html.blocks(html.tree(page), potentials) == want


@pytest.fixture(scope="module")
def all_seeds():
    return html.Potentials(html.seed_pages())


def said(n):
    """A paragraph of about n characters."""
    return ("words of an ordinary article go on here and there, as they do " * (n // 60 + 1))[: n - 1].rstrip() + "."


MENU = '<a href="/a">Home</a> <a href="/b">News</a>'
PLAIN = [
    *[(f"<html><body><h1>A title</h1>{f'<p>{said(n)}</p>' * 5}</body></html>", ["A title"] + [said(n)] * 5) for n in (20, 60, 100, 150, 300, 600)],
    *[(f"<body><p>{said(n)}", [said(n)]) for n in (20, 100, 400)],
    ("<body><p>Plain page with only one paragraph.", ["Plain page with only one paragraph."]),
    (f"<body>{said(200)}<br>{said(90)}</body>", [f"{said(200)} {said(90)}"]),
    (f"<body><nav>{MENU}</nav><p>{said(100)}</p><p>{said(50)}</p><div class='sidebar'><p>Side story, as it is.</p></div><footer>&copy; x</footer></body>", [said(100), said(50)]),
    (f"<body><table><tr><td>{MENU}</td><td><p>{said(200)}</p><p>{said(150)}</p></td></tr></table></body>", [said(200), said(150)]),
    (f"<article><h1>T</h1><p>{said(200)}</p><ul><li><a href=/1>First source</a></li><li><a href=/2>Second source here</a></li></ul></article>", ["T", said(200), "First source", "Second source here"]),
]


@pytest.mark.parametrize("page,want", CASES + PLAIN)
def test_pages_that_name_no_part(all_seeds, page, want):
    """Nothing of an article is lost because its page has no class, id or sectioning element."""
    assert html.blocks(html.tree(page), all_seeds) == want


def test_pages_of_the_table_that_training_never_saw(all_seeds):
    """Potentials from seed pages alone, on the table's pages labelled by their structure."""
    import duckdb

    wrong = n = 0
    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null").fetchall():
        root = html.labelled_by_parts(page)
        if root is not None:
            n += 1
            wrong += html.blocks(html.tree(page), all_seeds) != [x.text for x in html._order(root) if x.text is not None and x.label]
    assert n > 100 and wrong == 0


def test_marginals_are_exact(potentials):
    """Sum-product on the tree against the sum over all labellings."""
    from itertools import product

    root = html.tree('<body><nav><a href="/x">Home</a></nav><div class="content"><p>One sentence here.</p></div></body>')
    nodes = html._order(root)
    place = {id(n): k for k, n in enumerate(nodes)}
    own = [potentials.node(n) for n in nodes]
    total, content = 0.0, Counter()
    for labels in product((0, 1), repeat=len(nodes)):
        p = 1.0
        for n, y, f in zip(nodes, labels, own, strict=True):
            p *= f[y]
            if n.parent is not None:
                p *= potentials.pair.get((html._kind(n.parent), html._kind(n)), html.EVEN)[labels[place[id(n.parent)]]][y]
        total += p
        for n, y in zip(nodes, labels, strict=True):
            content[id(n)] += p * y
    for node, p in html.marginals(root, potentials):
        assert p == pytest.approx(content[id(node)] / total, abs=1e-9)


def test_seeds_are_learned(potentials, all_seeds):
    for page in html._seeds() + html._plain_seeds():
        root = html.labelled_seed(page)
        want = [n.text for n in html._order(root) if n.text is not None and n.label]
        assert html.blocks(html.tree(page), all_seeds) == want
        if page in html._seeds():
            assert html.blocks(html.tree(page), potentials) == want


def test_every_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.op1_html(spark, "/root/testdata/sf0.01").collect()}
    for row in pages.collect():
        root = html.labelled_by_parts(row.html)
        want = "\n\n".join(n.text for n in html._order(root) if n.text is not None and n.label)
        assert (got[row.page_id].text, got[row.page_id].n_chars, got[row.page_id].url) == (want, len(want), row.url)


def test_edge_pages(spark, pages):
    out = html.extract(pages).collect()
    assert len(out) == pages.count()
    assert {r.text for r in out if r.page_id in (2, 3)} == {""}
    assert html.extract(pages.limit(0)).count() == 0


# archives


def test_there_and_back(spark, pages, tmp_path):
    got = Counter(map(tuple, warc.read_pages(warc.write_pages(pages, str(tmp_path)), str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, b in rows:
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    want = Counter()
    for i, b in rows:
        to = first[b] if i is not None and b in first and i > first[b] else None
        want[i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to] += 1
    assert got == want
    assert warc.read_pages(warc.write_pages(pages.limit(0), str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


def test_segments(spark):
    payload = bytes(range(256)) * 300
    records = [warc.parsed(r) for r in warc.page_records(5, "u", payload, hashlib.sha256(payload).hexdigest(), None, 1000)]
    assert len(records) > 70 and records[1][0]["WARC-Type"] == "continuation"
    segments = [{"number": int(f["WARC-Segment-Number"]), "total": int(f.get("WARC-Segment-Total-Length", 0)) or None, "fields": list(f.items()), "block": b} for f, b in records]
    fields, block, copies = warc.assembled(segments[::-1])
    assert copies == 1 and warc._told(fields, block)[4:] == (len(payload), hashlib.sha256(payload).hexdigest())
    with pytest.raises(ValueError, match="missing"):
        warc.assembled(segments[:3] + segments[4:])
    with pytest.raises(ValueError, match="stated"):
        warc.assembled([*segments[:-1], segments[-1] | {"total": 3}])


def test_framing():
    for payload in (b"", b"x", b"0\r\n\r\n" * 5000):
        assert warc.dechunked(warc.chunked(payload, 7)) == payload
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab\r\n0\r\n\r\n")
