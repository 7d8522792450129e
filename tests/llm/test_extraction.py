"""Main text of pages: blocks and evidence by rule, and the style tree against a plain version."""

import math
import random
from collections import defaultdict

import pytest

from kgspark.llm import extraction as x

SCHEMA = "page_id long, url string, html string, host string, text string, node long, value long, id long"


def text_of(page):
    return "\n".join(x.main_text(x.parse(page)[0], x.Place("h")))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain   text\n only", "plain text only"),
        ("<article><h1>A &amp; B</h1><p><b>one<br>two<br><p>three &eacute;&#x41;&lt;p&gt;</p>tail</article>", "A & B\none two\nthree éA<p>\ntail"),
        ("<body><nav>m</nav><article><p>x</p></article><footer>f</footer></body>", "x"),
        ("<header>h</header><main><header><h1>T</h1></header><p>x<script>var a='</p>';</script>y</p><aside>s</aside></main>", "T\nxy"),
        ("<article><p>x</p><div class='comments'><article class=comment>no</article></div><form><p>no</p></form><p class='cookie-notice'>no</p></article>", "x"),
        ("<form id=f><article><p>x</p></article></form>", "x"),
        ("<div class=has-sidebar><article>x</article></div>", "x"),
        ("<div class='site sidebar'><main><p>x</p></main></div>", "x"),
        ("<div id=header>h</div><div id=content><h2>T</h2>x<ul><li>i<li>j</ul></div><div class='post-ad'>a</div>", "T\nx\ni\nj"),
        ("<ul><li><a href=1>one</a></li></ul><p>see <a href=2>two</a></p>", "see two"),
        ("<article>cut<!-- open <p>x", "cut"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut<a href='x", "cut"),
        ("<article>1 < 2 <3 & <p title='a>b'>x</p></>", "1 < 2 <3 &\nx"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>d\n  e</pre></article>", "a\nb\nc\nd e"),
        ("<ARTICLE><P HIDDEN>no</P><P STYLE='display: none'>no</P><P>yes</ARTICLE>", "yes"),
        ("<title>t</title><style>p{}</style><textarea>no <p>x</textarea>a<template><p>no</p></template><svg><text>no</text></svg>", "a"),
        ("<div>" * 300 + "deep" + "</div>" * 300, "deep"),
        ("<b>" * 2000 + "x" + "</i></div>" * 50, "x"),
    ],
)
def test_blocks(page, text):
    assert text_of(page) == text


def site(r, host, n, boiler=True):
    """Pages of one unlabelled template."""
    word = lambda k: " ".join(r.choice("abcdefghij") * r.randint(1, 3) + str(r.randint(0, 99)) for _ in range(k))
    for i in range(n):
        body = "".join(f"<p>{word(20)}</p>" for _ in range(r.randint(1, 5)))
        menu = "<div class=top><a href=/a>Home</a> <a href=/b>About us</a></div>" if boiler else ""
        tail = f"<div class=low><span>All rights, page {i}</span></div>" if boiler else ""
        again = "<p>Read us every day</p>" if boiler else ""
        yield f"http://{host}/{i}", f"<html><body>{menu}<div class=main><h1>{word(4)}</h1>{body}{again}</div>{tail}</body></html>", body


def test_unlabelled_sites(spark):
    r = random.Random(4)
    made = list(site(r, "s.org", 40)) + list(site(r, "t.org", 3)) + list(site(r, "u.org", 30, False))
    copies = [("http://c.org/%d" % i, made[0][1], made[0][2]) for i in range(30)]
    rows = [(i, u, h, "h", "t", 1, 2, 3) for i, (u, h, _) in enumerate(made + copies)]
    rows += [(900, None, None, *rows[0][3:]), (900, "x", "", *rows[0][3:]), (None, "http://s.org/", "<p>" + "long " * 100_000, *rows[0][3:])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {(q.page_id, q.url): q for q in x.extract(df).collect()}
    assert len(found) == len(rows) and all(q.n_chars == len(q.text) for q in found.values())
    for i, (u, h, body) in enumerate(made + copies):
        q = found[i, u]
        want = [p[3:] for p in body.replace("</p>", "\n").strip().split("\n")]
        assert [p for p in q.text.split("\n") if p in want] == want
        assert ("All rights" in q.text) == ("c.org" in u or "t.org" in u)  # too few pages, or only copies, to tell
        assert ("every day" in q.text) == ("c.org" in u or "t.org" in u) and ("About" in q.text) == ("c.org" in u or "t.org" in u)
    assert found[900, None].text == "" and found[900, "x"].text == "" and len(found[None, "http://s.org/"].text) == 499_999
    assert x.extract(df.limit(0)).count() == 0


def test_tree_inside_articles(spark):
    """The tree judges an article's branches, too; bare elements, copies and what differs in a number stay, named parts go."""
    r = random.Random(5)
    word = lambda k: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(k))
    box = "<div class=box><p>Read us every day</p><a href=/x>Join</a></div>"
    rows, want = [], []

    def add(host, html, text):
        rows.append((len(rows), f"http://{host}/{len(rows)}", html, "h", "t", 1, 2, 3))
        want.append(text)

    for i in range(12):
        ours, other = word(9), word(4)
        page = f"<body><nav>{other}</nav><article><h1>Title {i}</h1><p>{ours}</p><p>Every day</p>{box}</article><footer>{other}</footer></body>"
        add("many.org", page, f"Title {i}\n{ours}\nEvery day")
        add("copies.org", f"<article><h1>Title {i}</h1><div class=body><p>Same</p></div></article>", f"Title {i}\nSame")
        add("titles.org", f"<title>Title {i}</title><article><div class=body><p>Same</p></div></article>", "Same")
        add("numbers.org", f"<article><h1>Title {i}</h1><div class=body><p>Body {i}</p></div></article>", f"Title {i}\nBody {i}")
        add("plain.org", f"<h1>Title {i}</h1><div class=body><p>{ours}</p></div>{box}", f"Title {i}\n{ours}")
        if i < 4:
            add("few.org", page, f"Title {i}\n{ours}\nEvery day\nRead us every day\nJoin")
    add("many.org", f"<body><article><h2>Else</h2><section>x</section>{box}</article></body>", "Else\nx\nRead us every day\nJoin")  # a sequence that the tree doesn't know
    found = {q.page_id: q.text for q in x.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert [found[i] for i in range(len(rows))] == want


def plain_importances(pages):
    """The style tree as nested counts, by recursion."""
    kinds = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    kids, of = defaultdict(lambda: defaultdict(set)), {}
    for host, page in pages:
        root, _, heading = x.parse(page)
        doc = x.Place(host).of("doc", heading or page)
        styles = {}
        for _, me, parent, _, fan, kind, values in x.walk(root, x.Place(host)):
            kinds[me][x.PRESENT][0].add(doc)
            for v in values:
                kinds[me][kind][v].add(doc)
            if kind == x.STYLE:
                styles[me] = values[0]
            of[me] = fan
            kids[parent][styles.get(parent)].add(me)

    def importance(node):
        k = kinds[node]
        m = len(k[x.PRESENT][0])
        if m < 2:
            return 1.0
        if k[x.NAMED]:
            return sum(v * len(d) for v, d in k[x.NAMED].items()) / sum(map(len, k[x.NAMED].values()))
        if k[x.CONTENT]:
            return 1 - sum(math.log(len(d)) / math.log(m) for d in k[x.CONTENT].values()) / len(k[x.CONTENT])
        n = {v: len(d) for v, d in k[x.STYLE].items()}
        all_ = sum(n.values())
        own = -sum(c / all_ * math.log(c / all_, all_) for c in n.values())
        below = 0.0
        for v, c in n.items():
            some = kids[node][v]
            fan = max((of[q] for q in some), default=1)
            below += c / all_ * (1.0 if c == 1 else sum(map(importance, some)) / fan)
        keep = x.DAMPING ** len(n)
        return (1 - keep) * own + keep * below

    return {node: importance(node) for node in list(kinds) if len(kinds[node][x.PRESENT][0]) > 1}


def test_style_tree_against_plain(spark, tmp_path):
    """Elements that occur once in their place on a page, so that a child stands on as many pages as the sequence above it."""
    r = random.Random(9)
    pages = []
    for i in range(24):
        parts = [f"<div class=a><p>{r.choice(['x', 'y', 'z' * (i + 1)])}</p></div>", f"<section><div class=q><h2>t{chr(97 + i)}</h2></div>{r.choice(['', '<ul><li>1</li></ul>'])}</section>", "<nav>n</nav>", "<p>same</p>"]
        pages.append((r.choice(["one", "two"]), "<body>" + "".join(p for p in parts if r.random() < 0.8) + "</body>"))
    df = spark.createDataFrame(pages, "host string, html string").repartition(4)
    nodes, _ = x.importances(x.page_facts(df), str(tmp_path))
    got, want = {q.node: q.importance for q in nodes.collect()}, plain_importances(pages)
    assert got.keys() == want.keys() and len(want) > 10
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
    assert all(q.most >= q.importance for q in nodes.collect())
