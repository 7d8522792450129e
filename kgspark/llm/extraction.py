"""Operator 11: main text of web pages by a site style tree.

The trees of all pages of a host are merged: two elements are one node of the style tree if they stand at the same place of equal sequences of
children (equal tags, classes and ids, digits as 0; repeated children of one kind as one), inside of articles as outside. Of each element node the tree knows how often which
sequence of children stands in it, of each content node (the texts and links of a place) on how many pages each occurs; digits count as 0 there, but not in articles and headings,
which may differ in a number alone. Pages count once for each main heading, so that copies of a page don't look like a template.

Importance: of an element node the entropy of its sequences, of a content node what the mean entropy of its texts and links over the pages leaves of 1;
both in units of log(pages), and 1 for a single page. What tags and attributes name as menu, header, footer, sidebar, notice, advert, form or comments has the importance 0,
and the tree isn't continued inside. The composite importance of a node weighs its own against that of its children, by level from the leaves up. Branches that are below
THRESHOLD with all that is inside are noise. Each page is mapped onto the tree and loses them; what the tree doesn't know stays. So do single texts go that stand on nearly all pages
of their place, outside of articles.

Names are a check that follows: parts named as none of an article go from every page, and where a page names its article, all else goes. Inside, the tree removes the branches
that have a class or id; an article's bare elements are its own words, frequent or not. A page of which the tree would leave nothing, or of its article nothing but headings, differs
from the site's others by these alone: it is a copy, no template, and loses named parts only.

Scale: statistics are sums over (node, value) that Spark aggregates ahead of its shuffles; no host is one task. The removed nodes' ids are sorted arrays in the shared folder,
files by ranges of hosts, which tasks map into memory; no html is shuffled and nothing is broadcast.

Null html is empty, and gives ''. A null url, or one without host, belongs to the host ''. Html of any length is read whole; markup that is cut off
is closed at its end. Elements nested deeper than DEPTH belong to their ancestor at that depth. Repeated rows are kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Folder, pick, shared_folder, small_batches, written
from .url_filter import host_of

#: Composite importance below which a branch is noise; pages that a place must stand on before it is judged; weight of a level against the one below.
THRESHOLD, PAGES, DAMPING = 0.2, 5, 0.9
#: Levels of the style tree.
DEPTH = 24
#: Bits of an id that tell the host; ids of one file, about.
HOST_BITS, SHARD_ROWS = 20, 500_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: What the start of an element closes, and what that search doesn't leave.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html")}
CLOSES |= dict.fromkeys(("thead", "tbody", "tfoot"), ("thead tbody tfoot tr td th", "table"))
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
P_SCOPE = frozenset("table td th caption button object template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Evidence. Tags that are never part of an article; those that aren't unless an article stands inside; roles; words of classes and ids.
NEVER = frozenset("head nav footer aside noscript template svg math canvas object button select dialog datalist audio video".split())
UNLESS = frozenset("form header menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall "
    "menu nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer copyright sidebar aside widget widgets related recommended share sharing social comment comments disqus respond reply replies pagination pager toolbar search".split()
)
#: Words that are part of a whole page's or an article's own class, and are no evidence inside an article.
OUTSIDE = frozenset(("header", "banner", "masthead"))
PREFIXES = frozenset("has no with without is".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|</(?:[^a-zA-Z>][^>]*+(?:>|\Z)|>)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element that begins a block, with elements and texts inside."""

    __slots__ = ("tag", "sign", "noise", "content", "kids", "up", "drop", "holds")

    def __init__(self, tag: str, sign: str, noise: int, content: int, up: Node | None):
        self.tag, self.sign, self.noise, self.content, self.up = tag, sign, noise, content, up
        self.kids: list[Node | Text] = []
        self.drop = self.holds = False


class Text:
    __slots__ = ("text", "links", "linked", "up")
    sign = "#"

    def __init__(self, text: str, links: tuple[str, ...], linked: bool, up: Node):
        self.text, self.links, self.linked, self.up = text, links, linked, up


def evidence(tag: str, attributes: str) -> tuple[str, int, int, str]:
    """Sign, noise (2: by its tag, 1: unless an article stands inside, -1: only outside of one), content (2: article, 1: main), and link of an element."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    role = found.get("role", "").lower()
    content = 2 if tag == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower() else 1 if tag == "main" or role == "main" else 0
    noise = 2 if tag in NEVER or "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) else 0
    if not noise and tag not in ("html", "body"):
        words = {w for name in names if (parts := [p.lower() for p in _WORD.findall(name)]) and parts[0] not in PREFIXES for w in parts}
        hits = words & WORDS
        if hits - OUTSIDE or role in ROLES - {"banner"} or tag in UNLESS - {"header"}:
            noise = 1
        elif hits or role == "banner" or tag == "header":
            noise = -1
    sign = re.sub(r"\d+", "0", " ".join([tag, *sorted(names)]))
    return sign, noise, content, found.get("href") or found.get("src") or ""


def parse(page: str, known: dict[tuple[str, str], tuple[str, int, int, str]] | None = None) -> tuple[Node, list[Node], str]:
    """The tree of blocks, its nodes (parents first), and the main heading."""
    known = {} if known is None else known
    root = Node("", "", 0, 0, None)
    nodes, here, heading, title = [root], root, "", ""
    opened: list[tuple[str, Node | None]] = []
    buffer: list[str] = []
    links: list[str] = []
    anchors, plain, at = 0, False, 0

    def flush() -> None:
        nonlocal heading, plain
        if buffer:
            text = " ".join("".join(buffer).split())
            if text and here.noise != 2:
                here.kids.append(Text(text, tuple(links), not plain, here))
                if not heading and here.tag in ("h1", "h2", "h3"):
                    heading = text
            buffer.clear()
        links.clear()
        plain = False

    def add(text: str) -> None:
        nonlocal plain
        if "&" in text:
            text = entities.unescape(text)
        buffer.append(text)
        plain = plain or not anchors and not text.isspace()

    def shut(k: int) -> None:
        nonlocal here, anchors
        for tag, node in reversed(opened[k:]):
            if node is not None:
                flush()
                here = node.up
            elif tag == "a":
                anchors -= 1
        del opened[k:]

    def close(tags: frozenset[str] | set[str], stop: frozenset[str]) -> None:
        deepest = None
        for k in range(len(opened) - 1, -1, -1):
            if opened[k][0] in tags:
                deepest = k
            elif opened[k][0] in stop:
                break
        if deepest is not None:
            shut(deepest)

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        if not m[4]:
            break  # the page ends inside a tag
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag == "p" and all(t != "p" for t, _ in opened):
                (flush if tag == "p" else lambda: add(" "))()
                continue
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == tag:
                    shut(k)
                    break
                if tag in INLINE and opened[k][1] is not None:
                    break  # an inline element isn't closed from inside a block
            continue
        if tag in RAW:  # not shown, or a form's: nothing of it ends a block
            end = _RAW_END[tag].search(page, at)
            if tag == "title" and not title:
                title = " ".join(entities.unescape(page[at : end.start() if end else len(page)]).split())
            at = end.start() if end else len(page)
            continue
        if tag in ("br", "wbr"):
            if tag == "br":
                add(" ")
            continue
        key = (tag, m[3])
        seen = known.get(key)
        if seen is None:
            seen = evidence(*key)
            if len(known) < 5000:
                known[key] = seen
        sign, noise, content, link = seen
        if tag in ENDS_P:
            close({"p"}, P_SCOPE)
            if tag[0] == "h" and len(tag) == 2 and opened and opened[-1][0] in HEADINGS and tag != "hr":
                shut(len(opened) - 1)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in INLINE and not noise and not content:
            if link:
                links.append(link)
            if tag not in VOID:
                opened.append((tag, None))
                anchors += tag == "a"
            continue
        flush()
        if tag in VOID:
            continue
        node = Node(tag, sign, noise, content, here)
        here.kids.append(node)
        nodes.append(node)
        opened.append((tag, node))
        here = node
        if noise == 2 or here.up.noise == 2:
            node.noise = 2
    if at < len(page) and not m:
        add(page[at:])
    while opened:
        shut(len(opened) - 1)
    flush()
    _judge(nodes)
    return root, nodes, heading or title


def _judge(nodes: list[Node]) -> None:
    """Sets drop by the evidence alone; content stays set only where it names the article of a page."""
    best = 0
    for n in nodes[1:]:
        n.drop = n.up.drop or n.noise == 2
        if n.content and not n.drop:
            best = max(best, n.content)
    for n in reversed(nodes):
        n.content = n.content if n.content == best and not n.drop and n.noise != 1 else 0
        if n.up is not None and (n.content or n.holds):
            n.up.holds = True
    for n in nodes[1:]:
        n.content = n.content or n.up.content
        n.drop = n.up.drop or n.noise == 2 or (n.noise == 1 and not n.holds) or (n.noise == -1 and not n.content and not n.holds)


def _id(*parts: int | str) -> int:
    h = xxhash.xxh64()
    for p in parts:
        h.update(struct.pack("<Q", p) if isinstance(p, int) else p.encode("utf-8", "surrogatepass"))
    return h.intdigest()


class Place:
    """Ids of one host: the host in the upper bits, so that all of a host's ids lie together; signed, as Spark has them."""

    def __init__(self, host: str):
        self.top = _id(host) >> (64 - HOST_BITS) << (64 - HOST_BITS)

    def of(self, *parts: int | str) -> int:
        x = self.top | (_id(self.top, *parts) & ((1 << (64 - HOST_BITS)) - 1))
        return x - (1 << 64) if x >> 63 else x


PRESENT, STYLE, CONTENT, NAMED = range(4)
FACTS = "node long, parent long, depth int, fan int, kind int, value long, doc long"


def walk(root: Node, place: Place) -> Iterator[tuple[Node | Text, int, int, int, int, int, list[int]]]:
    """The parts of a page's tree: part, id, parent's id, depth, number of siblings, kind, values."""
    mask = (1 << 64) - 1
    todo: list[tuple[Node, int, int, int, int]] = [(root, place.of(""), 0, 0, 1)]
    while todo:
        node, me, parent, depth, fan = todo.pop()
        kids = node.kids if depth < DEPTH else list(_flat(node))
        signs: list[str] = []
        at: list[int] = []
        for kid in kids:
            sign = "!" + kid.sign if isinstance(kid, Node) and kid.drop else kid.sign
            if not signs or signs[-1] != sign:
                signs.append(sign)
            at.append(len(signs) - 1)
        style = place.of(me & mask, "\n".join(signs))
        yield node, me, parent, depth, fan, STYLE, [style]
        for kid, k in zip(kids, at, strict=True):
            id_ = place.of(me & mask, style & mask, k)
            if isinstance(kid, Text):
                text = kid.text.lower()
                some = [text if kid.up.content or kid.up.tag in HEADINGS else re.sub(r"\d+", "0", text), *("@" + x for x in kid.links)]
                yield kid, id_, me, depth + 1, len(signs), CONTENT, [place.of(id_ & mask, x) for x in some]
            elif kid.drop:
                yield kid, id_, me, depth + 1, len(signs), NAMED, [0]
            else:
                todo.append((kid, id_, me, depth + 1, len(signs)))


def _flat(node: Node) -> Iterator[Node | Text]:
    stack = list(reversed(node.kids))
    while stack:
        x = stack.pop()
        if isinstance(x, Text) or x.drop:
            yield x
        else:
            stack += reversed(x.kids)


def page_facts(pages: DataFrame) -> DataFrame:
    """pages (host, html): rows of FACTS."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in small_batches(batches, "html"):
            columns: list[list[int]] = [[] for _ in range(7)]
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                root, _, heading = parse(page or "", known)
                place = Place(host)
                doc = place.of("doc", heading or page or "")
                facts = {(me, parent, depth, fan, k, v, doc) for _, me, parent, depth, fan, kind, values in walk(root, place) for k, v in ((PRESENT, 0), *((kind, v) for v in values))}
                for c, some in zip(columns, zip(*facts, strict=True), strict=True):
                    c += some
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in FACTS.split(", ")])

    return pages.select("host", "html").mapInArrow(find, FACTS)


def importances(facts: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of the nodes that stand on two pages or more the composite importance and the most of any branch inside (node, m, importance, most); of each text and link of theirs on two pages or more value, m, importance."""
    meta = [F.min(c).alias(c) for c in ("parent", "depth", "fan")]
    once = facts.groupBy("node", "kind", "value", "doc").agg(*meta)
    values = written(once.groupBy("node", "kind", "value").agg(F.count("*").alias("n"), *meta), folder, "values")
    only = lambda kind, x: F.when(F.col("kind") == kind, x)
    n, log = F.col("n"), F.log(F.col("n"))
    nodes = values.groupBy("node").agg(
        *meta,
        F.max(only(PRESENT, n)).alias("m"),
        F.sum(only(STYLE, n)).alias("styled"),
        F.sum(only(STYLE, n * log)).alias("style_logs"),
        F.count(only(STYLE, n)).alias("styles"),
        F.count(F.when((F.col("kind") == STYLE) & (n == 1), n)).alias("single"),
        F.count(only(CONTENT, n)).alias("contents"),
        F.sum(only(CONTENT, log)).alias("content_logs"),
        F.count(only(NAMED, n)).alias("names"),
    )
    styled, m = F.col("styled"), F.col("m")
    own = (
        F.when(F.col("names") > 0, 0.0)
        .when(F.col("contents") > 0, 1 - F.col("content_logs") / F.col("contents") / F.log(m))
        .otherwise(F.when(styled > 1, 1 - F.col("style_logs") / (styled * F.log(styled))).otherwise(1.0))
    )
    nodes = written(nodes.filter("m > 1").withColumn("own", own), folder, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0]
    done = None
    levels: list[DataFrame] = []
    for d in range(-1 if deepest is None else deepest, -1, -1):
        level = nodes.filter(F.col("depth") == d)
        below, most = F.lit(0.0), F.lit(0.0)
        if done is not None:
            sums = done.groupBy(F.col("parent").alias("_of")).agg(F.sum(F.col("m") * F.col("importance") / F.col("fan")).alias("_below"), F.max("most").alias("_most"))
            level = level.join(sums, level["node"] == sums["_of"], "left")
            below, most = F.coalesce("_below", F.lit(0.0)), F.coalesce("_most", F.lit(0.0))
        own_weight = 1 - F.pow(F.lit(DAMPING), F.col("styles").cast("double"))
        all_ = F.when(F.col("styles") > 0, own_weight * F.col("own") + (1 - own_weight) * (below + F.col("single")) / F.col("styled")).otherwise(F.col("own"))
        most = F.greatest(most, all_, F.when(F.col("single") > 0, 1.0).otherwise(0.0))
        done = written(level.select("node", "parent", "fan", "m", all_.alias("importance"), most.alias("most")), folder, f"level{d}")
        levels.append(done)
    if not levels:
        none = nodes.select("node", "m", F.col("own").alias("importance"), F.col("own").alias("most"))
        return none, values.select("value", F.lit(0).cast("long").alias("m"), F.lit(1.0).alias("importance")).limit(0)
    scored = levels[0]
    for x in levels[1:]:
        scored = scored.unionByName(x)
    texts = values.filter((F.col("kind") == CONTENT) & (n > 1)).select("node", "value", "n").join(nodes.select("node", "m"), "node")
    return scored.select("node", "m", "importance", "most"), texts.select("value", "m", (1 - F.log("n") / F.log("m")).alias("importance"))


class Noise:
    """Sorted ids in files by ranges of hosts, opened when first needed."""

    def __init__(self, folder: str, bits: int):
        self.there, self.bits, self.open = Folder(folder), bits, {}
        self.files = set(self.there.names("noise"))

    def hit(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        shard = _shard(ids, self.bits)
        for s in np.unique(shard).tolist():
            if f"noise/{s}" in self.files:
                if s not in self.open:
                    self.open[s] = self.there.mapped(f"noise/{s}").view("<i8")
                known, at = self.open[s], np.flatnonzero(shard == s)
                place = np.minimum(np.searchsorted(known, ids[at]), len(known) - 1)
                out[at] = known[place] == ids[at]
        return out


def _shard(ids: np.ndarray, bits: int) -> np.ndarray:
    return (ids.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)


def site_noise(pages: DataFrame, threshold: float = THRESHOLD, least: int = PAGES) -> tuple[str, int]:
    """pages (host, html). The shared folder with the ids of noise, and how many bits number its files."""
    folder = shared_folder(pages.sparkSession)
    nodes, texts = importances(page_facts(pages), folder)
    often = F.col("m") >= least
    ids = written(nodes.filter(often & (F.col("most") < threshold)).select(F.col("node").alias("id")).union(texts.filter(often & (F.col("importance") < threshold)).select("value")).distinct(), folder, "ids")
    bits = min(HOST_BITS, int(ids.count() // SHARD_ROWS).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_shard(b.column(0).to_numpy(), bits))], names=["id", "shard"])

    def build(shard: pa.Table) -> pa.Table:
        Folder(folder).write(f"noise/{shard.column('shard')[0].as_py()}", np.sort(shard.column("id").to_numpy()).astype("<i8").tobytes())
        return shard.slice(0, 1).select(["shard"])

    ids.mapInArrow(deal, "id long, shard long").groupBy("shard").applyInArrow(build, "shard long").count()
    return folder, bits


def judged(root: Node, place: Place) -> Iterator[tuple[Node | Text, int]]:
    """A page's parts but those that names drop, with the ids by which the tree may know them as noise: of their place, and of each text outside of articles."""
    for part, me, _, _, _, kind, values in walk(root, place):
        if kind != NAMED:
            yield part, me
        if kind == CONTENT and not part.up.content:
            yield part, values[0]


def main_text(root: Node, place: Place, noisy: dict[int, bool] | None = None) -> list[str]:
    """The blocks of the article in page order; noisy: ids of removed parts of the style tree."""
    bad = {id(part) for part, x in judged(root, place) if x in noisy} if noisy else set()
    named: list[str] = []
    kept: list[str] = []
    told = False  # whether the tree leaves what tells the page from the site's others: in an article more than headings
    stack: list[tuple[Node | Text, bool, bool]] = [(root, False, False)]
    while stack:
        part, noise, gone = stack.pop()
        up = part.up
        noise = noise or id(part) in bad
        if isinstance(part, Text):
            gone = gone or noise and not up.content
            if up.content or not (root.holds or part.linked and up.tag in ("li", "ul", "ol")):
                named.append(part.text)
                if not gone:
                    kept.append(part.text)
                told = told or not (noise or up.content and up.tag in HEADINGS)
        elif not part.drop:
            gone = gone or noise and not (up and up.content and " " not in part.sign)
            stack += [(k, noise, gone) for k in reversed(part.kids)]
    return kept if told else named


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **limits: float) -> DataFrame:
    """For each page: page_id, url, text (the article's blocks, a line each), n_chars."""
    pages = pick(pages, {"page_id": page_id, "url": url, "html": html}).withColumn("host", host_of(F.col("url")))
    folder, bits = site_noise(pages, **limits)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise, known = Noise(folder, bits), {}
        for b in small_batches(batches, "html"):
            some = [(parse(page or "", known)[0], Place(host)) for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)]
            found = [np.array([x for _, x in judged(root, place)] if noise.files else [], np.int64) for root, place in some]
            ids = np.unique(np.concatenate(found)) if found else np.array([], np.int64)
            ids = ids[noise.hit(ids)]
            texts = ["\n".join(main_text(root, place, dict.fromkeys(x[np.isin(x, ids)].tolist(), True))) for (root, place), x in zip(some, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(take, "page_id long, url string, text string, n_chars long")
