"""HTML main text with site style trees.

Pages of one host are merged to a style tree: a node is a path of container elements by tag, class and role. A node's
presentation importance is the entropy of its child sequences over the pages that have it, to the base of their number
(0: all pages alike, 1: each its own). Its content importance is 1 less the mean entropy of its blocks' texts over them
(0: on all pages, 1: each on one). Its importance is the mean of both and, on a page, the mean of that with what the
page says beforehand: 1 in an article or main element itself, 0.8 if named as content, 0.5 below an article or where the
page has none, less where a part of its name stands for something else, little outside the page's article. The tree's word has the weight of its
pages less one, the page's that of one page, so a node of one page has the page's word alone and no number of pages switches the tree on. A node below LOW
loses its blocks; a branch is as important as its most important node, so one of low nodes alone goes whole.

Copies of an article on many pages recur like a menu. So pages that share most of their text count as one in the tree: pages are told apart by three
blocks, drawn by hash with their length as weight. And where the tree would take more than half of what the page declares as its article, or
LARGER of a page without one, what recurs is the article, and stays.

Markup is read before the tree: scripts, styles, forms, hidden elements, nav, footer, aside and their roles are no
text, nor are elements whose class or id says nothing else than what is to go (ad, comments, cookie-notice); entropies
cannot tell readers' comments or fresh adverts from an article. Names never cut what holds the page's article. A form that holds the article, or most
of the page's text where there is none, is an element like any other.

Null or empty html, or a page without text: ''. Unclosed elements end with their parent; text after an unclosed
comment, tag, script or style is not text. A null or odd url: the host is ''. Repeated rows are pages of their own, but
count as one in the tree. A page that all this would leave empty keeps what markup and whole names do not cut.
Reading is linear in the page's length, however broken the page is.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, batch, ship, written

LOW = 0.3
#: The share of a page without an article that the tree may not take.
LARGER = 0.8
#: What a page says of a node: named as content, neutral, named in part as something else (below an article; on a page without one), outside the page's article.
NAMED, NEUTRAL, PARTLY, DOUBTFUL, OUTSIDE = 0.8, 0.5, 0.45, 0.35, 0.05

#: Elements and what they are.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
CUT = {"nav", "footer", "aside", "form", "head", "button", "select", "svg", "object", "canvas", "menu", "dialog", "audio", "video", "map"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "header", "ul", "ol", "table", "figure", "details", "dl", "center", "fieldset"} | CUT
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "blockquote", "pre", "address", "hr", "caption", "figcaption", "summary", "legend", "hgroup", "tbody", "thead", "tfoot"}
SPACED = {"br", "td", "th", "img", "option"}
NOISE = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus widget toolbar pagination pager skip copyright disclaimer search form".split())
CONTENT = set("article content story".split())
#: Words that make a header one of the article.
OWN_HEADER = CONTENT | set("post entry".split())
#: Words that say nothing by themselves of what an element holds.
GENERIC = set("this the us my site page box bar wrap wrapper container block area list links items section widget widgets module inner outer body left right top bottom main primary secondary slot unit posts articles stories topics id js col row panel group small large new".split())
OTHERS = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion related recommended recommendations comment comments commentlist reply replies respond".split())
#: Declared by names: in part by words of NOISE, by nothing else, or as content; and a form, whose text decides.
WEAK, STRONG, SAID, FORM = -1, -2, 2, -3
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation": 0, "banner": 0, "contentinfo": 0, "complementary": 0, "search": 0, "dialog": 0, "alert": 0, "alertdialog": 0, "menu": 0, "menubar": 0, "form": 0, "toolbar": 0, "main": 1, "article": 1}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_MODIFIER = re.compile(r"(?:has|no|with|without|tag)[-_]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def tags(page: str):
    """Text and tags in turn: (text before, slash, name, attributes); comments and declarations have no name, the last text has None for all. Linear: what is not found once is not sought again."""
    at, text, n, plain, find = 0, [], len(page), False, page.find
    while (k := find("<", at)) >= 0:
        text.append(page[at:k])
        if page.startswith("<!--", k):
            short = page.startswith("<!-->", k) or page.startswith("<!--->", k)
            ends = [e for e in ((find("-->", k + 2), 3), (find("--!>", k + 4), 4)) if e[0] >= 0] if not short else [(find(">", k), 1)]
            at = min(e + w for e, w in ends) if ends else n
            yield "".join(text), "", "", ""
            text = []
            continue
        if page.startswith(("<!", "<?"), k):
            end = find(">", k)
            at = end + 1 if end >= 0 else n
            yield "".join(text), "", "", ""
            text = []
            continue
        m = _NAME.match(page, k + 1)
        if not m:
            text.append("<")
            at = k + 1
            continue
        end, i = -1, m.end()
        if not plain:
            while q := _QUOTE_OR_END.search(page, i):
                if not q[1]:
                    end = q.start()
                    break
                i = find(q[1], q.end()) + 1
                if not i:
                    break
            plain = end < 0  # a quote that never ends: from here on tags end at the next >
        if plain:
            end = find(">", m.end())
        at = end + 1 if end >= 0 else n
        after = yield "".join(text), m[1], m[2].lower(), page[m.end() : end if end >= 0 else n]
        text = []
        if after:  # skip to the end tag of a raw element; with its name, no tag ends within
            raw = re.compile(rf"</{re.escape(after)}(?=[\s/>])", re.I).search(page, at)
            at = raw.start() if raw else n
            yield "", "", "", ""
    text.append(page[at:])
    yield "".join(text), None, None, None


def _declared(tag: str, attrs: str) -> tuple[str, int | None, bool]:
    return _known(tag, attrs) if len(attrs) < 300 else _known.__wrapped__(tag, attrs)


@lru_cache(50_000)
def _known(tag: str, attrs: str) -> tuple[str, int | None, bool]:
    """What identifies an element among its siblings, what it declares itself to be (0, 1, SAID, WEAK, STRONG, FORM, None), and whether it is an article or main element."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    classes = sorted(found.get("class", "").lower().split())
    role = found.get("role", "").strip().lower()
    names = classes + ([] if tag in HEADINGS else found.get("id", "").lower().split())
    names = [x for x in names if not _MODIFIER.match(x)]
    parts = [[w for w in _SPLIT.split(x) if w and not w.isdigit()] for x in names]
    words = {w for p in parts for w in p}
    name = f"{tag}.{'.'.join(classes)}#{role}"
    main = tag in ("article", "main") or ROLES.get(role) == 1
    if tag in ("html", "body"):
        return name, None, False
    if tag in CUT or "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "").lower()) or ROLES.get(role) == 0:
        plain = tag == "form" and not ("hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "").lower()) or ROLES.get(role) == 0)
        return name, FORM if plain else 0, main
    if main:
        return name, STRONG if tag != "main" and words & OTHERS else 1, True
    noise = NOISE if words & OWN_HEADER else NOISE | {"header"}
    if any(set(p) & noise and set(p) <= noise | GENERIC for p in parts):
        return name, STRONG, False
    if words & noise:
        return name, WEAK, False
    return name, SAID if words & CONTENT else None, False


class Node(list):
    """A container of a page: a list of its key in the host's tree, with what the page says of it. own: what it declares; cut: not text by markup or names; prior: what the page says of its importance; inside: below the page's article."""

    __slots__ = ("key", "parent", "own", "main", "style", "cut", "prior", "inside")

    def __init__(self, key: int, parent: int, own: int | None = None, main: bool = False):
        super().__init__([key])
        self.key, self.parent, self.own, self.main, self.style, self.cut, self.prior, self.inside = key, parent, own, main, [], own == 0, NEUTRAL, False


def _forms(nodes: list[Node], blocks: list[tuple[int, str]]) -> None:
    """A form that holds an article or main element, or most of the text of a page without one, is neutral; others are cut."""
    size, holds = [0] * len(nodes), [n.main for n in nodes]
    hard = [False] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        hard[i] = hard[n.parent] or n.own in (0, STRONG)
    for i, t in blocks:
        size[i] += 0 if hard[i] else len(t)
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i].parent] += size[i]
        holds[nodes[i].parent] |= holds[i] and not hard[i]
    for i, n in enumerate(nodes):
        if n.own == FORM:
            n.own = None if holds[i] or not holds[0] and 2 * size[i] > size[0] else 0
            n.cut = n.own == 0


def _settle(nodes: list[Node], names: list[str], blocks: list[tuple[int, str]]) -> None:
    """Names cut no article or main element and nothing that holds one, unless there is another that fewer of them are
    around: then it is a teaser or comment. What is left of them, and where the article is, gives the nodes' priors."""
    if any(n.own == FORM for n in nodes):
        _forms(nodes, blocks)
    strong = [0] * len(nodes)
    for i, n in enumerate(nodes[1:], 1):
        n.cut |= nodes[n.parent].cut
        strong[i] = strong[n.parent] + (n.own == STRONG)
    shown = [i for i, n in enumerate(nodes) if n.main and not n.cut]
    least = min((strong[i] for i in shown), default=0)
    free = {0}
    for i in shown:
        if strong[i] == least:
            nodes[i].own = 1
            while i not in free:
                free.add(i)
                if nodes[i].own in (WEAK, STRONG):
                    nodes[i].own = None
                i = nodes[i].parent
    outside = OUTSIDE if shown else NEUTRAL
    nodes[0].prior = outside
    for i, n in enumerate(nodes[1:], 1):
        above = nodes[n.parent]
        n.cut |= above.cut or n.own == STRONG
        if not n.cut:
            above.style.append(names[i])
        n.inside = above.inside or n.own == 1 and n.main
        if n.own == 1:
            n.prior = 1.0
        elif n.inside or not shown:
            n.prior = NAMED if n.own == SAID else (PARTLY if n.inside else DOUBTFUL) if n.own == WEAK else above.prior if above.prior < NEUTRAL else NEUTRAL
        else:
            n.prior = outside


@lru_cache(200_000)
def _path(parent: int, name: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(page: str, host: str = "") -> tuple[list[Node], list[tuple[int, str]]]:
    """The page's containers, the first of them the page itself, and its blocks of text, (container's place, text)."""
    nodes, names = [Node(_path(0, host), -1)], [""]
    blocks: list[tuple[int, str]] = []
    open_: list[tuple[str, int]] = [("", 0)]
    count: dict[str, int] = {}
    text: list[str] = []
    hidden: list[str] = []  # cut elements that are no containers of text, as <span hidden>
    soft = False  # they are cut by a name alone

    def close():
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if whole:
                blocks.append((open_[-1][1], whole))
                nodes[open_[-1][1]].style.append("#")

    source, raw = tags(page), None
    while True:
        before, slash, tag, attrs = source.send(raw)
        raw = None
        if before and not hidden:
            text.append(before)
        if tag is None:
            break
        if not tag:
            continue
        if slash:
            if tag in CONTAINERS:
                close()
                if count.get(tag):
                    while True:
                        shut = open_.pop()[0]
                        count[shut] -= 1
                        if shut == tag:
                            break
                    hidden.clear()
            elif tag in BLOCKS:
                close()
                hidden.clear()
            elif tag in SPACED:
                text.append(" ")
            if hidden and hidden[-1] == tag:
                hidden.pop()
            continue
        if tag in RAW:
            raw = tag
            continue
        if tag in CONTAINERS:
            close()
            if attrs.endswith("/") and tag == "svg":
                continue
            parent = open_[-1][1]
            name, own, main = _declared(tag, attrs)
            if tag == "header" and own is None and not any(nodes[k].main for _, k in open_):
                own = 0
            if main and soft:
                hidden.clear()
            nodes.append(Node(_path(nodes[parent].key, name), parent, own, main))
            names.append(name)
            open_.append((tag, len(nodes) - 1))
            count[tag] = count.get(tag, 0) + 1
        elif tag in BLOCKS:
            close()
            own = _declared(tag, attrs)[1] if attrs else None
            if own in (0, STRONG):
                hidden, soft = [tag], own != 0
            else:
                hidden.clear()
        elif tag in SPACED:
            text.append(" ")
        elif hidden:
            if hidden[-1] == tag:
                hidden.append(tag)
        elif attrs and tag not in ("input", "link", "meta", "img", "embed", "source", "a", "b", "i", "em", "strong") and (own := _declared(tag, attrs)[1]) in (0, STRONG):
            hidden, soft = [tag], own != 0
    close()
    _settle(nodes, names, blocks)
    return nodes, blocks


def _kept(nodes: list[Node], blocks: list[tuple[int, str]], importance: dict[int, tuple[float, int]]) -> str:
    low = []
    for n in nodes:
        e, pages = importance.get(n.key, (0.0, 1))
        low.append((n.prior + (n.prior + (pages - 1) * e) / pages) / 2 < LOW)
    # What the tree alone would take, inside the article if there is one, and all that stands there.
    article = any(n.inside and not n.cut for n in nodes)
    there = [(len(t), low[i]) for i, t in blocks if not nodes[i].cut and nodes[i].prior >= LOW and (nodes[i].inside or not article)]
    taken, all_ = sum(k for k, cut in there if cut), sum(k for k, _ in there)
    if taken > (0.5 if article else LARGER) * all_:
        low = [cut and not (n.prior >= LOW and (n.inside or not article)) for n, cut in zip(nodes, low)]
    return "\n".join(t for i, t in blocks if not (nodes[i].cut or low[i]))


def main_text(page: str | None, importance: dict[int, tuple[float, int]] = {}, host: str = "") -> str:
    """The text of a page's blocks without branches of low importance (node -> that in the host's tree, and its pages); where nothing is left, all that is not cut by markup or whole names."""
    nodes, blocks = parse(page or "", host)
    return _kept(nodes, blocks, importance) or "\n".join(t for i, t in blocks if not nodes[i].cut)


_STATS = pa.schema([("host_key", pa.int64()), ("page", pa.int64()), ("node", pa.int64()), ("kind", pa.int8()), ("value", pa.int64())])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _likeness(texts: list[str]) -> int:
    """A hash of three of the texts, each drawn by another hash with the lengths as weights: two pages that share a part s of their text draw the same with a chance of about s cubed."""
    best, drawn = [math.inf] * 3, [0] * 3
    for t in set(texts):
        raw = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=24).digest()
        for k, u in enumerate(struct.unpack("<3Q", raw)):
            rank = -math.log((u + 1) / (1 << 64)) / len(t)
            if rank < best[k]:
                best[k], drawn[k] = rank, u
    return _hash(repr(drawn))


def _page_stats(batches):
    """For each page and node that is not cut: its child sequence (kind 0) and block texts (kind 1), each once, and the page's likeness, which near copies share."""
    for rb in batches:
        out: list[tuple] = []
        for host, key, page in zip(*(rb.column(c).to_pylist() for c in ("host", "host_key", "html"))):
            nodes, blocks = parse(page or "", host)
            shown = [(nodes[i].key, _hash(t)) for i, t in blocks if not nodes[i].cut]
            same = _likeness([t for i, t in blocks if not nodes[i].cut])
            out += {(key, same, n.key, 0, _hash("|".join(n.style))) for n in nodes if not n.cut} | {(key, same, node, 1, t) for node, t in shown}
        yield batch(_STATS, [list(c) for c in zip(*out)] if out else [[]] * 5)


def importances(pages: DataFrame) -> DataFrame:
    """host_key, node, pages, presentation, content, importance of each node that two different pages of its host have. pages: host, host_key, html.

    presentation: entropy of the child sequences to the base of the pages. content: 1 less the mean, over the node's
    different blocks, of the entropy of the pages that hold the block; null without blocks. importance: their mean, or presentation alone.
    """
    stats = arrow_map(pages, _page_stats, "host_key long, page long, node long, kind byte, value long").distinct()
    counted = stats.groupBy("host_key", "node", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    style = F.col("kind") == 0
    of_node = counted.groupBy("host_key", "node").agg(
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.sum(F.when(style, F.col("n") * F.ln("n"))).alias("n_ln_n"),
        F.avg(F.when(~style, F.ln("n"))).alias("mean_ln"),
    )
    m = F.ln(F.col("pages").cast("double"))
    own = of_node.where(F.col("pages") > 1).select("host_key", "node", "pages", (1 - F.col("n_ln_n") / F.col("pages") / m).alias("presentation"), F.when(F.col("mean_ln").isNotNull(), 1 - F.least(F.lit(1.0), F.col("mean_ln") / m)).alias("content"))
    return own.withColumn("importance", F.when(F.col("content").isNull(), F.col("presentation")).otherwise((F.col("presentation") + F.col("content")) / 2))


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches):
    held, tree = object(), {}
    for rb in batches:
        out, trees = [], rb.column("tree")
        for i, (host, page) in enumerate(zip(rb.column("host").to_pylist(), rb.column("html").to_pylist())):
            if host != held:
                held, tree = host, {x["node"]: (x["importance"], x["pages"]) for x in trees[i].as_py() or ()}
            out.append(main_text(page, tree, host))
        yield batch(_TEXT, [rb.column("page_id"), rb.column("url"), out, [len(t) for t in out]])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page. Other columns are not kept. Empty table: no rows.

    A host's tree is one row, of the nodes that several of its pages have. It is written first, so that Spark
    knows its size: small ones are broadcast; else pages are joined by host, and those of a hot host are split by AQE, which only
    splits joins of plain exchanges.
    """
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host")).withColumn("host_key", F.xxhash64("host"))
    tree = written(importances(rows.select("host", "host_key", "html")).groupBy("host_key").agg(F.collect_list(F.struct("node", "importance", "pages")).alias("tree")), "trees")
    joined = rows.join(tree, "host_key", "left")
    return arrow_map(joined.select("page_id", "url", "html", "host", "tree"), _extract, "page_id long, url string, text string, n_chars long")


def op3_style_tree(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
