"""Chat views, HTML text and revisits."""

import os

import pytest

from corpusmill.llm import chat, html_text as h, queries, revisits

DATA = "/root/testdata/sf0.001"


def compare(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    df = queries.QUERIES[name](spark, DATA)
    result = c.execute(queries.SQL[name])
    names = [x[0] for x in result.description]
    want = sorted((tuple(r[names.index(k)] for k in df.columns) for r in result.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns) and sorted(map(tuple, df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    compare(spark, name)


def test_views(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, None, None, "x"), (1, 3, "ann", "bye")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, start int")
    views = {(r["conv_id"], r["speaker"]): r for r in chat.assembled(chat.rotated(df)).collect()}
    assert set(views) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = views[1, "ann"]
    assert ann["text"].startswith("<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user bob|>\n<|end|>\n")
    assert [ann["text"][a:b] for a, b in ann["masks"]] == ["hi < |end|><|end|>", "bye<|end|>", "bye<|end|>"]
    bob = views[1, "bob"]
    assert [bob["text"][a:b] for a, b in bob["masks"]] == ["<|end|>"] and bob["text"].count("<|user ann|>") == 3
    assert chat.rotated(df.limit(0)).count() == 0


def test_long_conversation_offsets(spark):
    df = spark.range(700).selectExpr("5L as conv_id", "id as turn", "if(id % 2 = 0, 'a', 'b') as role", "repeat('x', cast(id % 7 as int)) as text")
    for r in chat.assembled(chat.rotated(df)).collect():
        assert all(r["text"][b - len("<|end|>") : b] == "<|end|>" for _, b in r["masks"]) and len(r["masks"]) == 350


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("<!-- open", ""), ("a < b", "a < b"), ("<div>a<p>b", "a\nb"), ("<p hidden>x</p><p>y</p>", "y"),
    ("<main><p>q<script>var a='<p>';</script>r</p></main><p>z", "qr"),
    ("<article><h1>T</h1><div id='share-this'>s</div><p>a &amp;amp; b&nbsp; c</p><section class='comments'><p>no</p></section></article>", "T\na &amp; b c"),
    ("<nav>m</nav><header>h</header><article><p><b>one<br><p>two</article><aside>s</aside><form>f</form><div class='cookie-notice'>n</div><footer>f</footer>", "one\ntwo"),
])
def test_main_text(page, text):
    assert h.main_text(page) == text


def test_style_tree_cuts_what_recurs(spark):
    rows = [(i, f"http://Site.org/{i}", f"<body><div class='x'>Same line on all pages</div><div class='y'><p>Own text {i} here</p></div></body>", "z") for i in range(8)]
    rows += [(90, None, None, "z"), (91, "::", "<p>lone", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in h.extracted(df).collect()}
    assert all(got[i] == (f"Own text {i} here", len(f"Own text {i} here")) for i in range(8))
    assert got[90] == ("", 0) and got[91] == ("lone", 4)
    assert h.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<div class='{0}'><article><p>q</p></article><div class='sidebar'>s</div></div><p>z".format(c), "q") for c in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "header-sticky", "sidebar", "with-comments")
] + [
    ("<article class='post tag-social'><p>q</article><p>z", "q"), ("<main><article class='post social'><p>q</article></main><p>z", "q"), ("<div class='menu-wrap'><main class='social'>q</main></div>z", "q"),
    ("<article><h2 id='search-methods'>Search methods</h2><p>q</p><h3 class='related'>r</h3></article>", "Search methods\nq"), ("<ul><li class='header-sticky'><article>q</article></ul>z", "q"),
    ("<div class='no-sidebar'>q</div><div class='sidebar'>s</div>", "q"), ("<article class='comment'><header>h</header><p>q</article>", "h\nq"),
    ("<div class='sidebar-wrap'><article>q<div id='comments'><article class='comment-body'>c</article></div></article><section class='related'><article>r</article></section><div class='ad'>a</div></div>", "q"),
    ("<nav class='x'><article>n</article></nav><p>z", "z"),
])
def test_words_do_not_cut_the_article(page, text):
    assert h.main_text(page) == text


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://a.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in h.extracted(df).orderBy("page_id").collect()]


def test_style_tree_decides_inside_articles(spark):
    page = "<body><article><h1>Title {0}</h1><p>Own text {0}</p><div class='x'><p>Get our letter</p></div><div class='y'>Part {0}<figure>Logo</figure><ul>Links</ul><dl>Legal</dl></div><section class='content'>Same story</section></article><div>Out {0}</div></body>"
    assert texts(spark, [page.format(i) for i in range(8)]) == [f"Title {i}\nOwn text {i}\nPart {i}\nSame story" for i in range(8)]
    assert texts(spark, [page.format(i) for i in range(3)])[2] == "Title 2\nOwn text 2\nGet our letter\nPart 2\nLogo\nLinks\nLegal\nSame story"


def test_copies_keep_their_text(spark):
    page = "<html><body><div class='x'><p>Same text</p></div><div class='y'><p>{}</p></div></body></html>"
    for n in (3, 4, 9):
        assert texts(spark, [page.format("End") + f"<!-- {i} -->" for i in range(n)]) == ["Same text\nEnd"] * n
    assert h.main_text(page.format("End"), {n[0]: (0.0, 1000) for n in h.parse(page)[0]}) == "Same text\nEnd"


def test_revisits(spark):
    rows = [
        ("r1", "http://www.A.org/x/?utm_source=q#f", 1, False, {"etag": '"1"', "content-length": "9", "date": "d1"}),
        ("v1", "https://a.org/x", 2, True, {"etag": 'W/"1"', "date": "d2", "content-length": "0"}),
        ("r2", "http://a.org/x", 3, False, {"etag": '"2"'}), ("v2", "http://a.org/x", 3, True, {"etag": '"1"'}), ("v3", "http://a.org/x", 4, True, {"etag": '"1"'}),
        ("v4", "http://b.org/", 1, True, None), ("v5", None, 2, True, {}), ("v6", "http://a.org/x", 9, True, {}), ("v7", "http://a.org/x", None, True, {}),
    ]
    df = spark.createDataFrame(rows, "record_id string, url string, time long, revisit boolean, headers map<string,string>")
    got = {r["record_id"]: (r["source_id"], r["status"], r["headers"]) for r in revisits.resolved(df).collect()}
    assert got["v1"] == ("r1", "resolved", {"etag": 'W/"1"', "content-length": "9", "date": "d2"})
    assert got["v2"][:2] == ("r1", "resolved") and got["v3"][:2] == (None, "changed") and got["v6"][:2] == ("r2", "unvalidated")
    assert {got[k][1] for k in ("v4", "v5", "v7")} == {"orphan"}
    assert revisits.resolved(df.limit(0)).count() == 0


def test_read_warc(spark, tmp_path):
    import gzip

    def record(kind, url, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    raw = record("warcinfo", "", b"x") + record("response", "http://a/", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\nbody") + record("revisit", "http://a/", b"HTTP/1.1 304\r\nETag: \"1\"\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw) + b"")
    (tmp_path / "b.warc").write_bytes(raw[:-30])
    rows = revisits.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["revisit"] for r in rows) == [False, False, True]
    assert {bytes(r["payload"]) for r in rows if not r["revisit"]} == {b"body"} and rows[0]["headers"]["etag"] == '"1"'


def test_only_full_responses_are_sources(spark, tmp_path):
    def record(name, second, http, profile="", length=None):
        block = http + b"\r\nETag: \"1\"\r\n\r\nbody"
        head = f"WARC/1.1\r\nWARC-Type: {'revisit' if profile else 'response'}\r\nWARC-Target-URI: http://a/\r\nWARC-Record-ID: {name}\r\nWARC-Date: 2024-01-02T03:04:{second:02d}Z\r\n"
        head += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/{profile}\r\n" if profile else ""
        return head.encode() + (f"Content-Length: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"

    raw = record("full", 1, b"HTTP/1.1 200 OK") + record("odd", 2, b"HTTP/1.1 200 OK", length="x") + record("short", 2, b"HTTP/1.1 200 OK", length=9) + record("long", 2, b"HTTP/1.1 200 OK", length=10**6)
    raw += record("part", 3, b"HTTP/1.1 206 Partial") + record("same", 4, b"HTTP/1.1 304") + record("bad", 5, b"HTTP/1.1 503 Down") + b"stray line\r\n"
    raw += record("v1", 6, b"HTTP/1.1 304", "server-not-modified") + record("v2", 7, b"HTTP/1.1 200 OK", "identical-payload-digest")
    (tmp_path / "a.warc").write_bytes(raw)
    rows = revisits.read_warc(spark, str(tmp_path))
    assert [(r["record_id"], r["http_status"]) for r in rows.collect()] == [("full", 200), ("part", 206), ("same", 304), ("bad", 503), ("v1", 304), ("v2", 200)]
    assert {r["record_id"]: (r["source_id"], r["status"]) for r in revisits.resolved(rows).collect()} == {"v1": ("full", "resolved"), "v2": (None, "other_profile")}


def test_importances_against_plain_entropies(spark):
    import math
    import random
    from collections import Counter, defaultdict

    r = random.Random(8)
    pages = []
    for i in range(12):
        inner = "".join(f"<p>{r.choice('abcdef')}</p>" for _ in range(r.randint(1, 4)))
        pages.append(f"<body><div class='a'>{r.choice(['x', 'y'])}</div><article>{inner}<ul>{'<li>k</li>' * r.randint(1, 2)}</ul></article></body>")
    pages += pages[:3]
    styles, texts_, seen = defaultdict(Counter), defaultdict(Counter), set()
    for page in pages:
        nodes, blocks = h.parse(page, "a.org")
        same = h._likeness([t for _, t in blocks])  # pages alike count once with each child sequence and text
        for kind, where, value in [(0, n[0], tuple(n.style)) for n in nodes] + [(1, nodes[i][0], t) for i, t in blocks]:
            if (same, kind, where, value) not in seen:
                seen.add((same, kind, where, value))
                (texts_ if kind else styles)[where][value] += 1
    want = {}
    for node, c in styles.items():
        m = sum(c.values())
        if m < 2:
            continue
        pres = -sum(k / m * math.log(k / m, m) for k in c.values())
        content = 1 - sum(math.log(k, m) for k in texts_[node].values()) / len(texts_[node]) if texts_[node] else None
        want[node] = (m, pres, content, pres if content is None else (pres + content) / 2)
    df = spark.createDataFrame([("a.org", 7, p) for p in pages], "host string, host_key long, html string")
    got = {x["node"]: tuple(x)[2:] for x in h.importances(df).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


@pytest.mark.parametrize("page, text", [
    ("<div class='content'><p>intro</p></div><div class='text'><p>the long rest</p></div>", "intro\nthe long rest"),
    ("<article><p>a</p><div class='notice-period'>n</div><ul class='search-results'><li>r</ul></article>", "a\nn\nr"),
    ("<article>a<div class='cookie-notice'>c</div><div class='related-posts'>r</div></article>", "a"),
    ("<p class='x' class='ad'>a<p title='1 > 0'>b<a href=\"q>c</a>d", "a\nbcd"), ("x<!-->y<!-- a > b -->z<!--", "xyz"), ("a<a x", "a"), ("1 < 2 <3 </ 4", "1 < 2 <3 </ 4"),
])
def test_names_and_broken_markup(page, text):
    assert h.main_text(page) == text


def test_the_tree_overrules_what_stands_beforehand(spark):
    page = "<body><div class='news-footer-x'>{0}</div><main>Own {0}</main><section>Lead {0}{1}</section></body>"
    assert texts(spark, [page.format(i, "<p>more</p>" * i) for i in range(8)])[5] == "Own 5\nLead 5\n" + "\n".join(["more"] * 5)
    assert h.main_text(page.format(5, "")) == "Own 5"


@pytest.mark.parametrize("piece", ["<a x ", "<a x=\"> ", "<a b='>", "<!-- ", "<! ", "<div><p>a</section>", "</div x='", "<script>", "&amp", "<p hidden>"])
def test_long_broken_pages_take_linear_time(piece):
    import time

    began = time.process_time()
    h.main_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 20


SHARED = [f"Paragraph {k} of the story that all copies share, some words long." for k in range(30)]


def near_copies(n, wrap="<article><h1>Title {0}</h1><div class='body'>{1}</div></article>"):
    return [wrap.format(i, "".join(f"<p>{t}</p>" for t in [*SHARED, f"Line of copy {i} alone."])) for i in range(n)]


@pytest.mark.parametrize("n", [2, 5, 40])
def test_near_copies_keep_their_article(spark, n):
    assert texts(spark, near_copies(n)) == ["\n".join([f"Title {i}", *SHARED, f"Line of copy {i} alone."]) for i in range(n)]
    bare = "<h1>Title {0}</h1><div class='body'>{1}</div>"
    assert texts(spark, near_copies(n, bare)) == ["\n".join([f"Title {i}", *SHARED, f"Line of copy {i} alone."]) for i in range(n)]


@pytest.mark.parametrize("page, text", [
    ("<body><form id='aspnetForm' action='x'><div><article><h1>T</h1><p>a</p></article><aside>s</aside></div></form></body>", "T\na"),
    ("<body><form><div class='main-text'><p>The story that fills the page.</p></div></form><form><label>Mail</label></form></body>", "The story that fills the page."),
    ("<article><p>a</p><form><label>Your name, your mail, your town and whatever else</label></form></article>", "a"),
    ("<form><p>Mail us</p></form><article>a</article>", "a"), ("<form hidden><article>a</article></form><p>b", "b"),
    ("<div class='share-price-analysis'><p>Shares fell.</p></div>", "Shares fell."), ("<div id='form-of-government'><p>A republic.</p></div>", "A republic."),
    ("<article></article><div><p>Outside.</p></div><footer>f</footer>", "Outside."), ("<div class='comments'>c</div>", ""),
])
def test_forms_and_names_do_not_empty_a_page(page, text):
    assert h.main_text(page) == text


def test_random_hosts(spark):
    """Hosts built of recurring and own parts, with and without names: the text is what was put in as own."""
    import random

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for host in range(6):
        recurring = [f"<div class='k{k}'><p>{line(4)}</p><ul><li>{line(2)}<li>{line(2)}</ul></div>" for k in range(r.randint(1, 3))]
        declared = host % 2
        for p in range(r.randint(10, 14)):
            own = [line(r.randint(8, 25)) for _ in range(r.randint(2, 6))]
            body = f"<h1>{own[0]}</h1>" + "".join(f"<p>{t}</p>" for t in own[1:])
            middle = f"<article>{body}</article>" if declared else f"<div class='x'>{body}</div>"
            cut = r.randint(0, len(recurring))
            rows.append((len(rows), f"https://h{host}.net/{p}", f"<html><body>{''.join(recurring[:cut])}{middle}{''.join(recurring[cut:])}<script>{line(3)}</script></body></html>"))
            want[len(rows) - 1] = "\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {x["page_id"]: x["text"] for x in h.extracted(df).collect()} == want
    # By the page's word alone the recurring parts of pages without an article stay: it is the tree that takes them.
    assert sum(h.main_text(page) != want[i] for i, _, page in rows) > 25


def test_a_hot_host(spark):
    rows = [(i, f"http://big.org/{i}", f"<body><div class='m'>Menu of all pages</div><div><p>Own story number {i} with some words, {i * 7} of them.</p></div></body>") for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert {r["text"] for r in h.extracted(df).collect()} == {f"Own story number {i} with some words, {i * 7} of them." for i in range(1500)}


def test_likeness_tells_near_copies_from_pages_of_one_frame():
    import random

    r = random.Random(1)
    block = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    near = frame = 0
    for _ in range(200):
        body = [block(100) for _ in range(20)]
        near += h._likeness([*body, block(60)]) == h._likeness([*body, block(60)])
        frame += h._likeness([body[0], *[block(100) for _ in range(5)]]) == h._likeness([body[0], *[block(100) for _ in range(5)]])
    assert near > 150 and frame < 20
