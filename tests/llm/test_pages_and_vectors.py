import gzip
import io
import os
import re
from collections import Counter

import numpy as np
import pytest

from srclens.llm import arc, dom, embedding_dedup, html_extract, warc, wrapper

SHELL = "<html><head><title>T</title><style>p{}</style></head><body><div class='top-menu'><a>Home</a></div><div id=main class=page>%s</div><div class=foot-note>same words on all</div></body></html>"


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, id int")
    return {x["page"]: x["text"] for x in html_extract.extract(df).collect()}


def test_wrapper_of_a_host(spark):
    rows = [(i, f"https://h.org/{i}", SHELL % f"<h1>Title {i}</h1><p>First &amp; {i}\n  line<p class=share>Share this page<p>more {i}") for i in range(4)]
    got = texts(spark, rows)
    assert got == {i: f"Title {i}\nFirst & {i} line\nmore {i}" for i in range(4)}


def test_markup_alone(spark):
    article = "<article><header><h1>A&nbsp;b</h1></header><p>x <b>y</b><br>z<script>no()</script><ul><li>1<li>2</ul><aside>no</aside><div class='ad'>no</div><table><tr><td>c<td>d</table><form>no<input></form><footer>no</footer>tail &copy &#233; &lt;i&gt;</article>"
    html = f"<nav>no</nav><header>no</header>{article}<section id=comments><p>no</section><footer>no"
    assert texts(spark, [(1, None, html), (2, "u", None), (3, "u", ""), (4, "v", "plain <!-- c --> text"), (5, "https://one.org", html)]) == {
        1: "A b\nx y z\n1\n2\nc\nd\ntail © é <i>",
        2: "",
        3: "",
        4: "plain text",
        5: "A b\nx y z\n1\n2\nc\nd\ntail © é <i>",
    }


def test_copies_and_empty_table(spark):
    page = "<body><nav>m</nav><article><h1>T</h1><p>same</p></article><footer>f</footer></body>"
    assert texts(spark, [(i, "http://h.net/", page) for i in range(3)]) == {i: "T\nsame" for i in range(3)}
    assert texts(spark, []) == {}


def test_two_layouts_of_a_host(spark):
    def long(i):
        return f"<body><div class=menu>m</div><div class=a><p>{f'long {i} ' * 30}</p></div></body>"

    def short(i):
        return f"<body><div class=menu>m</div><article><p>short {i}</p></article></body>"

    rows = [(i, "http://h.org/", long(i)) for i in range(9)] + [(i, "http://h.org/", short(i)) for i in range(9, 13)]
    got = texts(spark, rows)
    assert got == {i: f"long {i} " * 29 + f"long {i}" if i < 9 else f"short {i}" for i in range(13)}
    # a page copied often does not choose the slot of the other pages
    rows = [(i, "http://h.org/", "<body><div><p>copied</p></div></body>") for i in range(200)]
    rows += [(i, "http://h.org/", f"<body><div></div><article><p>page {i}</p></article></body>") for i in range(200, 204)]
    got = texts(spark, rows)
    assert got == {i: "copied" if i < 200 else f"page {i}" for i in range(204)}


def test_copies_among_other_pages(spark):
    page = "<body>%s<article><h1>T</h1><p class=lead>Lead</p><p>Text of some length, as articles have it</p><div class=quote>Quote</div></article><div>%s</div></body>"
    rows = [(1, "http://h.org/a", page % ("", "")), (2, "http://h.org/a?b", page % ("", "")), (3, "http://h.org/c", page % ("<div class=ad>no</div>", "")), (4, "http://h.org/d", page % ("", "May"))]
    rows += [(i, "http://h.org/", f"<body><article><h1>T {i}</h1><p>Text {i}</p></article></body>") for i in range(5, 9)]
    got = texts(spark, rows)
    assert [got[i] for i in range(1, 5)] == ["T\nLead\nText of some length, as articles have it\nQuote"] * 4
    assert [got[i] for i in range(5, 9)] == [f"T {i}\nText {i}" for i in range(5, 9)]


@pytest.mark.parametrize("part", [1024, 20])
def test_many_skeletons_of_a_host(spark, monkeypatch, part):
    monkeypatch.setattr(html_extract, "PART", part)

    def page(i):
        shape = "".join(f"<{t}>x{i}</{t}>" for k, t in enumerate(("h2", "h3", "h4", "h5", "h6", "pre", "dl", "hgroup", "address")) if i >> k & 1)
        return f"<body><div class=top>Site</div><article><h1>T {i}</h1><p class=note>Note of all</p>{shape}</article></body>"

    rows = [(i, "http://h.org/", page(i)) for i in range(257)]
    got = texts(spark, rows)
    assert got == {i: "\n".join([f"T {i}"] + [f"x{i}"] * i.bit_count()) for i in range(257)}


def test_constant_blocks_without_class(spark):
    page = "<body><article><h1>T %d</h1>%s<p>Text %d</p><p>All rights reserved</p><div>Write to our letter</div><div id=box>Box</div><h3>More</h3></article></body>"
    rows = [(i, "http://h.org/", page % (i, "<p>Own</p>" * (i % 3) + f"<p>New {i}</p>" * (i % 2), i)) for i in range(8)]
    assert texts(spark, rows) == {i: "\n".join([f"T {i}", *["Own"] * (i % 3), *[f"New {i}"] * (i % 2), f"Text {i}"]) for i in range(8)}


def boilerplate(i):
    """A page whose menu, notice, sidebar and footer are plain boxes, and whose article has names that only mention such things."""
    head = "<div><p>Home About Contact</p></div><div><div>We use cookies</div></div>"
    text = f'<h1>T {i}</h1><p class="alert-text">Alert {i}</p><div class="tags-intro">Tags {i}</div><p id="comment-law">Law {i}</p><p>Long text of page {i} and more of it</p>'
    return f"<body>{head}<article>{text}<p>Read our letter</p></article><div><ul><li>Latest</li><li>Oldest</li></ul></div><div>All rights</div></body>"


def test_induction_takes_what_no_list_names(spark):
    rows = [(i, "http://h.org/", boilerplate(i)) for i in range(20)]
    want = {i: f"T {i}\nAlert {i}\nTags {i}\nLaw {i}\nLong text of page {i} and more of it" for i in range(20)}
    assert texts(spark, rows) == want
    alone = {i: "\n".join(t for _, noise, t in dom.parse(h).blocks if not noise) for i, _, h in rows}
    assert all(len(alone[i]) > len(want[i]) for i in want)  # markup and names alone don't give it


def test_lists_change_no_page_of_a_host_with_several(spark):
    """On hosts of several pages the wrapper finds the same text of the test pages without any list of elements and names."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    unnamed = [(i, u, re.sub(r"<(/?)(nav|footer|aside)\b", r"<\1div", h or "").replace('class="ad"', "")) for i, u, h in pages]
    assert any("<nav" in h for *_, h in pages) and not any("<nav" in h or "<footer" in h for *_, h in unnamed)
    of = {i: re.sub("^[a-z]+://([^/]*).*$", r"\1", u) for i, u, _ in pages}
    size = Counter(of[i] for i in {h: i for i, _, h in pages}.values())
    several = {i for i in of if size[of[i]] >= 5}
    got, want = texts(spark, unnamed), texts(spark, pages)
    assert len(several) > 90 and [i for i in several if got[i] != want[i]] == []


def test_without_the_wrapper_most_pages_change(spark, monkeypatch):
    """What induction says of a host's menus, sidebars and footers takes them out, not the lists."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    want, whole = texts(spark, pages), html_extract.wrappers
    monkeypatch.setattr(html_extract, "wrappers", lambda stats, ws: whole(stats, ws).where("false"))
    got = texts(spark, pages)
    of = {i: re.sub("^[a-z]+://([^/]*).*$", r"\1", u) for i, u, _ in pages}
    size = Counter(of[i] for i in {h: i for i, _, h in pages}.values())
    several = [i for i in of if size[of[i]] >= 3]
    assert len(several) > 90 and sum(got[i] != want[i] for i in several) > 0.9 * len(several)


def test_names_decide_where_a_named_text_varies(spark):
    page = "<body><nav>Home About</nav><article><h1>T %d</h1><p>Text %d</p><aside>See also %d</aside><div class='sidebar'>Own %d</div><footer>Same on all</footer></article><footer>(c) all</footer></body>"
    rows = [(i, "http://h.org/", page % (i, i, i, i)) for i in range(6)] + [(9, "http://one.org/", page % (9, 9, 9, 9))]
    assert texts(spark, rows) == {i: f"T {i}\nText {i}" for i in (*range(6), 9)}


def test_long_pages_ties_and_clashing_columns(spark):
    long = "<body><article><h1>L</h1>" + "".join(f"<p>part {k} of a long page</p>" for k in range(20_000)) + "</article><div>foot</div></body>"
    two = [f"<body><div><p>{w} one</p></div><div><p>{w} two</p></div></body>" for w in ("a", "b", "c")]  # equal masses
    got = texts(spark, [(1, "http://l.org/", long), *((i + 2, "http://t.org/", h) for i, h in enumerate(two)), (2, "http://t.org/", two[0])])
    assert got[1] == "\n".join(["L", *(f"part {k} of a long page" for k in range(20_000))])
    assert [got[i] for i in (2, 3, 4)] == ["a one\na two", "b one\nb two", "c one\nc two"]


def test_names_that_mention():
    assert all(dom.names_noise(v) for v in ("ad", "ad-box", "x comments", "cookieNotice", "site-footer", "nav_menu top"))
    assert not any(dom.names_noise(v) for v in ("", "alert-text", "tags-intro", "comment-law", "adage", "page-header", "post"))


def test_broken_html():
    for source in ("<", "</", "<a", "<p>a<p", "a<b>c</d></b>", "<!-- open", "<script>x", "<p title='a>b", "<" * 50, "<div>" * 3000 + "deep", "<p a=\"1\" b='>'>t"):
        page = dom.parse(source)
        assert all(0 <= n < len(page.sig) for n, _, _ in page.blocks)
    assert dom.parse("<div>" * 3000 + "deep").blocks[0][2] == "deep" and dom.parse("1 < 2 & 3").blocks == [(0, False, "1 < 2 & 3")]


def test_a_wrapper_is_a_skeleton():
    whole = wrapper.Wrapper()
    whole.add(1, "-1 html\n0 div\n1 p", {2: (3, 30, 3, [(7, 3)])}, 3)
    whole.add(2, "-1 html\n0 h1\n0 div\n2 p\n2 ul", {3: (1, 5, 1, [(7, 1)])}, 1)
    text, place = whole.skeleton()
    assert [n.sig for n in wrapper.tree(text)] == ["html", "h1", "div", "p", "ul"] and whole.weight == 4
    of = {name: [place[i] for i in of] for name, _, of in whole.added()}
    assert of == {1: [0, 2, 3], 2: [0, 1, 2, 3, 4]}
    p = whole.nodes[place.index(3)]
    assert (p.pages, p.chars, p.texts[7]) == (4, 35, 4)


def test_tree_matching():
    a = wrapper.tree("-1 html\n0 div\n1 p\n0 ul\n3 li")
    b = wrapper.tree("-1 html\n0 h1\n0 div\n2 p\n0 ul\n4 li")
    assert wrapper.match(a[0], b[0], {}) == 25
    into = {}
    wrapper.merge(a[0], b[0], into, {})
    assert [n.sig for n in a[0].walk()] == ["html", "h1", "div", "p", "ul", "li"]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_and_warc_records(version):
    content = [arc.http_block("7", b"x\r\n\r\nWARC/1.1\r\nfiledesc://"), arc.http_block(None, b"")]
    data = arc.arc_block(version, "a.arc", warc.DATE) + b"\n" + b"".join(arc.arc_record(version, "a.arc", "http://a b/é", warc.DATE, c, 0) + b"\n" for c in content)
    zipped = b"".join(gzip.compress(data[i : i + 50]) for i in range(0, len(data), 50))
    for raw in (data, zipped):
        got = list(arc.read_arc(arc.stream(raw)))
        assert [c for _, c in got] == content and got[0][0]["URL"] == "http://a%20b/é" and list(got[0][0]) == arc.FIELDS[version]
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(data[:-30])))
    record = arc.warc("response", [("WARC-Target-URI", "u")], content[0]) + b"\n"
    assert [b for _, b in arc.read_warc(io.BytesIO(record * 2))] == [content[0]] * 2
    with pytest.raises(ValueError):
        list(arc.read_warc(io.BytesIO(record.replace(b"fields", b"fields").replace(b"filedesc", b"filedesk"))))
    assert arc.iso("1996") == "1996-01-01T00:00:00Z" and arc.iso("19960923142103") == "1996-09-23T14:21:03Z"


def test_round_trip(spark):
    rows = [(5, None, "x" * 200), (3, "http://a b/é\n", "x" * 200), (None, "u", "x" * 200), (3, "u", "x" * 200), (7, "q", None), (8, "q", None), (None, "z", "WARC/1.1\r\n\r\n\r\n" * 30), (9, "y", "é" * 50), (10, "y", "é" * 50), (11, "y", "s" * 99), (12, "y", "s" * 99)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted(((x["page"], x["payload_bytes"], x["record_type"], x["refers_to"]) for x in warc.round_trip(df).collect()), key=repr)
    assert got == sorted([(5, 200, "revisit", 3), (3, 200, "response", None), (3, 200, "response", None), (None, 200, "revisit", 3), (7, 0, "response", None), (8, 0, "response", None), (None, 420, "response", None), (9, 100, "response", None), (10, 100, "revisit", 9), (11, 99, "response", None), (12, 99, "response", None)], key=repr)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_round_trip_of_any_ids(spark):
    """Ids outside ASCII, with white space, empty, and such as look like a mark of none."""
    ids = ["é", "-", "", "a b", "x\ty\r\n", "日本", None, "%41", "A"]
    rows = [(p, "http://é.org/ü ä", ("same payload " * 20) if i % 2 else f"own {i}") for i, p in enumerate(ids)]
    got = {x["page"]: (x["payload_bytes"], x["record_type"], x["refers_to"]) for x in warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    least = min(p for i, p in enumerate(ids) if i % 2)
    assert got == {p: (260, "response" if p == least else "revisit", None if p == least else least) if i % 2 else (5, "response", None) for i, p in enumerate(ids)}


def test_more_records_than_an_archive_holds(spark):
    df = spark.range(2500).selectExpr("id as page_id", "'u' as url", "concat('page ', id) as html").coalesce(1)
    assert warc.round_trip(df).where("record_type = 'response'").count() == 2500


def test_vectors_of_extreme_lengths(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [-1e200, 1e-200]), (5, [5e-324, 5e-324])]
    got = {x["vec"]: (x["n_links"], x["component"]) for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    df = spark.range(50).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 4000) as html").coalesce(1)
    warc.write_arc(df, f"file://{tmp_path}/arc")
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    for kind in ("arc", "warc"):
        sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / kind).glob("*/part-*")]
        assert len(sizes) > 10 and max(sizes) < 45_000
    assert warc.read(spark, f"file://{tmp_path}/warc").count() == 50


def test_one_long_page_leaves_the_others_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 8 << 20)
    df = spark.range(61).selectExpr("id as page_id", "'u' as url", "if(id = 7, repeat('x', 9000000), concat('page ', id)) as html").coalesce(1)
    warc.write_arc(df, f"file://{tmp_path}/arc")
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    assert [len(list((tmp_path / k).glob("*/part-*.gz"))) for k in ("arc", "warc")] == [2, 2]
    assert warc.read(spark, f"file://{tmp_path}/warc").count() == 61


def test_very_long_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3, 20_000))
    rows = [(i, [float(v) for v in x[i % 3] + r.normal(size=20_000) * 0.1]) for i in range(6)]
    got = {v["vec"]: (v["n_links"], v["component"]) for v in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1, i % 3) for i in range(6)}


def vectors_brute(rows, cosine):
    ok = {i: np.array(v, float) for i, (d, v) in enumerate(rows) if d is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i in range(len(rows))}
    for i, x in ok.items():
        for j, y in ok.items():
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i].add(j)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((d, len(links[i]), None if d is None else min(rows[j][0] for j in seen)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    r = np.random.default_rng(block)
    base = r.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in base[i % 6] + r.normal(size=8) * (0.05 if i % 2 else 0.35)]) for i in r.permutation(70)]
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0, None] + [0.0] * 6), (104, [float("nan")] * 8), (105, [float("inf")] * 8), (106, [1.0, 2.0]), (107, [2.0, 4.0]), (None, rows[0][1]), (rows[1][0], rows[1][1]), (108, rows[1][1]), (109, [2 * x for x in rows[2][1]])]
    df = spark.createDataFrame([(d, v, 1, "c") for d, v in rows], "vec_id long, embedding array<float>, key int, component string")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted(((x["vec"], x["n_links"], x["component"]) for x in got), key=repr) == vectors_brute(rows, 0.9)
    assert all(x["kept"] == (x["vec"] is None or x["vec"] == x["component"]) for x in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_recall_of_pairs_at_the_threshold(spark):
    r = np.random.default_rng(4)
    n, d = 1500, 32
    x = r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = r.normal(size=(n, d))
    y -= (x * y).sum(1)[:, None] * x
    y = 0.905 * x + (1 - 0.905**2) ** 0.5 * y / np.linalg.norm(y, axis=1)[:, None]
    rows = [(int(i), [float(v) for v in z]) for i, z in enumerate(np.concatenate([x, y]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").count()
    assert got / (2 * n) > 0.93


def test_recall_in_a_dense_cone(spark):
    r = np.random.default_rng(8)
    n, d, mean, pairs = 8000, 64, 0.75, 500
    x = r.normal(size=(n + pairs, d))
    x[:, 0] = 0
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = (0.92 - mean) / (1 - mean)
    v = x[n:] - (x[n:] * x[:pairs]).sum(1)[:, None] * x[:pairs]
    x[n:] = q * x[:pairs] + (1 - q * q) ** 0.5 * v / np.linalg.norm(v, axis=1)[:, None]
    x *= (1 - mean) ** 0.5
    x[:, 0] = mean**0.5
    x[n // 2 : n] = r.normal(size=(n - n // 2, d))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = int((unit @ unit.T >= 0.9).sum()) - len(x)
    assert links >= 2 * pairs
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df).groupBy().sum("n_links").collect()[0][0]
    assert 0.95 * links < got <= links
