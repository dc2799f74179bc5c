"""Pages, archives, vectors."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest

from cadenza.llm import ann_search, html_extraction, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>"</script></head><body>
<header>Site name</header><nav><ul><li><a href="/">Home</a></ul></nav><!-- note --><div class="ad">Buy {n}</div><div class="cookie-notice">We use cookies</div>
<aside>Related {n}</aside><article><h1>Title&nbsp;{n}</h1><p>First  <b>bold</b>
 text &amp; more<br>line<p>Second &lt;tag&gt;<form><input>Send</form><ul><li>one<li>two</ul><section class="comments"><p>nice!</p></section></article>
<footer>&copy; foot {n}</footer></body></html>"""
SCHEMA = "page_id long, url string, html string, text string, host string, content string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(n=i)) for i in range(8)]
    rows += [(8, None, None), (9, "http://h0.example.com/9", ""), (10, "no url", "plain & <b>bold"), (10, "http://x/", "<p>" + "long " * 50_000), (None, "http://x/", PAGE.format(n=1)), rows[1]]
    return spark.createDataFrame([(*r, "t", "h", "c") for r in rows], SCHEMA)


def test_extraction(spark, pages):
    got = html_extraction.extract(pages.repartition(3)).collect()
    assert len(got) == 14
    by = {r.page_id: r.text for r in got if r.page_id != 10}
    assert by[3] == "Title 3\nFirst bold text & more line\nSecond <tag>\none\ntwo"
    assert by[8] == "" and by[9] == "" and by[None].startswith("Title 1")
    assert {r.n_chars for r in got if r.page_id == 10} == {len("plain & bold"), 50_000 * 5 - 1}
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_wrappers_are_union_free_and_find_templates(spark):
    more = {i: f"<p>more {i}</p>" * (i % 3) for i in range(6)}
    rows = [(i, "http://a.example/" + str(i), f"<body><div class='top'>Top line</div><div class='c'><p>text {i}</p>{more[i]}</div><div class='end'>Bottom line</div></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    w = html_extraction.infer_wrappers(df).collect()
    assert len(w) == 1 and w[0].host == "a.example" and w[0].pages >= html_extraction.TEMPLATE_PAGES
    assert {r.page_id: r.text for r in html_extraction.extract(df).collect()}[0] == "text 0"
    a = html_extraction.merge([["p", "1", [], None]], [["h2", "1", [], None], ["p", "1", [], None], ["p", "1", [], None]])
    assert [(x[0], x[1]) for x in a] == [("h2", "?"), ("p", "1")] or [(x[0], x[1]) for x in a] == [("h2", "?"), ("p", "+")]
    assert html_extraction.fold([[k, "1", [], None] for k in ("h2", "p", "h2", "p", "h2", "p")])[0][:2] == ["()", "+"]


def _texts(spark, htmls, parts=1):
    df = spark.createDataFrame([(i, "http://a.example/" + str(i), h) for i, h in enumerate(htmls)], "page_id long, url string, html string").repartition(parts)
    return {r.page_id: r.text for r in html_extraction.extract(df).collect()}


def test_nothing_inside_the_content_part_is_template(spark):
    page = "<body><p>Written by</p><article class='post-{0}'><h1>Same title</h1><div class='by'>Written by <b>author {0}</b></div><h2>Method</h2><p>text {0}</p><p>Same</p></article></body>"
    got = _texts(spark, [page.format(i) for i in range(4)])
    assert got == {i: f"Same title\nWritten by author {i}\nMethod\ntext {i}\nSame" for i in range(4)}
    page = "<body><div class='top'>Top line</div><h1>Title {0}</h1><h2>Method</h2><p>text {0}</p><div class='end'>Bottom line</div></body>"
    assert _texts(spark, [page.format(i) for i in range(6)]) == {i: f"Title {i}\nMethod\ntext {i}" for i in range(6)}


def site(rnd, host, pages, kind):
    """Pages of a host, made from a template, with their true main text."""
    word = lambda n: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    head, menu, foot = word(3), [word(1) for _ in range(5)], word(6)
    out = []
    for _ in range(pages):
        blocks, lines = [], []
        for k in range(rnd.randint(2, 9)):
            tag, text = rnd.choice(["p", "p", "p", "h2", "blockquote", "ul"]), word(rnd.randint(2, 30))
            if k == 0 or tag == "h2":
                tag, text = "h1" if k == 0 else "h2", rnd.choice(["Method", "Results", text]) if k else text
            blocks.append(f"<ul><li>{text}<li>{text} &amp; more</ul>" if tag == "ul" else f"<{tag}>{text}</{tag}>")
            lines += [text, f"{text} & more"] if tag == "ul" else [text]
        body = "".join(blocks)
        inner = {"article": f"<article>{body}</article>", "main": f"<main>{body}</main>", "div": f"<div class='c'>{body}</div>"}[kind]
        nav = "".join(f"<li><a href='/'>{m}</a></li>" for m in menu)
        out.append((f"http://{host}/{rnd.random()}", f"<html><head><title>{word(2)}</title></head><body><div class='brand'>{head}</div><nav><ul>{nav}</ul></nav><div class='ad'>{word(5)}</div>{inner}<div class='sidebar'>{word(4)}</div><div class='colophon'>{foot}</div></body></html>", "\n".join(lines)))
    return out


@pytest.mark.parametrize("broadcast", [16_000_000, 0])
def test_sites_with_known_articles(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(html_extraction, "SALT_PAGES", 10)
    rnd = random.Random(3)
    made = [x for host, pages, kind in (("hot.example", 120, "div"), ("a.example", 12, "article"), ("b.example", 12, "main"), ("c.example", 15, "div"), ("one.example", 1, "article")) for x in site(rnd, host, pages, kind)]
    df = spark.createDataFrame([(i, u, h, 7, "x") for i, (u, h, _) in enumerate(made)], "page_id long, url string, html string, n_chars int, __host2 string").repartition(5)
    got = {r.page_id: r for r in html_extraction.extract(df).collect()}
    assert {i: r.text for i, r in got.items()} == {i: t for i, (*_, t) in enumerate(made)}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_deep_and_wide_pages():
    deep = "<body><article>" + "<div>a" * 50_000 + "x" + "</div>b" * 50_000 + "<nav><p>menu</p></nav><p>end</p></article></body>"
    want = "\n".join(["a"] * 49_999 + ["ax"] + ["b"] * 50_000 + ["end"])
    assert html_extraction.main_text(deep) == want
    whole = [html_extraction.expression(html_extraction.parse(deep))]
    assert html_extraction.main_text(deep, html_extraction.places_of(html_extraction._packed(html_extraction.merge(whole, whole)), 2)) == want
    inside = "<article>" + "<div>" * 300 + "<nav><p>menu<b>x</b></p></nav>one<p>two <b>three</b> four</p>five" + "</div>" * 300 + "</article>"
    assert html_extraction.main_text(inside) == "one\ntwo three four\nfive"
    wide = "<article>" + "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(20_000)) + "</article>"
    e = html_extraction.expression(html_extraction.parse(wide))
    assert [x[:2] for x in e[2][0][2]] == [["()", "+"]]
    long_group = [[k, "1", [], None] for k in list("abcdefghij") * 3]
    assert [x[:2] for x in html_extraction.fold(long_group)] == [["()", "+"]]


def test_a_text_of_one_page_is_no_template(spark):
    page = "<body><div class='top'>Top line</div><div class='c'>{1}<i>text {0}</i></div><div class='end'>Bottom line</div></body>"
    once = {1: "<blockquote>Only here</blockquote>", 2: "<h2>Top line</h2>", 3: "<table><tr><td>cell</table>"}
    got = _texts(spark, [page.format(i, once.get(i, "")) for i in range(6)])
    assert got == {0: "text 0", 1: "Only here\ntext 1", 2: "Top line\ntext 2", 3: "cell\ntext 3", 4: "text 4", 5: "text 5"}


def test_copies_count_once_however_dealt_out(spark):
    page = "<body><script>track({1})</script><div class='top'>Top line</div><p>text {0}</p></body>"
    for parts in (1, 3):
        assert _texts(spark, [page.format(0, i) for i in range(6)], parts) == dict.fromkeys(range(6), "Top line\ntext 0")
        got = _texts(spark, [page.format(i % 2, 0) for i in range(7)], parts)
        assert got == {i: f"Top line\ntext {i % 2}" for i in range(7)}
    df = spark.createDataFrame([(i, "http://a.example/", page.format(i % 9, i)) for i in range(60)], "page_id long, url string, html string")
    one, many = (html_extraction.infer_wrappers(df.repartition(n)).collect() for n in (1, 7))
    assert one == many and one[0].pages == 9


def test_class_marks_are_whole_tokens():
    text = html_extraction.main_text
    for mark in ("layout has-sidebar", "with-banner", "no-comments", "nav-open", "widget", "overlay"):
        assert text(f"<body><div class='{mark}'><article><p>Real text</p></article></div><div>more</div></body>") == "Real text"
        assert text(f"<body><div id='{mark}'><main><p>Real text</p></main></div></body>") == "Real text"
    assert text("<article><p>a</p><section id='related-work'>b</section><p class='share-price'>c</p><div class='ad-2'>x</div><div class='big share'>x</div></article>") == "a\nb\nc"
    assert text("<body><div>The content of the page</div><div class='related'><article>teaser</article></div></body>") == "The content of the page"
    assert text("<body><main>The content of the page</main><div class='related_posts'><article>teaser</article></div></body>") == "The content of the page"


def test_warc_round_trip(pages, spark):
    got = warc.read_archives(warc.write_archives(pages.repartition(2), archive_bytes=4000)).collect()
    assert not [r for r in got if r.gap_reason] and len(got) == 14
    src = [(r.page_id, r.html or "") for r in pages.collect()]
    for r in got:
        same = [i for i, h in src if hashlib.sha256(h.encode()).hexdigest() == r.payload_digest]
        assert r.page_id in same
        if r.record_type == "revisit":
            assert r.refers_to == min(i for i in same if i is not None) != r.page_id and r.payload_bytes >= 100
        else:
            assert r.payload_bytes == len(r.payload) and r.refers_to is None
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    pay = [f"payload {i} ".encode() * 30 for i in range(30)]
    recs = [warc.record_bytes(i, f"http://x/{i} %", p, hashlib.sha256(p).hexdigest(), None, False) for i, p in enumerate(pay)]
    recs = [warc.member(r) for r in recs] if packed else recs
    rnd = random.Random(1)
    for _ in range(20):
        hurt = sorted(rnd.sample(range(30), 3))
        parts = []
        for i, r in enumerate(recs):
            b = bytearray(r)
            if i in hurt:
                k = rnd.randrange(12, len(b) - 8)
                b = b[: k // 2] if rnd.random() < 0.3 else b[:k] + b"\x1f\x8b\x08 WARC/1.1 junk" + b[k:]
            parts.append(bytes(b))
        s = warc.Salvage(b"".join(parts))
        found = {r["page_id"]: r for r in s.records()}
        assert set(range(30)) - set(hurt) <= set(found) and all(found[i]["payload"] == pay[i] for i in found)
        lost = sum(n for _, n, _ in s.gaps)
        assert sum(len(parts[i]) for i in range(30) if i not in found) <= lost <= sum(len(parts[i]) for i in hurt)
        assert all(r["url"].startswith("http://x/") for r in found.values())


def test_archive_files(spark, tmp_path):
    p = b"z" * 200
    rec = warc.record_bytes(5, "http://x/", p, hashlib.sha256(p).hexdigest(), None, False)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(rec) + b"garbage" + gzip.compress(rec))
    rows = warc.read_archives(warc.archive_files(spark, str(tmp_path))).collect()
    assert [r.page_id for r in rows if r.gap_reason is None] == [5, 5] and [r.gap_bytes for r in rows if r.gap_reason] == [7]


def brute(vectors, queries, k):
    out = {}
    for q, v in queries:
        s = sorted((-float(ann_search.exact(np.array(v), np.array([w]))[0]), i) for i, w in vectors if i != q)
        out[q] = [(i, -x) for x, i in s[:k]]
    return out


def test_search_recall_ties_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    x[100:400] = x[100]
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2001, [0.0] * 12), (2002, [math.nan] * 12), (2003, [1.0] * 11 + [math.inf]), (2004, [None] * 12), (2005, []), (2006, [1.0, 2.0]), (None, [1.0] * 12), good[7]]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann_search.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(good, [(i, v) for i, v in good if i % 50 == 0], 5)
    assert set(got) == set(want)
    hit = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.95 * 5 * len(want)
    assert [i for _, i, _ in sorted(got[300])] == [100, 101, 102, 103, 104] and [i for _, i, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    assert all([r for r, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    few = df.where("vec_id < 3")
    assert ann_search.search(few, few.where("vec_id = 0")).count() == 2
    assert ann_search.search(df.limit(0), df.limit(0)).count() == 0


def test_search_with_two_tiers_and_many_batches(spark, monkeypatch):
    """Second-tier cells, shards and query batches of a few rows give the same quality."""
    for name, value in (("FIRST_CELLS", 4), ("PIECE", 150), ("SHARD_ENTRIES", 40), ("QUERY_BATCH", 16), ("LOOK", 4)):
        monkeypatch.setattr(ann_search, name, value)
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(30, 16))
    x = (middles[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in good], "vec_id long, embedding array<float>, query string, score double").repartition(3)
    got = {}
    for r in ann_search.search(df, df.where("vec_id % 25 = 0")).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(good, [(i, v) for i, v in good if i % 25 == 0], 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)
    index = ann_search.Index.fit(x[:500].astype(float), 4).tiers(*(lambda c: (c, np.arange(40) % 4))(ann_search.k_means(ann_search.Index.unit(x[:500]), 40, 2, rng)))
    assert index.starts.tolist() == [0, 10, 20, 30, 40] and (index.assign(ann_search.Index.unit(x[:50])) < 40).all()


def test_queries_unlike_the_rows_and_vectors_that_nearly_agree(spark):
    """Queries far from all clusters find their neighbours; so do vectors whose cosines differ by less than an estimate in single precision tells."""
    rng = np.random.default_rng(9)
    apart = rng.normal(size=(50, 32))[rng.integers(0, 50, 4000)] + 0.1 * rng.normal(size=(4000, 32))
    apart[::50] = rng.normal(size=apart[::50].shape)
    for x in (apart, 1e4 + rng.normal(size=(4000, 32))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann_search.search(df, df.where("vec_id % 50 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        asked = np.arange(0, 4000, 50)
        scores = ann_search.exact(x[asked][:, None], x[None])
        scores[np.arange(len(asked)), asked] = -np.inf
        want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
        assert sum(len(got[int(q)] & set(w.tolist())) for q, w in zip(asked, want)) >= 0.95 * want.size


def test_very_small_and_very_large_components(spark):
    """Doubles whose squares vanish or overflow take part like others, with the same cosines."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    want = {}
    for size in (1.0, 1e-200, 1e200, 5e-324 * 2**60, 1e308 / 8):
        rows = [(i, (v * size).tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame([*rows, (100, [0.0] * 6), (101, [float("inf")] * 6)], "vec_id long, embedding array<double>")
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann_search.search(df, df.where("vec_id % 10 = 0")).collect()}
        want = want or got
        assert len(got) == 20 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(v[1] - want[k][1]) < 1e-12 for k, v in got.items())
    mixed = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e-200, 0.0]), (2, [0.0, 3.0]), (3, [1e-200, 1e-200])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, round(r.score, 9)) for r in ann_search.search(mixed, mixed.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1.0), (3, round(0.5**0.5, 9)), (2, 0.0)]
