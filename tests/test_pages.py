from credence.sources.pages import extract_pages, fallback_extract, good_pages, quarantined

SCHEMA = "page_id LONG, url STRING, html STRING"


def ex(spark, pages):
    return {r.page_id: r for r in extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}


def test_script_removed_before_lookup_and_entities(spark):
    html = ('<html><head><title> A &amp; B </title><script>var t="</p>";</script></head><body>'
            '<nav><p>menu</p></nav><header><h1>Head</h1></header>'
            '<article><h1>T</h1><p>One &quot;two&quot;</p><p>Three</p></article><footer>f</footer></body></html>')
    r = ex(spark, [(1, "https://Example.org:8080/a?b", html)])[1]
    assert r.title == "A & B"
    assert r.text == 'One "two"\n\nThree'
    assert r.domain == "example.org:8080"
    assert r.extraction_method == "paragraphs" and r.error is None


def test_empty_title_does_not_fall_back_to_h1(spark):
    r = ex(spark, [(1, "http://a.com", "<title></title><h1>Big</h1><p>x</p>")])[1]
    assert r.title == ""
    r = ex(spark, [(2, "http://a.com", "<h1>Big <b>one</b></h1><p>x</p>")])[2]
    assert r.title == "Big one"


def test_meta_tags(spark):
    html = ('<meta property="article:published_time" content=""><meta name="date" content="2020">'
            '<meta name="author" content=""><meta name="description" content="d &amp; e"><p>x</p>'
            '<img src="a.png"><img src="">')
    r = ex(spark, [(1, "http://a.com", html)])[1]
    assert r.publish_date == "" and r.authors == [""] and r.meta_description == "d & e"
    assert r.images == ["http://a.com/a.png", ""]


def test_fallback_without_paragraphs(spark):
    r = ex(spark, [(1, "http://a.com", "<article><div> x </div><span>y</span></article>")])[1]
    assert r.extraction_method == "paragraphs" and r.text == "x\n\ny"
    r = ex(spark, [(1, "http://a.com", "<article><h1> x <b>y</b></h1></article>")])[1]
    assert r.extraction_method == "fallback" and r.text == "x y"
    f = fallback_extract(spark.createDataFrame([(1, "u", "<p><b>a</b>b</p><p></p><p>c</p>")], SCHEMA)).first()
    assert f.text == "ab  c"


def test_errors_and_routing(spark):
    pages = [(1, "ftp://a.b", "<p>x</p>"), (2, "http://", "<p>x</p>"), (3, "HTTPS://A.com", "<p>x</p>"),
             (4, "a.com", "<p>x</p>"), (5, "http://a.com", "<div></div>"),
             (6, "http://b.com", "<p>" + "x" * (5 * 1024 * 1024) + "</p>")]
    r = ex(spark, pages)
    assert [r[i].error for i in (1, 2, 4)] == ["Invalid URL format"] * 3
    assert r[3].error is None and r[5].error == "No text found" and r[6].error == "Content too large"
    df = extract_pages(spark.createDataFrame(pages, SCHEMA))
    assert sorted(x.page_id for x in good_pages(df).collect()) == [3]
    assert good_pages(df).count() + quarantined(df).count() == len(pages)


def test_numeric_character_references(spark):
    import html
    from credence.sources.html import read_page
    texts = ["a&#65;b", "&#x263A; &#8217;s", "&amp;#65;", "x &#39;y&#39; &copy;", "no refs", "&#xZZ; &#0;"]
    assert [read_page(f"<p>{t}</p>")["primary"] for t in texts] == [html.unescape(t) for t in texts]


def test_error_routing_does_not_reevaluate_extraction(spark):
    """The fenced filter stays above the extraction: the plan reads each
    page exactly once, as the plain extraction does."""
    import os
    from conftest import SF
    pages = spark.read.parquet(os.path.join(SF, "pages.parquet"))
    plain = extract_pages(pages)._jdf.queryExecution().executedPlan().toString()
    routed = good_pages(extract_pages(pages))._jdf.queryExecution().executedPlan().toString()
    assert routed.count("ArrowEvalPython") == plain.count("ArrowEvalPython") > 0


def text_of(spark, html):
    return ex(spark, [(1, "http://a.com", html)])[1].text


def test_text_outside_paragraphs_is_kept(spark):
    html = ("<article><p>closed one</p><div>loose text outside p</div><p>closed two</p>"
            "<ul><li>item</li></ul></article>")
    assert text_of(spark, html) == "closed one\n\nloose text outside p\n\nclosed two\n\nitem"


def test_nested_article(spark):
    html = "<article><p>one</p><article><p>two</p></article><p>three</p></article><p>outside</p>"
    assert text_of(spark, html) == "one\n\ntwo\n\nthree"


def test_unclosed_paragraphs(spark):
    assert text_of(spark, "<article><p>one<p>two <b>bold</b><p>three</article>") == "one\n\ntwo bold\n\nthree"
    assert text_of(spark, "<p>one<p>two<div>no paragraph</div><p>three") == "one\n\ntwo\n\nthree"


def test_nested_and_unclosed_chrome(spark):
    html = "<nav>a<nav>b</nav>c</nav><article><p>text</p><script>never closed <p>x</p>"
    assert text_of(spark, html) == "text"


def test_large_page_of_unclosed_paragraphs_takes_seconds():
    import time

    from credence.sources.html import read_page

    for unit in ("<p>word ", "<article>", "<nav", "<script>", "<!--", "<title>"):
        page = unit * (5 * 1024 * 1024 // len(unit))
        t = time.time()
        got = read_page(page)
        assert time.time() - t < 60, unit
        if unit.startswith("<p>"):
            assert got["primary"].count("word") == len(page) // len(unit)


def test_all_images_on_the_primary_path(spark):
    imgs = "".join(f'<img src="i{i}.png">' for i in range(25))
    r = ex(spark, [(1, "http://a.com", f"<article><p>x</p>{imgs}</article>")])[1]
    assert r.extraction_method == "paragraphs" and len(r.images) == 25
    r = ex(spark, [(1, "http://a.com", f"<article><h1>only a heading</h1>{imgs}</article>")])[1]
    assert r.extraction_method == "fallback" and r.text == "only a heading" and len(r.images) == 10


def test_named_references(spark):
    assert text_of(spark, "<p>caf&eacute; &amp;lt; &#8364; &hellip;</p>") == "café &lt; € …"


def test_references_are_resolved():
    from credence.sources.html import read_page
    url = "https://news.example.org/a/b/page.html?x=1#top"
    page = """<html><head><meta name="keywords" content=" one, two ,,three "><link rel="image_src" href="//cdn.example.org/m.png"></head>
<body><article><p>Text here.</p><img src="../up.png"><img src="?q=2"><img src="/root.png"><img src="http://[bad">
<iframe src="https://www.youtube.com/embed/1"></iframe><iframe src="/ads.html"></iframe>
<video><source src="./film.mp4"><source src="./film.mp4"></video><source src="x.png"><embed src="//player.vimeo.com/v/2">
<object data="https://example.org/o.swf"></object></article><nav><img src="nav.png"></nav></body></html>"""
    r = read_page(page, url)
    assert r["images"] == ["https://news.example.org/a/up.png", "https://news.example.org/a/b/page.html?q=2",
                           "https://news.example.org/root.png", "http://[bad"]
    assert r["raw_images"][0] == "../up.png"
    assert r["top_image"] == "https://cdn.example.org/m.png"
    assert r["videos"] == ["https://www.youtube.com/embed/1", "https://news.example.org/a/b/film.mp4", "https://player.vimeo.com/v/2"]
    assert r["meta_keywords"] == ["one", "two", "three"]
    based = read_page('<base href="/deep/er/"><meta property="og:image" content="t.jpg"><p>x</p><img src="../i.png">', url)
    assert based["top_image"] == "https://news.example.org/deep/er/t.jpg" and based["images"] == ["https://news.example.org/deep/i.png"]
    assert read_page("<p>x</p><img src=i.png>", None)["images"] == ["i.png"] and read_page("<p>x</p>", url)["top_image"] == ""


def test_media_fields_of_both_extractors(spark):
    from credence.sources import pages as pg
    rows = [(1, "http://A.example:8080/x/y", "<meta property='og:image' content='t.png'><article><p>Body text.</p></article><img src=i.png>"),
            (2, "http://a.example/x", "<article></article><img src=i.png>"), (3, "ftp://a", "<p>x</p>")]
    got = {r.page_id: r for r in pg.extract_pages(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    assert (got[1].top_image, got[1].images, got[1].source_url) == ("http://A.example:8080/x/t.png", ["http://A.example:8080/x/i.png"],
                                                                    "http://A.example:8080")
    assert (got[2].top_image, got[2].videos, got[2].source_url, got[2].images) == ("", [], "", ["i.png"])
    assert got[3].error and got[3].images == []


def test_page_bytes():
    from credence.sources.html import decode_page
    for name, raw in (("latin", "<meta charset='iso-8859-1'>é€".replace("€", "").encode("latin-1")),
                      ("utf-16", "\ufeff<p>é</p>".encode("utf-16-le")), ("utf-16-be", "\ufeff<p>é</p>".encode("utf-16-be")),
                      ("plain", "<p>é</p>".encode()), ("mark", "\ufeff<p>é</p>".encode()), ("untagged latin", "<p>é</p>".encode("latin-1")),
                      ("wrong tag", "<meta charset=utf-16><p>é</p>".encode()), ("unknown", "<meta charset=klingon>é".encode()),
                      ("cyrillic", "<meta http-equiv=x content='text/html; charset=windows-1251'>é".replace("é", "ж").encode("cp1251"))):
        text = decode_page(raw)
        assert ("ж" if name == "cyrillic" else "é") in text and "\ufeff" not in text, name
    assert decode_page(None) == decode_page(b"") == "" and decode_page(b"<meta charset=windows-1252>\x93") [-1] == "\u201c"


def test_file_source_never_opens_large_pages(spark, tmp_path):
    from dataclasses import replace

    from credence.params import DEFAULT
    from credence.sources import pages as pg
    root = tmp_path / "crawl"
    files = {"a.example/n/one.html": "<article><p>Größe one.</p></article>".encode("latin-1"),
             "a.example/two.html": "\ufeff<article><p>Zwei.</p></article>".encode("utf-16-le"),
             "b.example/big.html": b"<p>" + b"x" * 5000, "b.example/notes.txt": b"no page", "c.example/empty.html": b""}
    for name, raw in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    params = replace(DEFAULT, max_content_size=1000)
    pages = pg.file_pages(spark, str(root), params, "*.html")
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan and "GreaterThan(length,1000)" in plan
    assert "ReadSchema: struct<path:string,length:bigint>" in plan  # large pages: a listing, no content
    got = {r.url: r for r in pg.extract_pages(pages, params).collect()}
    assert set(got) == {f"https://{n}" for n in files if n.endswith("html") and files[n]}
    assert got["https://a.example/n/one.html"].text == "Größe one." and got["https://a.example/two.html"].text == "Zwei."
    assert got["https://b.example/big.html"].error == "Content too large" and got["https://b.example/big.html"].text == ""
    assert len({r.page_id for r in got.values()}) == 3


def test_pages_are_read_in_slices():
    import tracemalloc
    import pyarrow as pa
    from credence.sources import pages as pg
    html, urls = ["<title>t</title><p>" + "word " * 2000 + "</p>", None] * 700, ["https://a.example/x", None] * 700
    tracemalloc.start()
    out = pg._read_pages.func(pa.array(html), pa.array(urls))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    from credence.sources.html import read_page
    assert out.to_pylist()[:2] == [read_page(h, u) for h, u in zip(html[:2], urls[:2])] and len(out) == 1400
    assert len(pg._read_pages.func(pa.array([], pa.string()), pa.array([], pa.string()))) == 0
    assert peak < 8e6, peak  # the records of all pages at once: 14 MB at least
