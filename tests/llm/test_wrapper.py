"""Wrapper induction: regions, tree matching, kept and dropped blocks, odd pages."""

from geoloom.llm import wrapper as wr


def page(k, extra="", body="div class='post'"):
    tag = body.split()[0]
    return (
        f"<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style></head><body><div id=top><p>Welcome to the site, always the same words</p></div>"
        f"<ul class='menu'><li>Home {k}<li>About</ul><{body}><h2>Title {k}</h2><p>First {k} paragraph &amp; more\n text<p>Second <b>bold {k}</b><br>line</p>{extra}</{tag}>"
        f"<div class='side'><p>Fixed words on every page of this host, and rather many of them</p></div><footer>end {k}</footer></body></html>"
    )


def text(k):
    return f"Title {k}\nFirst {k} paragraph & more text\nSecond bold {k} line"


def test_template_is_left_out(spark):
    pages = [(k, "http://a.org/x", page(k)) for k in range(6)]
    got = {r.page_id: r.text for r in wr.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: text(k) for k in range(6)}


def test_dropped_parts():
    extra = (
        "<div class='ad-box'>buy</div><section id='comments'><p>nice</p></section><form><p>name<input></form><script>var a='<p>x</p>';</script>"
        "<aside>more</aside><p>Third <span class='share'>tweet</span>&lt;end&gt;</p><!-- gone --><ul><li>one<li>two</ul>"
    )
    assert wr.main_text(page(1, extra, "article"), None) == text(1) + "\nThird <end>\none\ntwo"


def test_odd_pages():
    assert wr.main_text(None, None) == "" and wr.main_text("", ["#"]) == ""
    assert wr.main_text("plain  text\n only", None) == "plain text only"
    assert wr.main_text("<article><p>a<p>b<p", None) == "a\nb"
    assert wr.main_text("<article><p>1 < 2 &am &copy", None) == "1 < 2 &am ©"
    assert wr.main_text("<article></p><p>x</div></article>", None) == "x"
    deep = "<div>" * 5000 + "<p>far</p>in<p>side" + "</div>" * 5000 + "<p>after"
    assert wr.main_text(deep, None).split("\n") == ["far", "in", "side", "after"]
    assert wr.region(wr.reduced(wr.parse(deep)), False)


def test_matching_and_merging():
    one, two = (wr.reduced(wr.parse(h)) for h in ("<div><p>a</p><h1>t</h1></div>", "<div><h1>t</h1><ul><li>x</ul><p>b</p></div>"))
    assert wr.match(one, two) == 1 + 1 + 2  # root, div, and the constant heading rather than a paragraph
    merged = wr.merge(one, two)
    assert [k.mark for k in merged.kids[0].kids] == ["p", "h1", "ul", "p"] and merged.pages == 2


def test_one_page_hosts_and_columns(spark):
    rows = [(1, None, page(1, body="article"), "c"), (1, None, page(1, body="article"), "c"), (2, "x", None, "d")]
    got = wr.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, text(1)), (1, text(1)), (2, "")]


def wordy(k, n=12):
    return " ".join(f"word{k * n + i}" for i in range(n))


def regions(pages, spark):
    rows = [(k, "http://b.org/x", h) for k, h in enumerate(pages)]
    got = wr.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_region_among_siblings_of_one_mark(spark):
    top = "<div id=top><p>Welcome to this site</p><p>same words</p></div>"
    for a, b in (("id=x", "id=content"), ("class='col-4'", "class='col-8'")):
        first = top.replace("id=top", a)
        pages = [f"<body>{first}<div {b}><p>{wordy(k)}</p><h2>t{k}</h2></div></body>" for k in range(5)]
        pages.append(f"<body><div><p>Only here</p><h3>x</h3></div>{first}<div {b}><p>{wordy(9)}</p><h2>t9</h2></div></body>")
        assert [t.split("\n")[-2:] for t in regions(pages, spark)] == [[wordy(k), f"t{k}"] for k in (0, 1, 2, 3, 4, 9)]
        assert all("Welcome" not in t for t in regions(pages[:5], spark))


def test_two_content_blocks_of_one_mark(spark):
    def block(k):
        return f"<div class='post'><h2>t{k}</h2><p>{wordy(k)}</p></div>"

    pages = [f"<body><p>Same line</p>{block(k)}</body>" for k in range(30)] + [f"<body><p>Same line</p>{block(40)}{block(41)}</body>"]
    got = regions(pages, spark)
    assert got[-1] == f"t40\n{wordy(40)}\nt41\n{wordy(41)}" and got[0] == f"t0\n{wordy(0)}"


def test_words_do_not_drop_article_text():
    body = f"<article><p>{wordy(1)}</p></article>"
    for whole in (f"<div id=page class='has-sidebar'>{body}</div>", f"<form action=x>{body}</form>", f"<div class='content-sidebar-wrap'>{body}</div>"):
        assert wr.main_text(f"<body>{whole}</body>", None) == wordy(1)
    parts = (
        "<header class='entry-header'><h1>Title</h1></header><h2 id='related-work'>Related</h2><section id='social-impact'><p>Impact</p></section>"
        "<p class='notice'>Note</p><div id='header-files'><p>Files</p></div>"
    )
    gone = "<div class='related-posts'><p>x</p></div><div id='comments'><p>x</p></div><div class='sidebar left'>x</div><div class='social-links'>x</div>"
    assert wr.main_text(f"<body><article>{parts}{gone}</article></body>", None).split("\n") == ["Title", "Related", "Impact", "Note", "Files"]


def test_wrapper_decides_names_in_doubt(spark):
    pages = [f"<body><article><p>{wordy(k)}</p><p class='notice'>Note {k}</p><div class='social-proof'>Trusted by all</div></article></body>" for k in range(4)]
    assert regions(pages, spark) == [f"{wordy(k)}\nNote {k}" for k in range(4)]


def test_furniture_goes_at_any_depth():
    for n in (20, 99, 100, 110, 3000):
        inner = f"<nav>MENU</nav><p>text</p><div>more<aside>side<div>x</div></aside></div>tail<p class='ad'>buy</p>"
        whole = "<body>" + "<div>" * n + inner + "</div>" * n + "<p>after</p></body>"
        assert wr.main_text(whole, None).split("\n") == ["text", "more", "tail", "after"]


def test_adverts_and_comments_among_running_text(spark):
    gone = (
        "<p class='ad'>Buy {0} now</p><table class='ad'><tr><td>cheap {0}</td></tr></table><ul><li>point {0}</li><li class='comment'>I agree {0}</li></ul>"
        "<ol class=commentlist><li>first {0}</li></ol><section class=discussion><p>nice {0}</p></section><blockquote class='ad-box'>offer {0}</blockquote>"
    )
    kept = "<section id='discussion'><h2 id='comments'>Comments on {0}</h2><p class='lead'>Results {0}</p></section>"
    pages = [f"<body><article><p>{wordy(k)}</p>{gone.format(wordy(k + 50, 3))}{kept.format(k)}</article></body>" for k in range(6)]
    want = [f"{wordy(k)}\npoint {wordy(k + 50, 3)}\nComments on {k}\nResults {k}" for k in range(6)]
    assert regions(pages, spark) == want and [wr.main_text(p, None) for p in pages] == want


def test_any_partitioning_gives_the_same_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = {r.page_id: r.text for r in wr.extract(docs.repartition(1)).collect()}
    for n in (3, 8):
        assert {r.page_id: r.text for r in wr.extract(docs.repartition(n, "page_id")).collect()} == one


def test_clashing_names(spark):
    rows = [(k, "http://a.org/x", page(k), "own", "own", "own", "own") for k in range(3)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, _host string, _region string, host string, _TEXT string")
    got = wr.extract(docs).collect()
    assert {r.page_id: r.text for r in got} == {k: text(k) for k in range(3)} and {tuple(r)[3:7] for r in got} == {("own",) * 4}
