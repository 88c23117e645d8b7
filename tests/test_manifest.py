"""Golden pages: markup in, manifest out. All pages run through one job."""

from urllib.parse import unquote

import pytest

from pagelens.operators import candidates as C, manifest as M
from pagelens.plans import pipeline as P

BASE = "https://museum.example/rooms/north/"
PRODUCT = '<img src="p{0}.jpg" srcset="p{0}-1.jpg 100w">'
PAGES = {
    "late_base": '<img src=early.png><base href="cdn/assets/"><img src=late.png><base href="/other/">',
    "bad_base": '<base href="https://:bad"><img src="hall.webp">',
    "dedupe": '<img src="/vase.jpg"><img src="/vase.jpg#lid"><img src="/map.gif?zoom=3&floor=1"><img src="/map.gif?floor=1&zoom=3">',
    "names": '<img src="/1950/Urn.gif"><img src="/1960/urn.GIF"><img src="/1970/urn"><img src="/1980/urn">',
    "schemes": '<img src="data:text/plain,x"><img src="javascript:1"><img src="blob:x"><img src="DATA:image/gif,x">',
    "lazy": '<div data-src="a.jpg"></div><section data-srcset="b.jpg 1x, c.jpg 2x"></section>'
    '<li data-bg="url(d.jpg)" data-original=e.jpg data-lazy-src="f.jpg"></li>',
    "dims": '<img src="frieze.jpg" width="900" height="250" srcset="frieze-s.jpg 360w, frieze-m.jpg 630w"><img src=key.png width="8em" height=tall>',
    "groups": '<picture><source srcset="a.avif"><source srcset="b.webp"><img src="c.jpg"></picture>'
    '<img src="d.jpg" srcset="d2.jpg 2x"><img src="e.jpg">',
    "meta": '<meta property="og:image" content="/og.jpg"><meta property="og:image:width" content="1200">'
    '<meta property="og:image:height" content="630"><meta name="twitter:image" content="/tw.png"><meta property="og:image:width" content="5">',
    "icons": '<link rel="icon" href="/f.ico" sizes="32x32"><link rel="apple-touch-icon" href="/t.png"><link rel="stylesheet icon" href="/s.css">',
    "json_ld": '<script type="application/ld+json">{"image":["a.png",{"url":"b.png","width":2400,"height":"1600px"}],'
    '"author":{"image":"c.png"}}</script><script type="application/ld+json">{bad</script>',
    "svg": '<svg viewbox="1 2 30 40" role="img"><rect width="7"/><defs><stop offset="1"></stop></defs><desc>x<y</desc></svg>',
    "nested_svg": '<svg><svg></svg></svg><svg/>',
    "svg_title": '<svg><title/><path/></svg><img src=a.png>',
    "svg_style": '<svg><STYLE/><path/></svg><img src=a.png><style>b{background:url(s.png)}</style>',
    "svg_script": '<svg><g><script href=x /></g><svg><title/><a href=b/></a></svg></svg><img src=a.png><title/><img src=never.png></title><img src=b.png>',
    "svg_text_styles": '<svg><style>i{fill:url(in.png)}</style><title>a&b</title></svg><img src=a.png>',
    "svg_markup_in_title": '<svg><title><b2>x</title><path/></svg><img src=a.png>',
    "svg_left": '<svg><path><style/><p><img src=a.png><title><img src=never.png></title><img src=b.png>',
    "svg_html_inside": '<svg><foreignObject><p><style>a<b></style><img src=a.png></p></foreignObject><title/></svg><img src=b.png>',
    "svg_cdata": '<svg><![CDATA[ <img src=never.png> ]]><path/></svg><math><title/></math><img src=a.png>',
    "noscript": '<img src="x.png"><noscript><img src="x.png"><img src="n.png" srcset="n2.png 2x"></noscript>'
    '<noscript> </noscript><noscript><base href="/zzz/"><img src="m.png" srcset="m2.png 2x"></noscript>',
    "css": "<style>a{background:url( 's.png' )}</style><p style=\"background:image-set('d.png' 1x)\">"
    '<p style="background:IMAGE-SET(x)"><p style="color:red">',
    "quotes": '<img alt="a > b" src=\'q.png\'><img alt="x"" src=r.png><img title=it\'s src=s.png/><a href="unclosed><img src=never.png>',
    "raw_text": '<textarea><img src=t.png></textarea><!-- <img src=c.png> --><script>"<img src=j.png>"</script><img src=ok.png>',
    "first_wins": '<img src="a.png" width=100 height=80><img src="a.png" width=900 height=720>',
    "plain": "<p>nothing</p>",
    "empty": "",
    "many": "".join(PRODUCT.format(i) for i in range(1100)),
}


@pytest.fixture(scope="module")
def manifests(spark):
    names = list(PAGES)
    rows = [(i, BASE, PAGES[n]) for i, n in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {n: [] for n in names}
    for r in P.extract_manifest(pages).orderBy("page_id", "doc_order").collect():
        out[names[r.page_id]].append(r)
    return out


def urls(rows):
    return [r.url.removeprefix(BASE) for r in rows]


def test_base_applies_to_the_whole_document(manifests):
    assert urls(manifests["late_base"]) == ["cdn/assets/early.png", "cdn/assets/late.png"]
    assert urls(manifests["bad_base"]) == ["hall.webp"]


def test_first_wins_dedupe(manifests):
    assert urls(manifests["dedupe"]) == ["https://museum.example/vase.jpg", "https://museum.example/map.gif?floor=1&zoom=3"]
    assert [(r.width, r.height) for r in manifests["first_wins"]] == [(100, 80)]


def test_names_are_numbered_without_case(manifests):
    assert [r.filename for r in manifests["names"]] == ["Urn.gif", "urn-2.GIF", "urn", "urn-2"]


def test_schemes(manifests):
    assert manifests["schemes"] == []


def test_lazy_attributes_in_list_order(manifests):
    assert urls(manifests["lazy"]) == ["a.jpg", "b.jpg", "c.jpg", "f.jpg", "e.jpg", "d.jpg"]
    assert {r.source for r in manifests["lazy"]} == {"lazy"}


def test_declared_dimensions(manifests):
    assert [(r.width, r.height, r.dimension_source) for r in manifests["dims"]] == [
        (900, 250, "declared"), (360, 100, "declared"), (630, 175, "declared"), (None, None, None)
    ]


def test_variant_groups(manifests):
    assert [r.variant_group for r in manifests["groups"]] == ["vg-1"] * 3 + ["vg-2"] * 2 + [None]


def test_social_image_sizes(manifests):
    assert [(r.url[-6:], r.width, r.height) for r in manifests["meta"]] == [("og.jpg", 1200, 630), ("tw.png", None, None)]


def test_icons_are_the_else_branch_of_style_sheets(manifests):
    assert [(r.filename, r.width) for r in manifests["icons"]] == [("f.ico", 32), ("t.png", None)]


def test_json_ld_order_and_sizes(manifests):
    assert [(r.filename, r.width, r.height) for r in manifests["json_ld"]] == [
        ("a.png", None, None), ("b.png", 2400, 1600), ("c.png", None, None)
    ]


def test_inline_svg(manifests):
    from urllib.parse import unquote

    (row,) = manifests["svg"][:1]
    head, markup = row.url.split(",", 1)
    assert head == "data:image/svg+xml" and row.filename == "inline-1.svg"
    assert unquote(markup).startswith(
        '<svg viewBox="1 2 30 40" role="img" xmlns="http://www.w3.org/2000/svg"><rect width="7"/><defs><stop offset="1"></stop></defs><desc>x'
    )
    assert [r.filename for r in manifests["nested_svg"]] == ["inline-1.svg", "inline-2.svg"]


def test_noscript(manifests):
    rows = manifests["noscript"]
    assert urls(rows) == ["x.png", "n.png", "n2.png", "m.png", "m2.png"]
    assert [r.variant_group for r in rows] == [None, "n0-vg-1", "n0-vg-1", "n1-vg-1", "n1-vg-1"]


def test_css(manifests):
    assert [(r.source, r.filename) for r in manifests["css"]] == [("style-block", "s.png"), ("style-attr", "d.png")]


def test_tokenizer_quotes_and_raw_text(manifests):
    assert urls(manifests["quotes"]) == ["q.png", "r.png", "s.png/"]
    assert urls(manifests["raw_text"]) == ["ok.png"]


def test_nothing_is_cut_unless_a_limit_is_given(manifests, spark):
    assert len(manifests["many"]) == 2200
    sheets = [(f"{BASE}s{i}.css", f"{BASE}s{i}.css", 200, f".a{{background:url(c{i}.png)}}") for i in range(4)]
    html = "".join(f'<link rel="stylesheet" href="s{i}.css">' for i in range(4)) + "".join(f"<img src=l{i}.png>" for i in range(1100))
    html += f'<img src="data:image/gif,{"x" * 200_000}">'
    pages = spark.createDataFrame([(1, BASE, html)], "page_id bigint, url string, html string")
    css = spark.createDataFrame(sheets, "sheet_url string, final_url string, status int, css string")
    assert P.extract_manifest(pages, sheets=css).count() == 1105
    limited = dict(raw_cap=5000, max_units=1000, max_sheets=3, max_data_uri=102_400)
    assert P.extract_manifest(pages, sheets=css, **limited).count() == 1000
    assert P.scan_pages(pages, raw_cap=5000, max_units=1000).first().truncated == "image-cap"
    assert P.scan_pages(pages).first().truncated is None


def test_logical_cap_counts_units(spark):
    pages = spark.createDataFrame([(1, BASE, PAGES["many"])], "page_id bigint, url string, html string")
    assert P.extract_manifest(pages, max_units=1000).count() == 2000


def test_pages_without_images_keep_a_row(spark):
    pages = spark.createDataFrame([(1, BASE, ""), (2, BASE, "<img src=a.png><img src=b.png>"), (3, BASE, "x" * 50)],
                                  "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in P.scan_pages(pages, max_units=1, max_bytes=40).collect()}
    assert {k: (r.n_images, r.truncated) for k, r in rows.items()} == {1: (0, None), 2: (1, "image-cap"), 3: (0, "size-cap")}


def test_rejected_unit_blocks_a_later_copy(spark):
    html = '<img src="1.png"><img src="late.png"><img src="1b.png" srcset="late.png 2x">'
    pages = spark.createDataFrame([(1, BASE, html)], "page_id bigint, url string, html string")
    rows = M.manifest(C.raw_candidates(pages), max_units=1).collect()
    assert urls(rows) == ["1.png"]


def test_noscript_and_style_budgets(spark):
    html = "<style>a{b:url(1.png)}</style><style>url(2.png)</style><noscript><img src=a.png></noscript><noscript><img src=bbbb.png></noscript>"
    pages = spark.createDataFrame([(1, BASE, html)], "page_id bigint, url string, html string")
    rows = M.manifest(C.raw_candidates(pages, noscript_budget=20, style_budget=10)).orderBy("doc_order").collect()
    assert urls(rows) == ["1.png", "a.png"]


def test_very_long_tag_does_not_overflow(spark):
    html = "<div " + " ".join(f'a{i}="{i}"' for i in range(30_000)) + '><img src="ok.png">'
    pages = spark.createDataFrame([(1, BASE, html)], "page_id bigint, url string, html string")
    assert urls(P.extract_manifest(pages).collect()) == ["ok.png"]


def test_one_shuffle_and_one_scan(spark):
    pages = spark.createDataFrame([(1, BASE, "<img src=a.png>")], "page_id bigint, url string, html string")
    plan = P.extract_manifest(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("ArrowEvalPython") == 2


def test_foreign_content_has_its_own_grammar(manifests):
    def images(name):
        return [u for u in urls(manifests[name]) if not u.startswith("data:")]

    def drawings(name):
        return [unquote(u.removeprefix("data:image/svg+xml,")) for u in urls(manifests[name]) if u.startswith("data:")]

    xmlns = 'xmlns="http://www.w3.org/2000/svg"'
    assert images("svg_title") == ["a.png"] and drawings("svg_title") == [f"<svg {xmlns}><title/><path/></svg>"]
    assert images("svg_style") == ["a.png", "s.png"] and drawings("svg_style") == [f"<svg {xmlns}><style/><path/></svg>"]
    assert images("svg_script") == ["a.png", "b.png"]
    assert drawings("svg_script") == [f'<svg {xmlns}><g><script href="x"/></g><svg><title/><a href="b/"></a></svg></svg>']
    assert images("svg_text_styles") == ["in.png", "a.png"]
    assert drawings("svg_text_styles") == [f"<svg {xmlns}><style>i{{fill:url(in.png)}}</style><title>a&amp;b</title></svg>"]
    assert images("svg_markup_in_title") == ["a.png"] and drawings("svg_markup_in_title") == [f"<svg {xmlns}><title><b2>x</title><path/></svg>"]
    assert images("svg_left") == ["a.png", "b.png"]
    assert images("svg_html_inside") == ["a.png", "b.png"]
    assert images("svg_cdata") == ["a.png"]


def test_scan_takes_every_limit_and_reads_policy_first(spark):
    sheet = spark.createDataFrame([(f"https://museum.example/s{k}.css", f"https://museum.example/s{k}.css", 200, f"a{{background:url(i{k}.png)}}") for k in (1, 2)], "sheet_url string, final_url string, status int, css string")
    html = '<link rel=stylesheet href=/s1.css><link rel=stylesheet href=/s2.css><img src=a.png><img src=b.png><style>x{background:url(c.png)}</style>'
    pages = spark.createDataFrame([(1, BASE, html), (2, "http://10.0.0.1/", html), (3, "https://museum.example/no/x", html), (4, "https://museum.example/e", "<p>")], "page_id bigint, url string, html string")
    count = lambda **o: {r.page_id: (r.n_images, r.truncated) for r in P.scan_pages(pages, sheets=sheet, **o).select("page_id", "n_images", "truncated").collect()}[1]
    assert count() == (5, None) and count(max_sheets=1) == (4, None) and count(style_budget=0) == (4, None) and count(max_units=3) == (3, "image-cap")
    assert count(max_bytes=len(html) - 60)[1] == "size-cap" and count(raw_cap=1) == (3, "image-cap")
    robots = spark.createDataFrame([("https://museum.example", 200, "User-agent: *\nDisallow: /no/")], "origin string, status int, body string")
    got = {r.page_id: (r.n_images, r.status) for r in P.scan_status(pages, robots, sheets=sheet).collect()}
    assert got == {1: (5, "results"), 2: (0, "error"), 3: (0, "robots-blocked"), 4: (0, "empty")}
    # Only joined rows are tokenized: the join with the verdicts stands below the tokenizer in the plan.
    plan = P.scan_status(pages, robots)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all(html") < plan.index("Join LeftSemi")
