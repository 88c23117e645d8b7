"""Policy, view, enrichment and rate rules against hand-made cases and brute force."""

import random

from pagelens.functions import hosts as A, urls as U, values as V
from pagelens.functions.image_id import fnv1a64
from pagelens.operators import bundle as B, enrich as E, policy as P, rate as R, view as VW


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").selectExpr(f"{expr('v')} AS r").first().r


def many(spark, expr, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").selectExpr("i", f"{expr('v')} AS r").collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_srcset_and_css(spark):
    assert [tuple(x) for x in one(spark, V.parse_srcset, " a.jpg 480w, b.jpg 1x 800w,, ,c")] == [("a.jpg", 480), ("b.jpg", 800), ("c", None)]
    css = "a url(\"x.png\") URL( y ) url('') image-set(\"d.png\" 1x, 'e.png' 2x)"
    assert one(spark, V.css_urls, css) == ["x.png", "y", "d.png", "e.png"]


def test_format_bytes(spark):
    got = many(spark, lambda c: V.format_bytes(f"CAST({c} AS BIGINT)"), ["0", "999", "1000", "1949", "2000000", "15500000000", "1650000", "1250", "1350", "1999950"])
    assert got == ["0 B", "999 B", "1 KB", "1.9 KB", "2 MB", "15.5 GB", "1.6 MB", "1.3 KB", "1.4 KB", "2 MB"]


def test_data_uri_bytes(spark):
    got = many(spark, V.data_uri_bytes, ["data:image/gif;base64,R0lGODlhAQABAAAAACw=", "data:,a%20b", "data:,%zz", "data:x"])
    assert got == [14, 3, 3, 0]


def test_resolution(spark):
    cases = {
        "../x/./y.png?b=2&a=1&a=0": "https://s.example/x/y.png?a=1&a=0&b=2",
        "//cdn.net/b.png": "https://cdn.net/b.png",
        "HTTPS://EX.com:443/a b.png?x=a/b c&%zz": "https://ex.com/a%20b.png?%25zz=&x=a%2Fb+c",
        "/a/../../b/%2E%2e/c/..": "https://s.example/",
        "\\x\\y": "https://s.example/x/y",
        "http://h:99999/": None,
        "http://a b/": None,
        "javascript:1": None,
        "https:foo.png": "https://s.example/p/foo.png",
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").selectExpr(
        "raw", f"{U.split_absolute('''concat('https://s.example/p/', '')''')} AS base")
    got = {r.raw: r.u for r in U.with_resolved(df, "raw", "base", "u").collect()}
    assert got == cases


def test_image_id_matches_the_definition():
    def slow(text):
        h, units = 0xCBF29CE484222325, text.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = ((h ^ int.from_bytes(units[i : i + 2], "little")) * 0x100000001B3) % 2**64
        return h

    texts = ["", "a", "https://x.example/é", "data:😀", "zz" * 300]
    assert fnv1a64(texts).tolist() == [slow(t) for t in texts]


def test_admission(spark):
    cases = {
        "http://2130706433/": "private-ip", "http://0x7f000001/": "private-ip", "http://017700000001/": "private-ip",
        "http://127.1/": "private-ip", "http://127.0.0.1./": "private-ip", "http://126.255.255.255/": None, "http://128.0.0.0/": None,
        "http://100.63.255.255/": None, "http://100.64.0.0/": "private-ip", "http://198.20.0.0/": None, "http://[::1]/": "private-ip",
        "http://[::ffff:10.0.0.1]/": "private-ip", "http://[::ffff:8.8.8.8]/": None, "http://[2606:4700::1111]/": None,
        "http://[fec0::1]/": None, "http://[fe80::1]/": "private-ip", "http://[::1::2]/": "invalid-url", "http://256.1.1.1/": "invalid-url",
        "http://localhost/": "blocked-hostname", "http://x.internal/": "blocked-hostname", "http://internal.example/": None,
        "http://h.example:8080/": "bad-port", "https://h.example:443/": None, "ftp://h.example/": "bad-scheme", "nope": "invalid-url",
        "http://u:p@10.0.0.1/": "private-ip", "http://EXAMPLE.com./": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.reason for r in P.admit(df).collect()} == cases


def test_robots(spark):
    body = "﻿User-agent: other\r\nUser-agent: PageLens\r\nDisallow: /a # x\r\nAllow: /a/b\nDisallow:\n\nUser-agent: *\nDisallow: /"
    robots = spark.createDataFrame([("https://s.example", 200, body), ("https://t.example", 200, "User-agent: pagelens\n\nUser-agent: *\nDisallow: /"),
                                    ("https://u.example", 404, "User-agent: *\nDisallow: /"), ("https://v.example", 200, "User-agent: *\nDisallow: /*.html$\nDisallow: /p*q*$\nAllow: /xy.html")],
                                   "origin string, status int, body string")
    rules = P.robots_rules(robots, "pagelens")
    urls = {"https://s.example/a/c": False, "https://s.example/a/b": True, "https://s.example/z": True, "https://t.example/": False,
            "https://u.example/": True, "https://v.example/y.html": False, "https://v.example/xy.html": True, "https://v.example/x.html": False, "https://v.example/y.html?q": True,
            "https://v.example/p/1q2": False}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    assert {r.url: r.robots_allowed for r in P.robots_verdicts(pages, rules).collect()} == urls


def test_blocklist(spark):
    lines = spark.createDataFrame([("# c",), ("https://Spam.example/x",), ("EVIL.test.",), ("bücher.example",), ("h.test:80",), ("",)], "line string")
    entries = P.blocklist_entries(lines)
    assert {r.entry for r in entries.collect()} == {"spam.example", "evil.test", "xn--bcher-kva.example", "h.test"}
    pages = spark.createDataFrame([(1, "http://a.spam.example/"), (2, "http://notspam.example/"), (3, "http://evil.test/")], "page_id bigint, url string")
    assert [r.page_id for r in P.without_blocked(pages, entries).collect()] == [2]


def brute_rate(rows, limit, window):
    state, out = {}, {}
    for rid, kind, client, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        if not client:
            out[rid] = (True, None)
            continue
        start, n = state.get((kind, client), (None, 0))
        if start is None or ts - start >= window:
            start, n = ts, 0
        out[rid] = (True, None) if n < limit else (False, max(1, -(-(start + window - ts) // 1000)))
        state[kind, client] = (start, min(n + 1, limit))
    return out


def test_rate_limit_matches_brute_force_also_for_hot_clients(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice(["hot"] * 4 + ["x", "y", "", None]), rng.randrange(0, 40_000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "request_id bigint, kind string, client string, ts_ms bigint")
    expected = brute_rate(rows, 3, 5_000)
    got = {r.request_id: (r.admitted, r.retry_after) for r in R.rate_limit(df, 3, 5_000).collect()}
    assert got == expected
    assert R.rate_limit(df.limit(0), 3, 5_000).count() == 0


def test_rejected_requests_have_the_catalog_message_of_their_kind(spark):
    df = spark.createDataFrame([("scan", False, 61), ("proxy", False, 60), ("scan", True, None)], "kind string, admitted boolean, retry_after bigint")
    got = {r.kind: (r.http_status, r.retryable, r.message) for r in P.with_rate_messages(df).collect()}
    assert {k: v[:2] for k, v in got.items()} == {"scan": (429, False), "proxy": (429, False)}
    assert got["scan"][2].endswith("in about 2 minutes.") and got["proxy"][2].endswith("in about 1 minute.")


def test_session_cost_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "k", rng.choice("abc"), rng.randrange(0, 400_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "request_id bigint, kind string, client string, ts_ms bigint")
    sessions = []
    for client in "abc":
        times = sorted(t for _, _, c, t in rows if c == client)
        group = [times[0]]
        for t in times[1:]:
            if t - group[-1] >= 3_000:
                sessions.append((client, group[0], group[-1], len(group)))
                group = []
            group.append(t)
        sessions.append((client, group[0], group[-1], len(group)))
    got = sorted((r.client, r.start_ms, r.end_ms, r.n_requests) for r in R.session_cost(df, 3_000, 9).collect())
    assert got == sorted(sessions)


def test_measured_prefixes(spark):
    h = bytes.fromhex
    jpeg = h("FFD8FFE0001000000000000000000000000000000000FFC00011080100020003")
    cases = {
        "png": (h("89504E470D0A1A0A0000000D49484452000000640000003200"), ("known", 100, 50)),
        "gif": (h("47494638396105000700"), ("known", 5, 7)),
        "vp8l": (h("5249464600000000574542505650384C000000002F") + (9 | 19 << 14).to_bytes(4, "little") + b"\0" * 6, ("known", 10, 20)),
        "jpeg": (h("FFD8FFE000100000000000000000000000000000FFC00011080100020003000000"), ("known", 512, 256)),
        "ico": (h("000001000200") + bytes([16, 16]) + b"\0" * 14 + bytes([0, 32]) + b"\0" * 14, ("known", 256, 32)),
        "svg": (b'<svg width="10.5px" height="3">', ("known", 11, 3)),
        "rel": (b'<svg width="100%" height="3">', ("no-intrinsic", None, None)),
        "cut": (h("FFD8FFE0FFFF00"), ("failed", None, None)),
        "junk": (b"hello", ("failed", None, None)),
    }
    assert len(jpeg) > 0
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "name string, content binary")
    got = {r.name: tuple(r.dims) for r in E.measure_prefixes(df).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_collapse_representative(spark):
    rows = [
        (1, "a", "u1", "a.png", "png", "srcset", 800, None, "g", 1), (1, "b", "u2", "b.png", "png", "img", 400, 300, "g", 2),
        (1, "c", "u3", "c.png", "png", "srcset", 300, 400, "g", 3), (1, "d", "u4", "d.png", "png", "img", None, None, None, 4),
    ]
    m = spark.createDataFrame(rows, "page_id bigint, id string, url string, filename string, ext string, source string, width bigint, "
                              "height bigint, variant_group string, doc_order bigint")
    got = {r.unit: (r.rep.id, r.n_members, r.tile_order) for r in VW.collapse_variants(m).collect()}
    assert got == {"g": ("b", 3, 1), "d": ("d", 1, 4)}
    assert VW.parse_format_param("JPG, webp,bogus,jpeg") == ["jpeg", "webp"] and VW.parse_source_param("img,css") == ["css"]


def test_shards_put_a_large_item_alone(spark):
    rows = [(1, i, f"i{i}", w) for i, w in enumerate([5, 5, 50, 3, 3, 3, 3])]
    df = spark.createDataFrame(rows, "page_id bigint, doc_order bigint, id string, weight bigint")
    got = [r.shard for r in B.shards(df, 3, 10).orderBy("doc_order").collect()]
    assert got == [1, 1, 2, 3, 3, 3, 4]


def test_redirect_to_no_url_is_rejected(spark):
    rows = [(1, 0, "http://a.example/", 302, "http://bad host/"), (2, 0, "http://a.example/", 302, "/b"), (2, 1, "http://a.example/b", 200, None)]
    rows += [(3, 0, "http://10.0.0.1/", 302, "http://bad host/")]
    df = spark.createDataFrame(rows, "req bigint, hop bigint, url string, status int, location string")
    assert {r.req: r.reason for r in P.redirect_chains(df).collect()} == {1: "invalid-url", 2: None, 3: "private-ip"}


def test_the_first_rejected_hop_of_any_kind_wins(spark):
    hop = lambda req, *urls: [(req, k, u, 302 if k + 1 < len(urls) else 200, urls[k + 1] if k + 1 < len(urls) else None) for k, u in enumerate(urls)]
    rows = hop(1, "http://a.example/", "http://b.example/", "http://x.listed.example/") + hop(2, "http://a.example/", "http://a.example/1", "http://inside.example/", "http://listed.example/")
    rows += hop(3, "http://inside.example/", "http://listed.example/") + hop(4, "http://listed.example/", "http://10.0.0.1/") + hop(5, "http://93.184.216.34/", "http://b.example/") + hop(6, *["http://a.example/"] * 5)
    rows += hop(7, "http://LISTED。example./x")
    df = spark.createDataFrame(rows, "req bigint, hop bigint, url string, status int, location string")
    entries = spark.createDataFrame([("listed.example",)], "entry string")
    dns = spark.createDataFrame([("inside.example", "dns-private"), ("b.example", None), ("listed.example", "dns-nxdomain"), ("93.184.216.34", "dns-error")], "host string, reason string")
    got = {r.req: r.reason for r in P.redirect_chains(df, entries=entries, dns=dns).collect()}
    assert got == {1: "domain-blocked", 2: "dns-private", 3: "dns-private", 4: "domain-blocked", 5: None, 6: "too-many-redirects", 7: "domain-blocked"}
    assert {r.req: r.reason for r in P.redirect_chains(df).collect()} == {1: None, 2: None, 3: None, 4: "private-ip", 5: None, 6: "too-many-redirects", 7: None}


def test_rate_limit_of_sparse_clients(spark):
    rng = random.Random(7)
    rows = [(i, "a", f"c{rng.randrange(12)}", rng.randrange(0, 10**6) if i % 3 else rng.randrange(0, 30_000)) for i in range(600)]
    df = spark.createDataFrame(rows, "request_id bigint, kind string, client string, ts_ms bigint")
    for limit in (1, 2, 100):
        assert {r.request_id: (r.admitted, r.retry_after) for r in R.rate_limit(df, {"a": limit}, 5_000).collect()} == brute_rate(rows, limit, 5_000)


SPELLINGS = ["１２７.0.0.1", "127。0。0。1", "%31%32%37.0.0.1", "12\t7.0.0.1", "0x7F%2E1", "①②⑦.1"]


def test_hosts_are_judged_as_browsers_read_them(spark):
    cases = {f"http://{h}/x": "private-ip" for h in SPELLINGS}
    cases |= {"http://ⓛocalhost/": "blocked-hostname", "\n http://user@LOCAL\thost:80/ ": "blocked-hostname", "http:\\\\10.0.0.1\\a": "private-ip"}
    cases |= {"http://bücher.example/": None, "http://b%C3%BCcher.example:443/": None, "http://a%2Fb/": "invalid-url", "http://a%ff/": "invalid-url", "http://ü..x/": "invalid-url"}
    rows = spark.createDataFrame([(u, "x", "y") for u in cases], "url string, host string, reason_ string")
    assert {r.url: r.reason for r in P.admit(rows).collect()} == cases


def test_internationalized_hosts_meet_the_list(spark):
    pages = spark.createDataFrame([(u, "kept") for u in [
        "http://bücher.example/a", "http://www.BÜCHER.example:80/", "http://b%C3%BCcher.example./", "http://xn--bcher-kva.example/", "http://buecher.example/", "http://ｂücher。example/",
    ]], "url string, host string")
    for line in ("bücher.example", "https://BÜCHER.example/x", "xn--bcher-kva.example."):
        entries = P.blocklist_entries(spark.createDataFrame([(line,)], "line string"))
        assert [tuple(r) for r in P.without_blocked(pages, entries).collect()] == [("http://buecher.example/", "kept")]


def test_canonical_hosts_in_resolved_urls(spark):
    cases = {"//BÜcher.example/ü?q=ü": "https://xn--bcher-kva.example/%C3%BC?q=%C3%BC", "http://0x7f.1:80/a": "http://127.0.0.1/a", "http://2130706433": "http://127.0.0.1/",
             "http://1.2.3.4.5/": None, "http://a%20b/": None, "http://１２７.1:8080": "http://127.0.0.1:8080/", "//09/": None}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").selectExpr("raw", f"{U.split_absolute('''concat('https://s.example/p/', '')''')} AS base")
    assert {r.raw: r.u for r in U.with_resolved(df, "raw", "base", "u").collect()} == cases


def test_united_sketches_equal_one_pass(spark):
    m = spark.range(60_000).selectExpr("cast(pmod(hash(id), 40000) AS string) AS id", "id % 7000 AS page_id", "id % 9 AS site", "id % 2 AS ext")
    parts = VW.united_sketches(VW.unit_sketches(m, ["site", "ext"]), ["ext"])
    whole = VW.united_sketches(VW.unit_sketches(m, ["ext"]), ["ext"])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    for r in parts.collect():
        n = m.filter(f"ext = {r.ext}").select("id").distinct().count()
        assert abs(r.approx_images - n) <= VW.SKETCH_ERROR * n and abs(r.approx_pages - 3500) <= VW.SKETCH_ERROR * 3500
