"""Crawl tables derived from the given ``pages`` table.

The given pages hold no images, so image markup is written into them by one deterministic string
expression; the other crawl tables (style sheets, robots files, fetch logs, ...) are derived from
the pages in the same way. All expressions are plain SQL that both engines of the correctness check
understand. Each grows with ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

HEAD = (
    '<meta property="og:image" content="/og/{p}.jpg"><meta property="og:image:width" content="1200">'
    '<meta property="og:image:height" content="630"><meta name="twitter:image" '
    'content="https://cdn.example.net/tw/{m}.png"><link rel="stylesheet" href="/css/site-{m}.css">'
    '<link rel="shortcut icon" href="/favicon.ico" sizes="32x32">'
    "<style>.k{background:url(/css/k-{m}.png)}</style>"
    '<script type="application/ld+json">{"@type":"Article","image":["/ld/a-{p}.jpg",'
    '{"@type":"ImageObject","url":"/ld/b-{m}.jpg","width":2400,"height":"1600px"}],'
    '"author":{"name":"x","image":"/ld/author-{m}.png"}}</script>'
)
BODY = (
    '<img src="/img/hero-{p}.jpg" width="1600" height="900" srcset="/img/hero-{p}-800.jpg 800w, '
    '/img/hero-{p}-1200.jpg 1200w"><img src="shared-{m}.png#top"><img src="shared-{m}.png">'
    '<img src="//cdn.example.net/wide.png?size=2&cut=7"><img src="//cdn.example.net/wide.png?cut=7&size=2">'
    '<picture><source srcset="/p/{p}-800.webp 800w, /p/{p}-1200.webp 1200w"><img src="/p/{p}.jpg" '
    'width="1200" height="800" alt="a > b"></picture><div data-bg="url(/bg/{m}.png)" '
    "style=\"background:url('/css/attr-{m}.gif')\"></div><li data-src=\"/lazy/{p}.jpg\"></li>"
    '<video poster="/v/{m}.jpg"></video><object data="/o/{m}.svg"></object><embed src="/e/{p}.png">'
    '<noscript><img src="/ns/{p}.avif" srcset="/ns/{p}-2x.avif 2x"></noscript>'
    '<img src="javascript:alert(1)"><img src="data:image/gif;base64,R0lGODlhAwACAIABACBAYP///yw=">'
    '<img src="/left/tile-{m}.jpg"><img src="/right/tile-{m}.jpg">'
)
# Only on every third page: inline drawings, with empty elements that are raw text in HTML, and a lazily loaded responsive set.
THIRD = (
    '<svg viewbox="0 0 {m} 9"><g><circle r="2"/></g><text>a&b</text></svg>'
    '<svg><title/><path d="M{m} 0"/></svg><img src="/after/title-{m}.png">'
    '<svg><style/><g><script/></g></svg><img src="/after/style-{p}.png">'
    '<table><tr><td width="{m}px" height="0{p}">x</td><td width=" {p}" height="auto">y</td><td width="{m}%" height="{p}">z</td></tr></table>'
    '<img data-srcset="/z/{m}-s.jpg 320w, /z/{m}-l.jpg 640w" width="640" height="480">'
)
# Only on every fourth page: a product grid.
FOURTH = "".join(
    f'<img src="/shop/{{p}}-{k}.jpg" srcset="/shop/{{p}}-{k}.jpg?w=200 200w, /shop/{{p}}-{k}.jpg?w=400 400w">'
    for k in range(1, 7)
)
BASE = '<base href="https://cdn.example.net/assets/">'


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Every eleventh page stays without images.
CRAWL_HTML = (
    f"case when page_id % 11 = 3 then html else replace(replace(replace(replace(html, '<article>', "
    f"{_q(BODY)} || case when page_id % 3 = 0 then {_q(THIRD)} else '' end || "
    f"case when page_id % 4 = 1 then {_q(FOURTH)} else '' end || "
    f"case when page_id % 5 = 0 then {_q(BASE)} else '' end || '<article>'), "
    f"'</head>', {_q(HEAD)} || '</head>'), '{{p}}', cast(page_id as string)), "
    f"'{{m}}', cast(page_id % 7 as string)) end"
)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def with_images(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with image markup in place."""
    return pages.select("page_id", "url", F.expr(CRAWL_HTML).alias("html"))


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_images(read_pages(spark, sf_dir))


# Column lists over ``pages`` or the manifest; both engines evaluate the same text.
ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"

# distinct origins -> robots files
ROBOTS = [
    "origin",
    "CASE WHEN length(origin) % 5 = 0 THEN 404 ELSE 200 END AS status",
    "replace(CASE length(origin) % 5 WHEN 0 THEN 'User-agent: *|Disallow: /' WHEN 1 THEN 'User-agent: *|Disallow: /de/|' "
    "WHEN 2 THEN 'User-agent: *|Disallow: /||User-Agent: PageLens|User-agent: other|Disallow: /fr/ # no|Allow: /fr/1|Disallow:|' "
    "WHEN 3 THEN '# top|User-agent: *|Disallow: /*?*ref=|Sitemap: /s.xml|Allow: /en/|User-agent: else|Disallow: /en|' "
    "ELSE 'User-agent: *|Disallow: /*.html$|Disallow: /es|Allow: /es/*/$|' END, '|', chr(10)) AS body",
]
# distinct (origin, m) -> style sheets
SHEET_ORIGIN = f"CASE WHEN page_id % 5 = 0 THEN 'https://cdn.example.net' ELSE {ORIGIN} END"
SHEETS = [
    "origin || '/css/site-' || m || '.css' AS sheet_url",
    "origin || '/css/site-' || m || '.css' AS final_url",
    "CASE WHEN m = 6 THEN 500 ELSE 200 END AS status",
    "'.h{background:url(../img/h-' || m || '.jpg)} .s{background:image-set(\"s-' || m || '.webp\" 1x)}' AS css",
]
# pages -> the same, some on an internationalized host in several spellings
LISTED_URL = (
    f"CASE page_id % 13 WHEN 4 THEN replace(url, {HOST}, 'Bücher.example') WHEN 5 THEN replace(url, {HOST}, 'www.b%C3%BCcher.example') "
    f"WHEN 6 THEN replace(url, {HOST}, 'www.xn--bcher-kva.example') WHEN 7 THEN replace(url, {HOST}, 'ｂücher。example') ELSE url END"
)
LISTED = ["page_id", f"{LISTED_URL} AS url"]
# distinct hosts -> operator list lines
BLOCK_LINES = [
    "CASE WHEN host LIKE '%ü%' THEN upper(host) ELSE CASE length(host) % 5 WHEN 0 THEN 'https://' || host || '/x' WHEN 1 THEN ' ' || upper(host) || '.' "
    "WHEN 2 THEN '# ' || host WHEN 3 THEN ' ' ELSE "
    "CASE WHEN length(host) - length(replace(host, '.', '')) >= 3 THEN substring(host, length(split_part(host, '.', 1)) + 2, 200) ELSE '#' END END END AS line"
]
# pages -> addresses to audit
_IP = "((page_id * 2654435761) % 4294967296)"
_QUAD = (
    f"(({_IP} >> 24) & 255) || '.' || (({_IP} >> 16) & 255) || '.' || (({_IP} >> 8) & 255) || '.' || ({_IP} & 255)"
)
AUDIT = [
    "page_id",
    f"CASE page_id % 20 WHEN 1 THEN 'http://' || {_IP} || '/a' WHEN 2 THEN 'http://0x' || hex({_IP}) || '/' "
    f"WHEN 3 THEN 'http://' || {_QUAD} || '/' WHEN 4 THEN 'http://127.' || page_id || '/' "
    f"WHEN 5 THEN 'http://[::ffff:' || {_QUAD} || ']/' WHEN 6 THEN 'http://' || {HOST} || ':8080/' "
    f"WHEN 7 THEN 'ftp://' || {HOST} || '/f' WHEN 8 THEN 'http://LOCALHOST./' "
    "WHEN 9 THEN 'http://svc' || page_id || '.internal/' WHEN 10 THEN 'not a url ' || page_id "
    "WHEN 11 THEN 'http://[fd00::' || lower(hex(page_id)) || ']/' WHEN 12 THEN 'http://0177.0.0.' || (page_id % 8) "
    "WHEN 13 THEN 'http://10.' || (page_id % 256) || '.0.1:443/x' WHEN 14 THEN 'http://１２７。０。０。' || (page_id % 8) || '/' "
    "WHEN 15 THEN 'http://127。0。0。1/' WHEN 16 THEN 'http://ⓛocalhost/' || page_id WHEN 17 THEN 'http://%31%32%37.0.0.1/' "
    "WHEN 18 THEN 'http://12' || chr(9) || '7.0.0.1/' WHEN 19 THEN 'http://0x7F%2E' || page_id || '/' ELSE url END AS raw",
]
# manifest -> image responses
RESPONSES = [
    "page_id", "id", "url", "filename", "doc_order",
    "CASE doc_order % 8 WHEN 1 THEN 206 WHEN 2 THEN 403 WHEN 4 THEN 429 ELSE 200 END AS status",
    "CASE doc_order % 8 WHEN 3 THEN 'text/css' WHEN 5 THEN 'image/JPEG; charset=x' WHEN 7 THEN 'image/gif' ELSE 'image/png' END AS content_type",
    "CASE doc_order % 8 WHEN 0 THEN 1000 + doc_order WHEN 1 THEN 4096 WHEN 5 THEN 60000000 WHEN 6 THEN NULL WHEN 7 THEN 5000 ELSE 300 END AS content_length",
    "CASE doc_order % 8 WHEN 1 THEN 'bytes 0-4095/' || (50000 + doc_order) END AS content_range",
    "CASE doc_order % 8 WHEN 6 THEN 25000000 WHEN 7 THEN 4000 ELSE 300 END AS bytes_streamed",
    "doc_order % 8 <> 7 AS complete",
    "page_id % 50 = 7 AS canceled",
]
# distinct image ids -> measured dimensions, known sizes, running probes
_DIGIT = lambda k: f"ascii(substring(id, {k}, 1))"
MEASURED = ["id", f"CAST(100 + {_DIGIT(15)} AS BIGINT) AS w", f"CAST(50 + {_DIGIT(14)} AS BIGINT) AS h"]
MEASURED_WHERE = f"{_DIGIT(16)} % 3 = 0"
SIZES = [
    "id",
    f"CASE {_DIGIT(13)} % 4 WHEN 0 THEN 'known' WHEN 1 THEN 'unknown-length' ELSE 'failed' END AS size_state",
    f"CASE {_DIGIT(13)} % 4 WHEN 0 THEN CAST(30000 * {_DIGIT(12)} AS BIGINT) END AS bytes",
]
SIZES_WHERE = f"{_DIGIT(13)} % 4 < 3"
PENDING_WHERE = f"{_DIGIT(11)} % 3 = 0"
SELECTED = "doc_order % 3 = 0"
# manifest -> ground truth: exact, variant, (left out), miss; some are beacons
TRUTH = [
    "page_id",
    "CASE doc_order % 4 WHEN 0 THEN url WHEN 1 THEN CASE WHEN url LIKE 'data:%' THEN url ELSE split_part(url, '?', 1) || '?v=9' END "
    "ELSE 'https://elsewhere.example/' || page_id || '/' || doc_order || '.jpg' END AS url",
    "CASE WHEN doc_order % 10 = 9 THEN 1 ELSE 300 END AS w",
    "CASE WHEN doc_order % 10 = 9 THEN 1 ELSE 200 END AS h",
]
TRUTH_WHERE = "doc_order % 4 <> 2"
# pages x hop number -> fetch log
_LAST = "hop = page_id % 5"
_TRAP = "page_id % 7 = 3"
# From the second redirect on the chain is on a host below the page's, named by the page.
_ELSEWHERE = f"replace({ORIGIN}, '://', '://' || repeat('r', CAST(1 + page_id % 7 AS INT)) || '.')"
HOPS = [
    "page_id AS req", "hop",
    f"CASE WHEN hop = 0 THEN url WHEN {_LAST} AND {_TRAP} THEN 'http://2130706433/' WHEN hop = 1 THEN {ORIGIN} || '/r1' ELSE {_ELSEWHERE} || '/r' || hop END AS url",
    f"CASE WHEN NOT ({_LAST}) OR page_id % 6 = 2 THEN 302 ELSE 200 END AS status",
    f"CASE WHEN {_LAST} THEN NULL WHEN hop + 1 = page_id % 5 AND {_TRAP} THEN 'http://2130706433/' "
    f"WHEN hop = 1 THEN {_ELSEWHERE} || '/r2' ELSE '/r' || (hop + 1) END AS location",
]
# hosts of the fetch log -> operator list lines
HOP_LINES = ["CASE WHEN host LIKE 'rrr.%' OR host LIKE 'rrrr.%' THEN upper(host) ELSE '# ' || host END AS line"]
# distinct hosts x (A, AAAA) -> DNS answers
DNS = [
    "host", "qtype",
    "CASE WHEN length(host) % 7 = 4 THEN 3 WHEN length(host) % 7 = 5 THEN 2 ELSE 0 END AS status",
    "CASE WHEN qtype = 'A' THEN 0 ELSE 1 END AS ord",
    "CASE WHEN qtype = 'A' THEN CASE length(host) % 7 WHEN 0 THEN '93.184.216.34' WHEN 1 THEN '10.0.0.1' WHEN 2 THEN '93.184.216.34' "
    "WHEN 6 THEN 'garbage' END ELSE CASE length(host) % 7 WHEN 2 THEN 'fd00::1' END END AS data",
]
# manifest -> first bytes of images, by format
_B = "lpad(hex(doc_order % 256), 2, '0')"
PREFIX_HEX = (
    f"CASE doc_order % 10 WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || '000001' || {_B} || '000002' || {_B} "
    f"WHEN 1 THEN '474946383961' || {_B} || '01' || {_B} || '02' "
    f"WHEN 2 THEN '524946460000000057454250565038580A00000010000000' || {_B} || '0300' || {_B} || '0400' "
    f"WHEN 3 THEN 'FFD8FFE000104A46494600010100000100010000FFC0001108' || '01' || {_B} || '02' || {_B} || '03000000000000' "
    f"WHEN 4 THEN '000001000200' || '1010000000000000' || '0000000000000000' || {_B} || '20000000000000' || '0000000000000000' "
    f"WHEN 5 THEN '000000206674797061766966000000006D696631' || '0000001469737065' || '00000000' || '000001' || {_B} || '000003' || {_B} || '00000000' "
    f"WHEN 6 THEN hex('<svg xmlns=\"x\" width=\"' || (doc_order + 10) || 'px\" height=\"20.6\">') "
    f"WHEN 7 THEN 'DEADBEEF' WHEN 8 THEN hex('<svg width=\"100%\" height=\"5\"/>') ELSE '89504E470D0A1A0A0000' END"
)
PREFIXES = ["page_id", "id", "doc_order", f"unhex({PREFIX_HEX}) AS content"]
# bytes that follow the header in the image's file
FILE_TAIL = "CAST((page_id * 37 + doc_order * 211) % 10000 AS INT)"
