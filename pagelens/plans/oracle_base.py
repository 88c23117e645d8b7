"""Common table expressions of the DuckDB oracle.

Written independently of the Spark plans: attributes are cut out with simple patterns (the injected
markup always quotes them), every kind of markup is its own UNION branch, and the document is
tokenized by a plain regular expression.
"""

from __future__ import annotations

from ..constants import EXT_BY_MIME, EXT_BY_SUFFIX, GROUP_OF_SOURCE
from ..sources.derived import CRAWL_HTML

_ATTRS = r"""(?:[^'">]+|"[^"]*"|'[^']*')*"""
_RAW = "|".join(
    rf"<(?i:{t})(?:\s{_ATTRS})?>(?s:.*?)(?:</(?i:{t})\s*>|\z)" for t in ("script", "style", "noscript", "title")
)
_TOKEN = rf"(?s:<!--.*?-->)|{_RAW}|</?[a-zA-Z]{_ATTRS}>|<![^>]*>|[^<]+|<"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + " END"


def at(name: str, tok: str = "tag_text") -> str:
    return f"nullif(regexp_extract({tok}, {_q(chr(92) + 's' + name + '=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, 1), '')"


def css(expr: str) -> str:
    pattern = r"""url\(['"]?([^'")]*)['"]?\)"""
    return f"regexp_extract_all({expr}, {_q(pattern)}, 1)"


CRAWL = f"crawl AS (SELECT page_id, url, {CRAWL_HTML} AS html FROM pages)"

TOKENS = f"""{CRAWL},
tok0 AS (SELECT page_id, 0 AS frag, tok, pos FROM (
  SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(html, {_q(_TOKEN)}, 0) AS t FROM crawl)))"""

ELEMENTS = f"""{TOKENS},
bodies AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS frag,
    regexp_extract(tok, '^<noscript[^>]*>((?s:.*))</noscript>', 1) AS body
  FROM tok0 WHERE lower(tok) LIKE '<noscript%'),
tokn AS (SELECT page_id, frag, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos
  FROM (SELECT page_id, frag, regexp_extract_all(body, {_q(_TOKEN)}, 0) AS t FROM bodies WHERE trim(body) <> '')),
toks AS (SELECT page_id, frag, pos, tok, lower(regexp_extract(tok, '^<(/?[a-zA-Z0-9]+)', 1)) AS tag,
    CASE WHEN lower(tok) LIKE '<style%' OR lower(tok) LIKE '<script%' THEN regexp_extract(tok, '^<[^>]*>', 0)
         WHEN lower(tok) LIKE '<noscript%' OR lower(tok) LIKE '<title%' THEN '' ELSE tok END AS tag_text
  FROM (SELECT page_id, frag, pos, tok FROM tok0 UNION ALL SELECT page_id, frag, pos, tok FROM tokn)
  WHERE tok LIKE '<%' AND tok NOT LIKE '<!%'),
bases AS (SELECT page_id, arg_min({at('href')}, pos) AS base_href FROM toks
  WHERE tag = 'base' AND frag = 0 AND {at('href')} IS NOT NULL GROUP BY page_id),
docs AS (SELECT c.page_id, c.url AS page_url, coalesce(b.base_href, c.url) AS base
  FROM crawl c LEFT JOIN bases b USING (page_id)),
scoped AS (SELECT *, coalesce(last_value(CASE WHEN tag = 'picture' THEN 1 WHEN tag = '/picture' THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY page_id, frag ORDER BY pos), 0) AS inside FROM toks),
numbered AS (SELECT *, sum(CASE WHEN tag = 'picture' THEN 1 ELSE 0 END
      + CASE WHEN inside = 0 AND tag IN ('img', 'source') AND {at('srcset')} IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN inside = 0 AND {at('data-srcset')} IS NOT NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY page_id, frag ORDER BY pos) AS gno FROM scoped),
els AS (SELECT *, last_value(CASE WHEN tag = 'picture' THEN gno END IGNORE NULLS)
    OVER (PARTITION BY page_id, frag ORDER BY pos) AS pno,
    CASE WHEN {at('data-srcset')} IS NOT NULL AND inside = 0 THEN 1 ELSE 0 END AS lz FROM numbered)"""


def _set_rows(attr: str, tag: str, source: str, rank: int, grp: str, scale: bool) -> str:
    where = f"tag = '{tag}'" if tag else "true"
    h = f"floor(wd * CAST({at('height')} AS DOUBLE) / CAST({at('width')} AS DOUBLE) + 0.5)" if scale else "NULL"
    return f"""SELECT page_id, frag, pos, {rank} AS rk, ix, split_part(part, ' ', 1) AS raw, '{source}' AS source,
      wd AS width, CAST({h} AS BIGINT) AS height, {grp} AS grp FROM (
      SELECT *, TRY_CAST(nullif(regexp_extract(part, '\\s(\\d+)w$', 1), '') AS BIGINT) AS wd FROM (
        SELECT *, trim(unnest(string_split({at(attr)}, ','))) AS part,
          generate_subscripts(string_split({at(attr)}, ','), 1) AS ix
        FROM els WHERE {where} AND {at(attr)} IS NOT NULL))"""


def _one(tag: str, attr: str, source: str, rank: int, w: str = "NULL", h: str = "NULL", grp: str = "NULL", where: str = "true") -> str:
    t = f"tag = '{tag}'" if tag else "true"
    return f"""SELECT page_id, frag, pos, {rank} AS rk, 0 AS ix, {at(attr)} AS raw, '{source}' AS source,
      CAST({w} AS BIGINT) AS width, CAST({h} AS BIGINT) AS height, {grp} AS grp FROM els
      WHERE {t} AND {at(attr)} IS NOT NULL AND {where}"""


_KEY = f"lower(coalesce({at('property')}, {at('name')}))"
_OWN = "CASE WHEN inside = 1 THEN pno ELSE gno - lz END"
_LAZY = "CASE WHEN inside = 1 THEN pno ELSE gno END"
_DOUBLE_ENC = (
    "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
)

CANDIDATES = f"""{ELEMENTS},
metas AS (SELECT *, {_KEY} AS k, sum(CASE WHEN {_KEY} IN ('og:image', 'og:image:url', 'og:image:secure_url',
    'twitter:image', 'twitter:image:src') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, frag ORDER BY pos) AS sess
  FROM els WHERE tag = 'meta'),
meta_dims AS (SELECT page_id, frag, sess,
    arg_max(TRY_CAST({at('content')} AS BIGINT), pos) FILTER (k = 'og:image:width') AS mw,
    arg_max(TRY_CAST({at('content')} AS BIGINT), pos) FILTER (k = 'og:image:height') AS mh
  FROM metas GROUP BY ALL),
ld AS (SELECT page_id, frag, pos, regexp_extract(tok, '^<script[^>]*>((?s:.*))</script>', 1) AS j
  FROM els WHERE tag = 'script' AND tag_text LIKE '%ld+json%'),
svg AS (SELECT page_id, frag, max(pos) AS pos,
    string_agg(CASE WHEN tok LIKE '<%' THEN
        replace(CASE WHEN tag = 'svg' THEN replace(tok, '>', ' xmlns="http://www.w3.org/2000/svg">') ELSE tok END, 'viewbox', 'viewBox')
      ELSE replace(tok, '&', '&amp;') END, '' ORDER BY pos) AS markup
  FROM (SELECT t.page_id, 0 AS frag, t.pos, t.tok, lower(regexp_extract(t.tok, '^<(/?[a-zA-Z0-9]+)', 1)) AS tag,
      sum(CASE WHEN t.tok LIKE '<svg%' THEN 1 WHEN t.tok LIKE '</svg%' THEN -1 ELSE 0 END) OVER w AS depth,
      sum(CASE WHEN t.tok LIKE '<svg%' THEN 1 ELSE 0 END) OVER w AS island
    FROM tok0 t WINDOW w AS (PARTITION BY t.page_id ORDER BY t.pos))
  WHERE depth > 0 OR tag = '/svg' GROUP BY page_id, frag, island),
cand0 AS (
  {_one('img', 'src', 'img', 1, at('width'), at('height'), f"CASE WHEN inside = 1 THEN pno WHEN {at('srcset')} IS NOT NULL THEN gno - lz END")}
  UNION ALL {_set_rows('srcset', 'img', 'srcset', 1, _OWN, True)}
  UNION ALL {_set_rows('srcset', 'source', 'picture', 2, _OWN, False)}
  UNION ALL {_one('video', 'poster', 'poster', 3)}
  UNION ALL {_one('object', 'data', 'object', 4)}
  UNION ALL {_one('embed', 'src', 'embed', 5)}
  UNION ALL {_one('link', 'href', 'favicon', 6, f"regexp_extract({at('sizes')}, '([0-9]+)x', 1)", f"regexp_extract({at('sizes')}, 'x([0-9]+)', 1)", where=f"list_contains(string_split({at('rel')}, ' '), 'icon')")}
  UNION ALL SELECT m.page_id, m.frag, m.pos, 7, 0, {at('content', 'm.tag_text')}, 'meta',
      CASE WHEN k LIKE 'og:image%' THEN mw END, CASE WHEN k LIKE 'og:image%' THEN mh END, NULL
    FROM metas m JOIN meta_dims d USING (page_id, frag, sess)
    WHERE k IN ('og:image', 'og:image:url', 'og:image:secure_url', 'twitter:image', 'twitter:image:src')
  UNION ALL SELECT page_id, frag, pos, 8, generate_subscripts(u, 1), unnest(u), 'style-attr', NULL, NULL, NULL
    FROM (SELECT page_id, frag, pos, {css(at('style'))} AS u FROM els WHERE {at('style')} IS NOT NULL)
  UNION ALL SELECT page_id, frag, pos, 9, generate_subscripts(u, 1), unnest(u), 'style-block', NULL, NULL, NULL
    FROM (SELECT page_id, frag, pos, {css('tok')} AS u FROM els WHERE tag = 'style')
  UNION ALL SELECT page_id, frag, pos, 10, 1, json_extract_string(j, '$.image[0]'), 'json-ld', NULL, NULL, NULL FROM ld
  UNION ALL SELECT page_id, frag, pos, 10, 2, json_extract_string(j, '$.image[1].url'), 'json-ld',
      CAST(json_extract_string(j, '$.image[1].width') AS BIGINT),
      CAST(regexp_extract(json_extract_string(j, '$.image[1].height'), '^([0-9]+)', 1) AS BIGINT), NULL FROM ld
  UNION ALL SELECT page_id, frag, pos, 10, 3, json_extract_string(j, '$.author.image'), 'json-ld', NULL, NULL, NULL FROM ld
  UNION ALL SELECT page_id, frag, pos, 11, 0, 'data:image/svg+xml,' || {_DOUBLE_ENC.format('markup')}, 'inline-svg', NULL, NULL, NULL FROM svg
  UNION ALL {_one('', 'data-src', 'lazy', 12)}
  UNION ALL {_set_rows('data-srcset', '', 'lazy', 15, _LAZY, True)}
  UNION ALL SELECT page_id, frag, pos, 16, generate_subscripts(u, 1), unnest(u), 'lazy', NULL, NULL, NULL
    FROM (SELECT page_id, frag, pos, {css(at('data-bg'))} AS u FROM els WHERE {at('data-bg')} IS NOT NULL)),
cands AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY frag, pos, rk, ix) AS seq, trim(raw) AS raw,
    source, width, height, CASE WHEN grp IS NOT NULL THEN CASE WHEN frag > 0 THEN 'n' || (frag - 1) || '-' ELSE '' END
      || 'vg-' || grp END AS variant_group FROM cand0 WHERE trim(raw) <> '')"""


def resolve(raw: str, base: str) -> str:
    """Resolution of the forms that the injected markup uses."""
    absolute = (
        f"CASE WHEN {raw} LIKE 'data:image/%' THEN {raw} WHEN {raw} LIKE 'http%' THEN {raw} "
        f"WHEN regexp_matches({raw}, '^[a-z]+:') THEN NULL "
        f"WHEN {raw} LIKE '//%' THEN regexp_extract({base}, '^[a-z]+:', 0) || {raw} "
        f"WHEN {raw} LIKE '/%' THEN regexp_extract({base}, '^[a-z]+://[^/?#]+', 0) || {raw} "
        f"ELSE regexp_extract({base}, '^([a-z]+://[^/?#]+[^?#]*/)[^/?#]*', 1) || {raw} END"
    )
    return f"regexp_replace(regexp_replace({absolute}, '/[^/]+/\\.\\./', '/'), '#.*$', '')"


def sort_params(url: str) -> str:
    return (
        f"CASE WHEN {url} LIKE 'data:%' OR {url} NOT LIKE '%?%' THEN {url} ELSE split_part({url}, '?', 1) || '?' || "
        f"list_aggregate(list_sort(string_split(split_part({url}, '?', 2), '&')), 'string_agg', '&') END"
    )


def encoded(url: str) -> str:
    """Non-ASCII characters percent-encoded."""
    chars = f"list_transform(string_split({url}, ''), lambda c: CASE WHEN strlen(c) > 1 THEN url_encode(c) ELSE c END)"
    return f"CASE WHEN strlen({url}) > length({url}) THEN array_to_string({chars}, '') ELSE {url} END"


_SUFFIX = "lower(regexp_extract(regexp_replace({u}, '[?].*$', ''), '\\.([a-zA-Z0-9]+)$', 1))"
_EXT = (
    "coalesce(CASE WHEN {u} LIKE 'data:%' THEN "
    + _map(EXT_BY_MIME, "lower(regexp_extract({u}, '^data:image/([a-z0-9.+-]+)[;,]', 1))")
    + " ELSE "
    + _map(EXT_BY_SUFFIX, _SUFFIX)
    + " END, 'unknown')"
)


def ext(u: str) -> str:
    return _EXT.replace("{u}", u)


_FNV = (
    "lpad(lower(hex(CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, "
    "list_transform(string_split(url, ''), lambda c: ascii(c)::UHUGEINT)), "
    "lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT))), 16, '0')"
)


def manifest_cte(source: str = "cands", max_units: int = 1000, with_id: bool = True) -> str:
    ident = _FNV if with_id else "url"
    return f"""resolved AS (SELECT c.*, {sort_params('u0')} AS url FROM (
    SELECT c.*, {resolve('c.raw', 'd.base')} AS u0 FROM {source} c JOIN docs d USING (page_id)) c),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY seq) AS rn
    FROM resolved WHERE url IS NOT NULL) WHERE rn = 1),
units AS (SELECT *, min(seq) OVER (PARTITION BY page_id, coalesce('g:' || variant_group, 'u:' || url)) AS us FROM firsts),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY us) AS uno FROM units),
named AS (SELECT *, {ext('url')} AS ext, sum(CASE WHEN url LIKE 'data:%' THEN 1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY seq) AS ino FROM ranked WHERE uno <= {max_units}),
named2 AS (SELECT *, CASE WHEN url LIKE 'data:%' THEN 'inline-' || ino || CASE WHEN ext = 'unknown' THEN '' WHEN ext = 'jpeg' THEN '.jpg' ELSE '.' || ext END
    ELSE regexp_extract(regexp_replace(url, '[?].*$', ''), '([^/]+)/*$', 1) END AS nm FROM named),
named3 AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(nm) ORDER BY seq) AS nno FROM named2),
man AS (SELECT page_id, {ident} AS id, url, CASE WHEN nno = 1 THEN nm ELSE regexp_replace(nm, '(\\.[^.]*)$', '-' || nno || '\\1') END AS filename,
    ext, source, width, height, CASE WHEN width IS NOT NULL OR height IS NOT NULL THEN 'declared' END AS dimension_source,
    variant_group, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS doc_order FROM named3)"""


MANIFEST = f"{CANDIDATES}, {manifest_cte()}"
GROUPS = "CASE source " + " ".join(f"WHEN '{s}' THEN '{g}'" for s, g in GROUP_OF_SOURCE.items()) + " END"
