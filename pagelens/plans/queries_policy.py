"""Registered queries: admission, robots, blocklist, DNS, redirects, errors, rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ERROR_CATALOG, RESERVED_V4
from ..functions import hosts as A
from ..operators import policy as P, rate as R
from ..sources import derived as D
from ..streaming import jobs as S
from .queries_extract import COLS, MAN
from .registry import add

AGENT = "pagelens"


def origins(s, d):
    return D.read_pages(s, d).selectExpr(f"{D.ORIGIN} AS origin").distinct()


def robots(s, d):
    return origins(s, d).selectExpr(*D.ROBOTS)


def listed(s, d):
    return D.read_pages(s, d).selectExpr(*D.LISTED)


def block_lines(s, d):
    return listed(s, d).selectExpr(f"{D.HOST} AS host").distinct().selectExpr(*D.BLOCK_LINES)


def audit(s, d):
    return D.read_pages(s, d).selectExpr(*D.AUDIT)


ROBOTS_SQL = f"""robots AS (SELECT {', '.join(D.ROBOTS)} FROM (SELECT DISTINCT {D.ORIGIN} AS origin FROM pages)),
rlines AS (SELECT origin, generate_subscripts(l, 1) - 1 AS pos, trim(regexp_replace(unnest(l), '#.*$', '')) AS line
  FROM (SELECT origin, string_split(body, chr(10)) AS l FROM robots WHERE status BETWEEN 200 AND 299)),
rfields AS (SELECT origin, pos, lower(trim(split_part(line, ':', 1))) AS field, trim(substring(line, strpos(line, ':') + 1)) AS value
  FROM rlines WHERE strpos(line, ':') > 0),
rkept AS (SELECT * FROM rfields WHERE field IN ('user-agent', 'allow', 'disallow')),
rgroups AS (SELECT *, sum(opens) OVER (PARTITION BY origin ORDER BY pos) AS g FROM (
  SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY origin ORDER BY pos), 'x') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM rkept)),
own AS (SELECT DISTINCT origin, g FROM rgroups WHERE field = 'user-agent' AND lower(value) = '{AGENT}'),
star AS (SELECT DISTINCT origin, g FROM rgroups WHERE field = 'user-agent' AND value = '*'),
chosen AS (SELECT * FROM own UNION SELECT * FROM star WHERE origin NOT IN (SELECT origin FROM own)),
rules AS (SELECT origin, pos, field = 'allow' AS allow, value AS pattern FROM rgroups JOIN chosen USING (origin, g)
  WHERE field <> 'user-agent' AND value <> '')"""
_PATH = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) END"
_LIKE = "replace(replace(replace(replace(CASE WHEN pattern LIKE '%$' THEN left(pattern, length(pattern) - 1) ELSE pattern || '*' END, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%')"
VERDICT_SQL = f"""{ROBOTS_SQL}, judged AS (SELECT p.page_id, p.url, coalesce(arg_max(allow, length(pattern) * 2 + CASE WHEN allow THEN 1 ELSE 0 END), true) AS robots_allowed
  FROM (SELECT page_id, url, {D.ORIGIN} AS origin, {_PATH} AS path FROM pages) p
  LEFT JOIN rules r ON r.origin = p.origin AND p.path LIKE {_LIKE} ESCAPE '!' GROUP BY ALL)"""

add("scan_robots",
    lambda s, d: robots(s, d).selectExpr("origin", "status", "CAST(length(body) AS BIGINT) AS chars", "status BETWEEN 200 AND 299 AS usable"),
    f"WITH {ROBOTS_SQL} SELECT origin, status, length(body) AS chars, status BETWEEN 200 AND 299 AS usable FROM robots")
add("robots_rules",
    lambda s, d: P.robots_rules(robots(s, d), AGENT).selectExpr("origin", "CAST(pos AS BIGINT) AS pos", "allow", "pattern"),
    f"WITH {ROBOTS_SQL} SELECT origin, pos, allow, pattern FROM rules")
add("join_robots",
    lambda s, d: P.robots_verdicts(D.read_pages(s, d), P.robots_rules(robots(s, d), AGENT)).select("page_id", "robots_allowed"),
    f"WITH {VERDICT_SQL} SELECT page_id, robots_allowed FROM judged")

# The only internationalized name, in its spellings and in ASCII.
_NAMED = lambda host: f"regexp_replace({host}, '(?i)(bücher|b%C3%BCcher|ｂücher)(。|[.])example', 'xn--bcher-kva.example')"
BLOCK_SQL = f"""listed AS (SELECT {', '.join(D.LISTED)} FROM pages),
lines AS (SELECT {', '.join(D.BLOCK_LINES)} FROM (SELECT DISTINCT {D.HOST} AS host FROM listed)),
entries AS (SELECT DISTINCT {_NAMED("regexp_replace(split_part(regexp_replace(lower(trim(line)), '^[a-z]+://', ''), '/', 1), '[.]$', '')")} AS entry
  FROM lines WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%')"""
add("scan_blocklist", lambda s, d: P.blocklist_entries(block_lines(s, d)), f"WITH {BLOCK_SQL} SELECT entry FROM entries")
add("join_blocklist",
    lambda s, d: P.without_blocked(listed(s, d), P.blocklist_entries(block_lines(s, d))).select("page_id", "url"),
    f"""WITH {BLOCK_SQL} SELECT page_id, url FROM listed p WHERE NOT EXISTS (SELECT 1 FROM entries e
      WHERE {_NAMED(D.HOST)} = e.entry OR {_NAMED(D.HOST)} LIKE '%.' || e.entry)""")

_RES = " OR ".join(f"{{ip}} BETWEEN {b} AND {b + 2 ** (32 - n) - 1}" for _, b, n in RESERVED_V4)
ADMIT_SQL = f"""audit AS (SELECT {', '.join(D.AUDIT)}, page_id % 20 AS k, {D._IP} AS ip FROM pages),
verdicts AS (SELECT page_id, raw, CASE k WHEN 1 THEN CASE WHEN {_RES.format(ip='ip')} THEN 'private-ip' END
    WHEN 2 THEN CASE WHEN {_RES.format(ip='ip')} THEN 'private-ip' END WHEN 3 THEN CASE WHEN {_RES.format(ip='ip')} THEN 'private-ip' END
    WHEN 4 THEN 'private-ip' WHEN 5 THEN CASE WHEN {_RES.format(ip='ip')} THEN 'private-ip' END WHEN 6 THEN 'bad-port'
    WHEN 7 THEN 'bad-scheme' WHEN 8 THEN 'blocked-hostname' WHEN 9 THEN 'blocked-hostname' WHEN 10 THEN 'invalid-url'
    WHEN 11 THEN 'private-ip' WHEN 12 THEN 'private-ip' WHEN 13 THEN 'private-ip' WHEN 16 THEN 'blocked-hostname'
    ELSE CASE WHEN k >= 14 THEN 'private-ip' END END AS reason FROM audit)"""
add("admit_urls", lambda s, d: P.admit(audit(s, d), "raw").select("page_id", "raw", "ok", "reason"),
    f"WITH {ADMIT_SQL} SELECT page_id, raw, reason IS NULL AS ok, reason FROM verdicts")
add("admission_report",
    lambda s, d: P.admit(audit(s, d), "raw").groupBy("reason").agg(F.count("*").alias("n")),
    f"WITH {ADMIT_SQL} SELECT reason, count(*) AS n FROM verdicts GROUP BY reason")
_CIDR = "CASE " + " ".join(f"WHEN ip BETWEEN {b} AND {b + 2 ** (32 - n) - 1} THEN '{c}'" for c, b, n in RESERVED_V4) + " END"
add("admit_ipv4",
    lambda s, d: D.read_pages(s, d).selectExpr("page_id", f"{D._IP} AS ip", "page_id % 4 AS k").selectExpr(
        "page_id", f"""CASE k WHEN 0 THEN CAST(ip AS STRING) WHEN 1 THEN concat('0x', hex(ip)) WHEN 2 THEN
          concat_ws('.', (ip >> 24) & 255, (ip >> 16) & 255, (ip >> 8) & 255, ip & 255)
          ELSE concat('0', conv(ip, 10, 8)) END AS host""").selectExpr("page_id", f"{A.ipv4_literal('host')} AS ip").selectExpr(
        "page_id", "ip", f"{A.reserved_v4('ip')} AS cidr"),
    f"SELECT page_id, ip, {_CIDR} AS cidr FROM (SELECT page_id, {D._IP} AS ip FROM pages)")
_V6 = ("CASE page_id % 6 WHEN 0 THEN 'fe80::' || lower(hex(page_id)) WHEN 1 THEN '2001:db8::' || lower(hex(page_id)) WHEN 2 THEN '::1' "
       "WHEN 3 THEN '2a00::' || lower(hex(page_id)) || ':1' WHEN 4 THEN '::ffff:10.0.0.' || (page_id % 256) ELSE '1:2:3:' || lower(hex(page_id)) END")
add("admit_ipv6",
    lambda s, d: D.read_pages(s, d).selectExpr("page_id", f"{_V6} AS lit").selectExpr(
        "page_id", "lit", f"{A.ipv6_groups('lit')} AS g").selectExpr("page_id", "lit", "g IS NOT NULL AS valid", f"{A.reserved_v6('g')} AS cidr"),
    f"""SELECT page_id, lit, page_id % 6 <> 5 AS valid, CASE page_id % 6 WHEN 0 THEN 'fe80::/10' WHEN 1 THEN '2001:db8::/32' WHEN 2 THEN '::1'
      WHEN 4 THEN 'IPv4-in-IPv6 10.0.0.0/8' END AS cidr FROM (SELECT page_id, {_V6} AS lit FROM pages)""")


def hops(s, d):
    rows = D.read_pages(s, d).selectExpr("page_id", "url", "explode(sequence(0L, page_id % 5)) AS hop")
    return rows.selectExpr(*D.HOPS)


def fetches(s, d):
    """Fetches of each scan: the page's chain and its site's robots file."""
    chain = hops(s, d)
    return chain.select("req", "url").unionByName(chain.filter("hop = 0").selectExpr("req", f"{D.ORIGIN} || '/robots.txt' AS url"))


HOPS_SQL = f"hops AS (SELECT {', '.join(D.HOPS)} FROM (SELECT page_id, url, unnest(range(page_id % 5 + 1)) AS hop FROM pages))"


def hop_hosts(s, d):
    return hops(s, d).selectExpr(f"{D.HOST} AS host").distinct()


def dns_of(hosts):
    return hosts.selectExpr("host", "explode(array('A', 'AAAA')) AS qtype").selectExpr(*D.DNS)


_DNS_REASON = ("CASE length({0}) % 7 WHEN 1 THEN 'dns-private' WHEN 2 THEN 'dns-private' WHEN 3 THEN 'dns-nxdomain' "
               "WHEN 4 THEN 'dns-nxdomain' WHEN 5 THEN 'dns-error' WHEN 6 THEN 'dns-error' END")
CHAINS_SQL = f"""{HOPS_SQL}, judged_hops AS (SELECT *, CASE WHEN url = 'http://2130706433/' THEN 'private-ip' WHEN regexp_matches({D.HOST}, '^rrrr?[.]') THEN 'domain-blocked'
    ELSE {_DNS_REASON.format(D.HOST)} END AS bad FROM hops),
chains AS (SELECT req, count(*) AS hops, count(*) FILTER (status = 302 AND location IS NOT NULL) AS redirects,
    coalesce(arg_min(bad, hop) FILTER (bad IS NOT NULL AND hop <= 3), CASE WHEN count(*) FILTER (status = 302 AND location IS NOT NULL) > 3 THEN 'too-many-redirects' END) AS reason,
    arg_max(url, hop) AS final_url FROM judged_hops GROUP BY req)"""


def chains(s, d):
    """Every hop of the fetch log, judged by admission, an operator list and DNS answers for its host."""
    listed_hosts = P.blocklist_entries(hop_hosts(s, d).selectExpr(*D.HOP_LINES))
    audited = P.redirect_chains(hops(s, d), entries=listed_hosts, dns=P.dns_verdicts(dns_of(hop_hosts(s, d))))
    return audited.select("req", "hops", "redirects", "reason", "final_url")


add("w_redirect_chain", chains, f"WITH {CHAINS_SQL} SELECT * FROM chains")
add("fetch_volume",
    lambda s, d: P.fetch_volume(fetches(s, d), limit=8),
    f"""WITH {HOPS_SQL}, fetched AS (SELECT req, url FROM hops UNION ALL SELECT req, {D.ORIGIN} || '/robots.txt' FROM hops WHERE hop = 0)
    SELECT req, n, n > 8 AS over FROM (SELECT req, count(*) + 2 * count(DISTINCT {D.HOST}) + 1 AS n FROM fetched GROUP BY req)""")


def dns(s, d):
    return dns_of(D.read_pages(s, d).selectExpr(f"{D.HOST} AS host").distinct())


add("join_dns", lambda s, d: P.dns_verdicts(dns(s, d)),
    f"SELECT DISTINCT host, {_DNS_REASON.format('host')} AS reason FROM (SELECT {D.HOST} AS host FROM pages)")
_CATALOG = ", ".join(
    "('{}', {}, {}, {})".format(c, st, "NULL" if m is None else "'" + m.replace("'", "''") + "'", str(r).lower())
    for c, (st, m, r) in ERROR_CATALOG.items()
)


# A page's transfer outcome, from the length of its text and address.
_CODES = [*ERROR_CATALOG, "no-such-code"]
_SCAN_CODE = f"split_part('{','.join(_CODES)}', ',', CAST(1 + (length(html) + length(url)) % {len(_CODES)} AS INT))"


def failures(s, d):
    """Outcomes of all steps: admission, redirects with list and DNS, and one of the transfer and scan codes for each page."""
    from_admission = P.admit(audit(s, d), "raw").filter("NOT ok").selectExpr("page_id", "reason AS code")
    from_chains = chains(s, d).filter("reason IS NOT NULL").selectExpr("req AS page_id", "reason AS code")
    return from_admission.unionByName(from_chains).unionByName(D.read_pages(s, d).selectExpr("page_id", f"{_SCAN_CODE} AS code"))


add("join_error_catalog",
    lambda s, d: P.with_catalog(failures(s, d)).select(
        "page_id", "code", F.col("http_status").cast("bigint").alias("http_status"), "message", "retryable"),
    f"""WITH {ADMIT_SQL}, {CHAINS_SQL}, cat(code, http_status, message, retryable) AS (VALUES {_CATALOG}),
    failed AS (SELECT page_id, reason AS code FROM verdicts WHERE reason IS NOT NULL UNION ALL SELECT req, reason FROM chains WHERE reason IS NOT NULL
      UNION ALL SELECT page_id, {_SCAN_CODE} FROM pages)
    SELECT page_id, f.code, CAST(coalesce(http_status, 500) AS BIGINT) AS http_status, message, coalesce(retryable, false) AS retryable FROM failed f LEFT JOIN cat ON cat.code = f.code""")

# -- request log -------------------------------------------------------------------------------
DAY = 86_400_000


def requests(s, d):
    ev = D.spread(s.read.parquet(f"{d}/events.parquet"))
    millis = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"
    return ev.selectExpr(
        "event_id AS request_id", "event_type AS kind",
        "CASE WHEN user_id % 50 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS client", f"{millis} AS ts_ms")


REQ_SQL = """req AS (SELECT event_id AS request_id, event_type AS kind,
    CASE WHEN user_id % 50 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS client, epoch_us(ts) // 1000 AS ts_ms FROM events)"""
RATE_SQL = f"""WITH RECURSIVE {REQ_SQL},
wins AS (SELECT kind, client, min(ts_ms) AS start FROM req WHERE client IS NOT NULL GROUP BY kind, client
  UNION ALL SELECT w.kind, w.client, min(r.ts_ms) FROM wins w JOIN req r ON r.kind = w.kind AND r.client = w.client AND r.ts_ms >= w.start + {DAY}
  GROUP BY w.kind, w.client),
placed AS (SELECT r.*, max(w.start) AS start FROM req r JOIN wins w ON r.kind = w.kind AND r.client = w.client AND w.start <= r.ts_ms GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY kind, client, start ORDER BY ts_ms, request_id) AS n FROM placed)
SELECT request_id, kind, client, ts_ms, n <= 2 AS admitted,
  CASE WHEN n > 2 THEN CAST(greatest(1, ceil((start + {DAY} - ts_ms) / 1000.0)) AS BIGINT) END AS retry_after FROM numbered
UNION ALL SELECT request_id, kind, client, ts_ms, true, NULL FROM req WHERE client IS NULL"""
add("rate_limit", lambda s, d: R.rate_limit(requests(s, d), 2, DAY), RATE_SQL)
add("session_cost",
    lambda s, d: R.session_cost(requests(s, d).filter("client IS NOT NULL"), 6 * 3_600_000, 3).selectExpr(
        "client", "start_ms", "end_ms", "n_requests", "cost", "over_allowance"),
    f"""WITH {REQ_SQL}, f AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY client ORDER BY ts_ms, request_id) < 21600000 THEN 0 ELSE 1 END AS o
      FROM req WHERE client IS NOT NULL),
    g AS (SELECT *, sum(o) OVER (PARTITION BY client ORDER BY ts_ms, request_id) AS sn FROM f)
    SELECT client, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n_requests, count(*) AS cost, count(*) > 3 AS over_allowance
    FROM g GROUP BY client, sn""")

# -- streams -----------------------------------------------------------------------------------
add("stream_volume",
    lambda s, d: S.upserted(S.request_volume(S.event_stream(s, d)), "stream-volume", ["window_ms", "kind"]),
    """SELECT epoch_ms(date_trunc('hour', ts)) AS window_ms, event_type AS kind, count(*) AS n FROM events GROUP BY ALL""")
add("stream_sessions", lambda s, d: S.sessions_once(s, S.event_requests(s, d), 6 * 3_600_000),
    f"""WITH {REQ_SQL}, f AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY client ORDER BY ts_ms, request_id) < 21600000 THEN 0 ELSE 1 END AS o
      FROM req WHERE client IS NOT NULL),
    g AS (SELECT *, sum(o) OVER (PARTITION BY client ORDER BY ts_ms, request_id) AS sn FROM f)
    SELECT client, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n_requests FROM g GROUP BY client, sn""")
add("stream_manifest", lambda s, d: S.manifest_once(s, d), MAN + f"SELECT {COLS} FROM man")
add("stream_rate_limit", lambda s, d: S.rate_limit_once(s, S.event_requests(s, d), 2, DAY), RATE_SQL)
