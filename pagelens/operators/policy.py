"""Crawl policy: URL admission, robots rules, host blocklist, DNS verdicts, redirect audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import ERROR_CATALOG, MAX_REDIRECTS, MAX_REQUESTS_PER_SCAN, RATE_MESSAGES
from ..functions import hosts as A
from ..functions.sqltext import extract, q, rlike, settled, sub
from ..functions.urls import HOST_OK, HOST_PORT, NUMERIC_HOST, canonical_host, canonical_url_host, cleaned, split_absolute, url_host, with_resolved
from .skew import join_dimension


def admit(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``ok, reason, detail`` (and ``host``): the first failing admission rule is the reason.

    Rules in order: parseable, http(s), port 80/443, no reserved address literal in any spelling,
    no internal host name. Hosts are judged in their canonical form, which is what browsers connect to.
    An input column ``host`` is replaced. Everything is a projection; no shuffle.
    """
    keep = [f"`{c}`" for c in df.columns if c != "host"]
    s = df.selectExpr(*keep, f"translate({cleaned(f'`{url}`')}, {q(chr(92))}, '/') AS _url")
    scheme = f"lower({extract('_url', r'^([a-zA-Z][a-zA-Z0-9+.\-]*):')})"
    authority = extract("_url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/*([^/?#]*)")
    s = s.selectExpr(*keep, f"{scheme} AS _scheme", f"{sub(authority, '^.*@', '')} AS _hostport")
    port = f"CASE WHEN {rlike('_hostport', ':[0-9]{1,9}$')} THEN CAST({extract('_hostport', ':([0-9]+)$')} AS INT) END"
    host = sub(canonical_host(extract("_hostport", r"^(\[[^\]]*\]|[^:]*)")), r"\.$", "")
    s = s.selectExpr("*", f"{host} AS host", f"{port} AS _port")
    s = s.selectExpr(
        "*",
        f"{A.ipv4_literal('host')} AS _v4",
        f"CASE WHEN {rlike('host', r'^\[.*\]$')} THEN {A.ipv6_groups(sub('host', r'^\[|\]$', ''))} END AS _v6",
        f"coalesce({rlike('_hostport', HOST_PORT)} AND {rlike('host', HOST_OK)}, false) AS _shape",
        # A host whose last label is a number must be an IPv4 address.
        f"{rlike('host', NUMERIC_HOST)} AS _numeric",
    )
    v4, v6 = A.reserved_v4("_v4"), A.reserved_v6("_v6")
    default = "CASE WHEN _scheme = 'https' THEN 443 ELSE 80 END"
    s = s.selectExpr(
        *keep, "host",
        f"""CASE
          WHEN _scheme = '' THEN 'invalid-url'
          WHEN _scheme NOT IN ('http', 'https') THEN 'bad-scheme'
          WHEN NOT _shape OR (_numeric AND _v4 IS NULL) OR coalesce(_port, 0) > 65535 THEN 'invalid-url'
          WHEN coalesce(_port, {default}) NOT IN (80, 443) THEN 'bad-port'
          WHEN startswith(host, '[') AND _v6 IS NULL THEN 'invalid-url'
          WHEN {v6} IS NOT NULL OR {v4} IS NOT NULL THEN 'private-ip'
          WHEN {A.internal_name('host')} THEN 'blocked-hostname' END AS reason""",
        f"coalesce({v6}, {v4}) AS range",
    )
    detail = (
        "CASE reason WHEN 'private-ip' THEN concat(CASE WHEN startswith(host, '[') THEN 'IPv6' ELSE 'IPv4' END, "
        "' literal in reserved range ', range) ELSE reason END"
    )
    return settled(s, [*keep, "host"], {"ok": "reason IS NULL", "reason": "reason", "detail": detail})


def robots_rules(robots: DataFrame, agent: str, max_bytes: int | None = None) -> DataFrame:
    """``origin, pos, allow, pattern`` for our agent, from ``robots(origin, status, body)``.

    Own-agent groups (exact name) replace the ``*`` groups, even when they hold no rule. A file cut at
    ``max_bytes``, if given, loses its partial last line. All windows run within one origin's file, which is one row.
    """
    capped = f"octet_length(body) > {max_bytes}"
    head = f"make_valid_utf8(CAST(substring(CAST(body AS BINARY), 1, {max_bytes}) AS STRING))"
    text = "body" if max_bytes is None else f"CASE WHEN {capped} THEN {sub(head, r'[^\n]*\z', '')} ELSE body END"
    lines = robots.filter("status BETWEEN 200 AND 299").selectExpr(
        "origin", f"split({sub(text, r'^\x{feff}', '')}, {q(r'\r\n|\r|\n')}) AS lines"
    )
    rows = lines.select("origin", F.posexplode_outer("lines").alias("pos", "line"))
    rows = rows.selectExpr("origin", "pos", f"trim({q(' ' + chr(9))} FROM {sub('line', '#.*$', '')}) AS line")
    rows = rows.filter("instr(line, ':') > 0").selectExpr(
        "origin", "pos",
        "lower(trim(substring(line, 1, instr(line, ':') - 1))) AS field",
        f"trim({q(' ' + chr(9))} FROM substring(line, instr(line, ':') + 1)) AS value",
    )
    rows = rows.filter("field IN ('user-agent', 'allow', 'disallow')")
    rows = rows.selectExpr(
        "*",
        "CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY origin ORDER BY pos), '') "
        "<> 'user-agent' THEN 1 ELSE 0 END AS opens",
    )
    rows = rows.selectExpr("*", "sum(opens) OVER (PARTITION BY origin ORDER BY pos) AS grp")
    name = "field = 'user-agent' AND lower(value) = "
    rows = rows.selectExpr(
        "*",
        f"bool_or({name}{q(agent.lower())}) OVER (PARTITION BY origin, grp) AS own",
        f"bool_or({name}'*') OVER (PARTITION BY origin, grp) AS star",
        f"bool_or({name}{q(agent.lower())}) OVER (PARTITION BY origin) AS any_own",
    )
    return rows.filter("field <> 'user-agent' AND value <> '' AND CASE WHEN any_own THEN own ELSE star END").selectExpr(
        "origin", "pos", "field = 'allow' AS allow", "value AS pattern"
    )


def _matches(pattern: str, path: str) -> str:
    """Robots pattern test without regular expressions: linear whatever the number of ``*``."""
    anchored = f"endswith({pattern}, '$')"
    segs = f"split(CASE WHEN {anchored} THEN left({pattern}, length({pattern}) - 1) ELSE {pattern} END, '[*]', -1)"
    middle = f"slice(g_, 2, greatest(size(g_) - 1 - CAST({anchored} AS INT), 0))"
    hit = f"locate(x_, {path}, acc_ + 1)"
    pos = (
        f"aggregate({middle}, length(g_[0]), (acc_, x_) -> CASE WHEN acc_ < 0 THEN -1 WHEN x_ = '' THEN acc_ "
        f"WHEN {hit} = 0 THEN -1 ELSE {hit} - 1 + length(x_) END)"
    )
    last = "element_at(g_, -1)"
    end = (
        f"CASE WHEN NOT {anchored} THEN true WHEN size(g_) = 1 THEN {path} = g_[0] WHEN {last} = '' THEN true "
        f"ELSE endswith({path}, {last}) AND length({path}) - length({last}) >= {pos} END"
    )
    return f"transform(array({segs}), g_ -> startswith({path}, g_[0]) AND {pos} >= 0 AND {end})[0]"


def robots_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``robots_allowed``: the longest matching pattern decides, Allow wins ties.

    Rules are gathered per origin, whose file is one row, so a page joins one row however many rules its
    site has; the pages of a large site are split by size.
    """
    per_origin = rules.groupBy("origin").agg(F.collect_list(F.struct("allow", "pattern")).alias("rules"))
    rows = pages.selectExpr(
        "*", f"{split_absolute('url')} AS _u"
    ).selectExpr(
        "*", "concat(_u.scheme, '://', _u.authority) AS origin",
        "concat(_u.path, CASE WHEN _u.query = '' THEN '' ELSE concat('?', _u.query) END) AS _path",
    )
    joined = join_dimension(rows, per_origin, ["origin"])
    best = (
        f"array_max(transform(filter(rules, r_ -> {_matches('r_.pattern', '_path')}), "
        "r_ -> struct(length(r_.pattern) AS n, r_.allow AS allow)))"
    )
    keep = [f"`{c}`" for c in pages.columns]
    return joined.selectExpr(*keep, "origin", f"coalesce({best}.allow, true) AS robots_allowed")


def blocklist_entries(lines: DataFrame) -> DataFrame:
    """``entry`` hosts from an operator list: comments, schemes, paths, ports and dots forgiven."""
    raw = lines.selectExpr(f"lower({sub('line', r'^\s+|\s+$', '')}) AS raw").filter("raw <> '' AND left(raw, 1) <> '#'")
    bare = sub(f"split({sub('raw', r'^[a-z][a-z0-9+.\-]*://', '')}, '/')[0]", r"\.$", "")
    hosts = raw.selectExpr(f"{sub(sub(bare, '^.*@', ''), r':[0-9]*$', '')} AS host")
    return hosts.selectExpr(f"{canonical_host('host')} AS entry").filter(rlike("entry", HOST_OK)).distinct()


def blocked_hosts(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct hosts equal to an entry or below one: the suffixes of a host turn it into an equi join."""
    labels = "split(host, '[.]')"
    suffixes = f"transform(sequence(1, size({labels})), i_ -> array_join(slice({labels}, i_, size({labels})), '.'))"
    rows = hosts.select("host").distinct().selectExpr("host", f"explode({suffixes}) AS entry")
    return rows.join(entries, "entry", "left_semi").select("host").distinct()


def without_blocked(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages whose host, in canonical form, is not blocked."""
    rows = pages.selectExpr("*", f"{sub(canonical_url_host('url'), r'\.$', '')} AS __host")
    blocked = blocked_hosts(rows.select(F.col("__host").alias("host")), entries)
    marked = join_dimension(rows, blocked.selectExpr("host AS __host", "true AS __hit"), ["__host"])
    return marked.filter("__hit IS NULL").select(*(F.col(f"`{c}`") for c in pages.columns))


def dns_verdicts(answers: DataFrame) -> DataFrame:
    """``host, reason`` from ``dns_answers(host, qtype, status, ord, data)``; NULL reason = usable.

    The first bad answer decides; without any address a clean status means the domain has none.
    """
    v4, v6 = A.dotted_quad("data"), A.ipv6_groups("data")
    rows = answers.selectExpr("host", "qtype", "status", "ord", "data", f"{v4} AS _v4", f"{v6} AS _v6")
    rows = rows.selectExpr(
        "host", "status", "ord",
        f"""CASE WHEN data IS NULL THEN NULL
          WHEN qtype = 'A' AND _v4 IS NULL THEN 'dns-error' WHEN qtype = 'AAAA' AND _v6 IS NULL THEN 'dns-error'
          WHEN qtype = 'A' AND {A.reserved_v4('_v4')} IS NOT NULL THEN 'dns-private'
          WHEN qtype = 'AAAA' AND {A.reserved_v6('_v6')} IS NOT NULL THEN 'dns-private' END AS bad""",
        "data IS NOT NULL AND qtype IN ('A', 'AAAA') AS addr",
    )
    agg = rows.groupBy("host").agg(
        F.expr("min_by(bad, CASE WHEN bad IS NOT NULL THEN ord END) AS bad"),
        F.expr("bool_or(addr) AS addr"),
        F.expr("bool_and(status IN (0, 3)) AS clean"),
    )
    return agg.selectExpr(
        "host",
        "CASE WHEN bad IS NOT NULL THEN bad WHEN addr THEN NULL WHEN clean THEN 'dns-nxdomain' ELSE 'dns-error' END AS reason",
    )


def hop_verdicts(hops: DataFrame, entries: DataFrame | None = None, dns: DataFrame | None = None) -> DataFrame:
    """Add ``reason`` to rows with a ``url``: the first of admission, operator list and DNS that rejects the hop's host.

    ``entries`` are list hosts, ``dns`` has ``host, reason`` (see ``dns_verdicts``); hosts that are addresses need no
    lookup. Both tables meet the distinct hosts, so a host with a large share of the hops is one row of each.
    """
    rows = admit(hops)
    keep = [f"`{c}`" for c in rows.columns if c not in ("ok", "reason", "detail", "host")]
    if entries is not None:
        rows = join_dimension(rows, blocked_hosts(rows.filter("ok"), entries).selectExpr("host", "'domain-blocked' AS _listed"), ["host"])
    if dns is not None:
        rows = join_dimension(rows, dns.filter("reason IS NOT NULL").selectExpr("host", "reason AS _looked_up"), ["host"])
    listed = "_listed" if entries is not None else "NULL"
    looked_up = f"CASE WHEN NOT startswith(host, '[') AND {A.ipv4_literal('host')} IS NULL THEN _looked_up END" if dns is not None else "NULL"
    return rows.selectExpr(*keep, f"coalesce(reason, {listed}, {looked_up}) AS reason")


def redirect_chains(
    hops: DataFrame, max_redirects: int = MAX_REDIRECTS, entries: DataFrame | None = None, dns: DataFrame | None = None
) -> DataFrame:
    """Audit of logged fetch hops ``(req, hop, url, status, location)``.

    Every hop is judged again, by admission and, if given, by the operator's list and DNS; the first hop that any of them
    rejects gives the reason, and a redirect to a Location that is no URL rejects the hop it leads to as ``invalid-url``.
    A redirect status without a Location is final. More than ``max_redirects`` redirects reject the request.
    """
    audited = hop_verdicts(hops, entries, dns)
    base = with_resolved(
        audited.selectExpr("*", f"{split_absolute('url')} AS _base", "coalesce(location, '') AS _loc"),
        "_loc", "_base", "next_url", sort=False,
    )
    redirects = "status IN (301, 302, 303, 307, 308) AND location IS NOT NULL"
    lost = f"CASE WHEN {redirects} AND next_url IS NULL AND hop < {max_redirects} THEN 'invalid-url' END"
    agg = base.groupBy("req").agg(
        F.expr(f"min_by(coalesce(reason, {lost}), CASE WHEN (reason IS NOT NULL AND hop <= {max_redirects}) OR {lost} IS NOT NULL THEN hop END) AS rejected"),
        F.expr(f"count_if({redirects}) AS redirects"),
        F.expr(f"max_by(CASE WHEN {redirects} THEN next_url ELSE url END, hop) AS final_url"),
        F.expr("count(*) AS hops"),
    )
    return agg.selectExpr(
        "req", "hops", "redirects",
        f"coalesce(rejected, CASE WHEN redirects > {max_redirects} THEN 'too-many-redirects' END) AS reason",
        "final_url",
    )


def fetch_volume(fetches: DataFrame, limit: int = MAX_REQUESTS_PER_SCAN) -> DataFrame:
    """Requests per scan from its fetches ``(req, url)``: each fetch, two lookups per distinct host, one list read."""
    hosts = fetches.selectExpr("req", f"{url_host('url')} AS host")
    n = F.count("*") + 2 * F.count_distinct("host") + 1
    return hosts.groupBy("req").agg(n.alias("n")).withColumn("over", F.col("n") > limit)


def error_catalog(spark) -> DataFrame:
    """The fixed outcome catalog (17 rows)."""
    rows = [(code, *entry) for code, entry in ERROR_CATALOG.items()]
    return spark.createDataFrame(rows, "code string, http_status int, message string, retryable boolean")


def with_catalog(outcomes: DataFrame, code: str = "code") -> DataFrame:
    """Add HTTP status, message and retry flag; unknown codes are 500 and not retryable."""
    # The catalog is a constant of 17 rows, so broadcasting it is bounded.
    dim = F.broadcast(error_catalog(outcomes.sparkSession).withColumnRenamed("code", code))
    rows = outcomes.join(dim, code, "left")
    return rows.withColumns(
        {"http_status": F.expr("coalesce(http_status, 500)"), "retryable": F.expr("coalesce(retryable, false)")}
    )


def with_rate_messages(judged: DataFrame) -> DataFrame:
    """Catalog entries of requests that a rate limit rejected, with the message of their ``kind`` and waiting time."""
    minutes = "greatest(1, CAST(ceil(retry_after / 60) AS BIGINT))"
    wait = f"concat(CAST({minutes} AS STRING), ' minute', CASE WHEN {minutes} = 1 THEN '' ELSE 's' END)"
    message = " ".join(f"WHEN {q(kind)} THEN replace({q(text)}, '{{m}}', {wait})" for kind, text in RATE_MESSAGES.items())
    rows = with_catalog(judged.filter("NOT admitted").withColumn("code", F.lit("rate-limited")))
    return rows.withColumn("message", F.expr(f"CASE kind {message} END"))
