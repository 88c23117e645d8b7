"""URL splitting, joining and normalization as native column expressions (SQL text).

Covers what web pages use: scheme-relative, path-absolute, query and relative references, dot
segments, backslashes, default ports, percent-encoding of unsafe path characters and the
form-urlencoded re-serialization of sorted query parameters, and canonical hosts: percent-decoded,
mapped to ASCII (full-width and other compatibility forms, internationalized names) and, where the
last label is a number, written as a dotted IPv4 address. Names are mapped by the JVM's IDNA 2003
tables, in which four letters (sharp s, final sigma, two joiners) have plain forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .hosts import ipv4_literal
from .sqltext import extract, q, rlike, settled, sub

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
HOST_OK = r"^(?:\[[0-9a-f:.]+\]|[^\x00-\x20#/:<>?@\[\\\]^|%\x7f]+)$"
#: A host and a port, of any characters.
HOST_PORT = r"^(?:\[[^\]]*\]|[^:]*)(?::[0-9]*)?$"
#: The last label is a number, so the host must be an IPv4 address.
NUMERIC_HOST = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"
_JS_SPACE = r"[\s\x0B\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def js_trim(s: str) -> str:
    """Strip white space as browsers do, no-break space and BOM included."""
    ends = f"{rlike(f'left({s}, 1)', _JS_SPACE)} OR {rlike(f'right({s}, 1)', _JS_SPACE)}"
    trimmed = sub(s, rf"^{_JS_SPACE}++|{_JS_SPACE}++\z", "")
    return f"CASE WHEN {ends} THEN {trimmed} ELSE {s} END"


def cleaned(raw: str) -> str:
    """Without white space and controls at the ends, and without tabs and line ends anywhere, as URL parsers read it."""
    s = sub(raw, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    dirty = rlike(raw, r"[\x00-\x20]")
    return f"CASE WHEN {dirty} THEN {sub(s, r'[\t\n\r]', '')} ELSE {raw} END"


def canonical_host(raw: str) -> str:
    """Host in ASCII and lower case, NULL where it has no such form; only hosts with other characters are mapped."""
    mapped = "lower(try_reflect('java.net.IDN', 'toASCII', d_))"
    decoded = decode_component("r_")
    form = f"transform(array({decoded}), d_ -> CASE WHEN octet_length(d_) > length(d_) THEN {mapped} ELSE lower(d_) END)[0]"
    return f"transform(array({raw}), r_ -> CASE WHEN contains(r_, '%') OR octet_length(r_) > length(r_) THEN {form} ELSE lower(r_) END)[0]"


def _authority(text: str, scheme: str) -> str:
    """Canonical ``[userinfo@]host[:port]``, NULL when it is not valid."""
    user = extract(text, r"^(.*@)?")
    hostport = extract(text, r"^(?:.*@)?([^@]*)$")
    host = canonical_host(extract(hostport, r"^(\[[^\]]*\]|[^:]*)"))
    digits = f"ltrim('0', {extract(hostport, r':([0-9]+)$')})"
    # No failing TRY_CAST: it raises and catches internally, which is slow per row.
    port = f"CASE WHEN length({digits}) BETWEEN 1 AND 5 THEN CAST({digits} AS INT) END"
    suffix = (
        f"CASE WHEN {digits} IN ('', CASE WHEN {scheme} = 'https' THEN '443' ELSE '80' END) THEN '' "
        f"ELSE concat(':', {digits}) END"
    )
    quad = "CASE WHEN v_ IS NOT NULL THEN concat_ws('.', shiftright(v_, 24), shiftright(v_, 16) & 255, shiftright(v_, 8) & 255, v_ & 255) END"
    number = f"transform(array({ipv4_literal('a_')}), v_ -> {quad})[0]"
    named = f"transform(array({host}), a_ -> CASE WHEN {rlike('a_', HOST_OK)} THEN CASE WHEN {rlike('a_', NUMERIC_HOST)} THEN {number} ELSE a_ END END)[0]"
    plain = f"{rlike(text, r'^[a-z0-9.\-]+$')} AND NOT {rlike(text, NUMERIC_HOST)}"
    valid = f"{rlike(hostport, HOST_PORT)} AND length({digits}) <= 5 AND coalesce({port}, 0) <= 65535"
    return f"CASE WHEN {plain} THEN {text} WHEN {valid} THEN concat({user}, {named}, {suffix}) END"


def _dot_segments(path: str) -> str:
    """Remove ``.`` and ``..`` segments (also percent-encoded); path starts with '/'."""
    closed = sub(path, r"(?i)(/(?:\.|%2e){1,2})$", "$1/")
    name = "replace(lower(g_), '%2e', '.')"
    kept = (
        f"aggregate(split(substring({closed}, 2), '/', -1), CAST(array() AS array<string>), (acc_, g_) -> "
        f"CASE WHEN {name} = '..' THEN slice(acc_, 1, greatest(size(acc_) - 1, 0)) "
        f"WHEN {name} = '.' THEN acc_ ELSE concat(acc_, array(g_)) END)"
    )
    has_dots = rlike(path, r"(?i)/(?:\.|%2e){1,2}(?:/|$)")
    return f"CASE WHEN {has_dots} THEN concat('/', array_join({kept}, '/')) ELSE {path} END"


def _encode_path(path: str) -> str:
    """Percent-encode white space, controls, quotes, angle brackets, braces and non-ASCII."""
    unsafe = r"[^!-~]|[\"<>^`{}]"
    encoded = (
        f"array_join(transform(split({path}, ''), c_ -> CASE WHEN {rlike('c_', unsafe)} "
        f"THEN replace(url_encode(c_), '+', '%20') ELSE c_ END), '')"
    )
    return f"CASE WHEN {rlike(path, unsafe)} THEN {encoded} ELSE {path} END"


def _normal_path(path: str) -> str:
    """Dot segments removed and unsafe characters encoded, each only where needed."""
    return f"transform(array({_dot_segments(path)}), w_ -> {_encode_path('w_')})[0]"


def decode_component(s: str) -> str:
    """Percent-decode leaving malformed escapes alone; '+' is an ordinary character."""
    safe = sub(s, r"%(?![0-9a-fA-F]{2})", "%25")
    return f"CASE WHEN contains({s}, '%') THEN try_url_decode(replace({safe}, '+', '%2B')) ELSE {s} END"


def decode_uri_component(s: str) -> str:
    """Strict percent-decoding; the text itself when an escape is malformed or not UTF-8."""
    decoded = f"try_url_decode(replace({s}, '+', '%2B'))"
    malformed = rlike(s, r"%(?![0-9a-fA-F]{2})")
    good = f"NOT {malformed} AND NOT coalesce(contains({decoded}, '�'), true)"
    return f"CASE WHEN contains({s}, '%') AND {good} THEN {decoded} ELSE {s} END"


def sort_query(query: str) -> str:
    """Query parameters stably sorted by name and written back form-urlencoded."""
    name = decode_component(extract("replace(u_, '+', ' ')", r"^([^=]*)"))
    value = decode_component(extract("replace(u_, '+', ' ')", r"^[^=]*=((?s:.*))\z"))
    parts = f"filter(split({query}, '&'), u_ -> u_ <> '')"
    pairs = f"transform({parts}, (u_, i_) -> struct({name} AS name, i_ AS i, {value} AS value))"
    joined = (
        f"array_join(transform(array_sort({pairs}), v_ -> "
        "concat(url_encode(v_.name), '=', url_encode(v_.value))), '&')"
    )
    return f"CASE WHEN {query} = '' THEN '' ELSE {joined} END"


def split_absolute(url: str) -> str:
    """STRUCT<scheme, authority, path, query> of an absolute http(s) URL, NULL otherwise."""
    scheme = f"lower({extract('s_', _SCHEME)})"
    rest = f"translate({extract('s_', r'^[a-zA-Z]+:([^?#]*)')}, {q(chr(92))}, '/')"
    parts = (
        f"transform(array({cleaned(url)}), s_ -> struct({scheme} AS scheme, {rest} AS rest, "
        f"{extract('s_', r'^[^?#]*\?([^#]*)')} AS query))"
    )
    path = f"coalesce(nullif({extract('r_.rest', r'^/*[^/]*(/.*)$')}, ''), '/')"
    whole = (
        f"transform({parts}, r_ -> struct(r_.scheme AS scheme, "
        f"{_authority(extract('r_.rest', r'^/*([^/]*)'), 'r_.scheme')} AS authority, "
        f"{_normal_path(path)} AS path, r_.query AS query))[0]"
    )
    ok = "h_.scheme IN ('http', 'https') AND h_.authority IS NOT NULL"
    return f"get(filter(array({whole}), h_ -> {ok}), 0)"


def host_of(authority: str) -> str:
    """Host of an authority, without user info and port."""
    return extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)")


def url_host(url: str) -> str:
    """Lower-cased host of a well-formed absolute URL (cheap form for grouping)."""
    return f"lower({extract(url, r'^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)')})"


def canonical_url_host(url: str) -> str:
    """Canonical host of an absolute URL of any spelling, '' where there is none."""
    return canonical_host(extract(f"translate({cleaned(url)}, {q(chr(92))}, '/')", r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/*(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"))


def url_origin(url: str) -> str:
    return extract(url, r"^([a-z]+://[^/?#]*)")


def url_path(url: str) -> str:
    return extract(url, r"^[a-z]+://[^/?#]*([^?#]*)")


def with_resolved(df: DataFrame, raw: str, base: str, out: str, sort: bool = True, max_data_uri: int | None = None) -> DataFrame:
    """Add ``out``: ``raw`` resolved against the ``base`` struct (see :func:`split_absolute`).

    The fragment is dropped. With ``sort`` the query is normalized as well and ``data:image/*`` URIs
    (of up to ``max_data_uri`` characters, if given) pass verbatim; NULL marks everything that is not an accepted image URL.
    The work is staged over several projections so that each piece is evaluated once.
    """
    keep = [f"`{c}`" for c in df.columns]
    data = f"startswith({raw}, 'data:')"
    text = f"CASE WHEN {data} THEN '' ELSE {sub(cleaned(raw), r'#(?s:.*)\z', '')} END" if sort else sub(
        cleaned(raw), r"#(?s:.*)\z", ""
    )
    s = df.selectExpr("*", f"{text} AS _s")
    s = s.selectExpr(*keep, "_s", f"lower({extract('_s', _SCHEME)}) AS _sch")
    same = f"(_sch = {base}.scheme AND NOT {rlike('_s', r'^[a-zA-Z]+:[/\\]{2}')})"
    before_query = extract("_s", r"^([^?]*)")
    s = s.selectExpr(
        *keep,
        f"CASE WHEN _sch = '' THEN {base}.scheme ELSE _sch END AS _scheme",
        f"(_sch <> '' AND NOT {same}) AS _absolute",
        f"translate({sub(before_query, _SCHEME, '')}, {q(chr(92))}, '/') AS _p",
        f"{extract('_s', r'^[^?]*\?((?s:.*))\z')} AS _q",
        "contains(_s, '?') AS _hasq",
    )
    full = "(_absolute OR startswith(_p, '//'))"
    s = s.selectExpr(
        *keep,
        "_scheme",
        f"CASE WHEN {full} THEN {_authority(extract('_p', r'^/*([^/]*)'), '_scheme')} "
        f"ELSE {base}.authority END AS _authority",
        f"CASE WHEN {full} THEN {extract('_p', r'^/*[^/]*(/.*)?$')} WHEN _p = '' THEN {base}.path "
        f"WHEN startswith(_p, '/') THEN _p ELSE concat({sub(f'{base}.path', r'[^/]*$', '')}, _p) END AS _path",
        f"CASE WHEN {full} OR _p <> '' OR _hasq THEN _q ELSE {base}.query END AS _query",
    )
    s = s.selectExpr(
        *keep,
        "_scheme",
        "_authority",
        f"CASE WHEN _path = '' THEN '/' ELSE {_normal_path('_path')} END AS _path",
        f"{sort_query('_query') if sort else '_query'} AS _query",
    )
    href = (
        "CASE WHEN _scheme IN ('http', 'https') THEN concat(_scheme, '://', _authority, _path, "
        "CASE WHEN _query = '' THEN '' ELSE concat('?', _query) END) END"
    )
    if sort:
        # Data URIs keep their text, '#' included; the prefix test is case-sensitive for 'data:'.
        accepted = rlike(raw, "^data:(?i:image)/") + ("" if max_data_uri is None else f" AND length({raw}) <= {max_data_uri}")
        href = f"CASE WHEN {data} THEN CASE WHEN {accepted} THEN {raw} END ELSE {href} END"
    return settled(s, keep, {out: href})
