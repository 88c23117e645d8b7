"""Small scalar rules: dimensions, srcset, CSS urls, formats, file names, byte sizes (SQL text)."""

from __future__ import annotations

from ..constants import EXT_BY_MIME, EXT_BY_SUFFIX, FORMAT_LABELS, GROUP_OF_SOURCE, SUFFIX_BY_CONTENT_TYPE
from .sqltext import extract, extract_all, lookup, q, rlike, sub
from .urls import decode_uri_component, js_trim, url_path


def int_attr(v: str) -> str:
    """All-digit attribute value above zero, else NULL."""
    return f"CASE WHEN {rlike(v, r'^[0-9]+\z')} THEN nullif(TRY_CAST({v} AS BIGINT), 0L) END"


def leading_int(v: str) -> str:
    """Leading digits of a string, above zero, else NULL ("1920px" is 1920)."""
    digits = extract(v, r"^\s*([0-9]+)")
    return f"nullif(TRY_CAST(nullif({digits}, '') AS BIGINT), 0L)"


def round_half_up(x: str) -> str:
    return f"CAST(floor({x} + 0.5D) AS BIGINT)"


def scaled_height(width: str, w: str, h: str) -> str:
    """Height of a scaled copy that keeps the declared aspect ratio; NULL unless all are known."""
    return round_half_up(f"CAST({width} AS DOUBLE) * {h} / {w}")


def parse_srcset(value: str) -> str:
    """ARRAY<STRUCT<url, width>>: comma split, the last ``Nw`` descriptor counts."""
    parts = f"filter(transform(split({value}, ','), z_ -> {js_trim('z_')}), z_ -> z_ <> '')"
    words = f"transform({parts}, z_ -> split(z_, {q(chr(92) + 's+')}))"
    last = f"try_element_at(filter(slice(y_, 2, size(y_)), d_ -> {rlike('d_', r'^[0-9]+w\z')}), -1)"
    width = f"TRY_CAST({extract(last, r'^([0-9]+)')} AS BIGINT)"
    return f"transform({words}, y_ -> struct(y_[0] AS url, {width} AS width))"


def _unquote(s: str) -> str:
    inner = f"CASE WHEN left({s}, 1) IN ('\"', '\\'') THEN substring({s}, 2, length({s}) - 2) ELSE {s} END"
    return f"transform(array({inner}), e_ -> {js_trim('e_')})[0]"


def css_urls(css: str) -> str:
    """ARRAY<STRING>: every ``url(...)``, then the quoted strings inside ``image-set(...)``."""
    urls = extract_all(css, r"(?i:url)\(\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\"')\s]++)\s*+\)")
    bare = f"transform({urls}, z_ -> {sub('z_', r'^(?i:url)\(\s*+|\s*+\)\z', '')})"
    sets = extract_all(css, r"(?i:image-set)\(([^)]*+)\)", 1)
    strings = extract_all("z_", "\"[^\"]++\"|'[^']++'")
    both = f"concat({bare}, flatten(transform({sets}, z_ -> {strings})))"
    return f"filter(transform({both}, z_ -> {_unquote('z_')}), z_ -> z_ <> '')"


def ext_of_url(url: str) -> str:
    """Format from a URL's path suffix or a data URI's media type, else 'unknown'."""
    mime = f"lower({extract(url, r'^(?i:data:image)/([a-zA-Z0-9.+\-]+)[;,]')})"
    suffix = f"lower({extract(url_path(url), r'\.([a-zA-Z0-9]+)$')})"
    return (
        f"coalesce(CASE WHEN startswith({url}, 'data:') THEN {lookup(EXT_BY_MIME, mime)} "
        f"ELSE {lookup(EXT_BY_SUFFIX, suffix)} END, 'unknown')"
    )


def ext_suffix(ext: str) -> str:
    """'.png' style suffix, '' for unknown."""
    return f"CASE {ext} WHEN 'unknown' THEN '' WHEN 'jpeg' THEN '.jpg' ELSE concat('.', {ext}) END"


def sanitize_filename(name: str) -> str:
    """No slashes, control characters or leading dots; at most 80 characters, short suffix kept."""
    clean = sub(sub(sub(name, r"[/\\]", "-"), r"[\x00-\x1f\x7f]", ""), r"^\.+", "")
    # A suffix is kept when it starts past the first character and has at most ten characters.
    suffix = extract("o_", r"(?s)^.+(\.[^.]{0,9})\z")
    short = f"concat(left(o_, 80 - length({suffix})), {suffix})"
    return f"transform(array({clean}), o_ -> CASE WHEN length(o_) > 80 THEN {short} ELSE o_ END)[0]"


def last_segment(url: str) -> str:
    """Sanitized, percent-decoded last path segment, '' when there is none."""
    segment = extract(url_path(url), r"([^/]+)/*$")
    decoded = f"transform(array({segment}), n_ -> {decode_uri_component('n_')})[0]"
    return sanitize_filename(decoded)


def base_filename(url: str, ext: str) -> str:
    """File name of a remote image before de-duplication."""
    return f"coalesce(nullif({last_segment(url)}, ''), concat('image', {ext_suffix(ext)}))"


def download_filename(url: str, content_type: str) -> str:
    """File name for a single download: a missing suffix comes from the content type."""
    kind = f"lower(trim({extract(content_type, r'^([^;]*)')}))"
    suffix = lookup(SUFFIX_BY_CONTENT_TYPE, kind)
    name = f"coalesce(nullif({last_segment(url)}, ''), 'image')"
    return (
        f"transform(array({name}), f_ -> CASE WHEN {rlike('f_', r'\.[a-zA-Z0-9]{1,10}$')} "
        f"OR {suffix} IS NULL THEN f_ ELSE concat(f_, '.', {suffix}) END)[0]"
    )


def numbered_filename(name: str, n: str) -> str:
    """``name`` for the first use, ``name-2.ext`` for the second and so on."""
    stem, suffix = extract(name, r"(?s)^(.+?)(?:\.[^.]*)?\z"), extract(name, r"(?s)^.+?(\.[^.]*)?\z")
    return f"CASE WHEN {n} = 1 THEN {name} ELSE concat({stem}, '-', CAST({n} AS STRING), {suffix}) END"


def format_label(ext: str) -> str:
    return f"coalesce({lookup(FORMAT_LABELS, ext)}, upper({ext}))"


def source_group(source: str) -> str:
    return lookup(GROUP_OF_SOURCE, source)


def data_uri_bytes(url: str) -> str:
    """Exact decoded size of a data URI, 0 when it has no payload separator."""
    comma = f"instr({url}, ',')"
    header = f"substring({url}, 1, {comma} - 1)"
    payload = f"substring({url}, {comma} + 1)"
    padding = f"CASE WHEN {payload} LIKE '%==' THEN 2 WHEN {payload} LIKE '%=' THEN 1 ELSE 0 END"
    base64 = f"greatest(0, CAST(floor(length({payload}) * 3 / 4) AS BIGINT) - {padding})"
    return (
        f"CAST(CASE WHEN {comma} = 0 THEN 0 WHEN {rlike(header, r'(?i);base64$')} THEN {base64} "
        f"ELSE octet_length({decode_uri_component(payload)}) END AS BIGINT)"
    )


def format_bytes(n: str) -> str:
    """Decimal units with one decimal, a trailing '.0' dropped."""
    # Rounded by the double's exact value, as fixed-point formatting does (1.65 is a little less); true ties go up.
    def scaled(divisor: str, unit: str) -> str:
        text = f"transform(array({n} / {divisor}), v_ -> format_number(v_ + CASE WHEN v_ * 4 % 4 = 1 THEN 0.05D ELSE 0D END, '0.0'))[0]"
        return f"concat({sub(text, r'\.0$', '')}, ' {unit}')"

    return (
        f"CASE WHEN {n} < 1000 THEN concat(CAST({n} AS STRING), ' B') "
        f"WHEN {n} >= 1000000000 THEN {scaled('1e9D', 'GB')} "
        f"WHEN {n} >= 1000000 THEN {scaled('1e6D', 'MB')} ELSE {scaled('1e3D', 'KB')} END"
    )


def area(w: str, h: str) -> str:
    """w x h as DOUBLE (cannot overflow), NULL unless both are known."""
    return f"(CAST({w} AS DOUBLE) * CAST({h} AS DOUBLE))"
