"""HTML tokenization and attribute access as native column expressions.

A document becomes an array of tokens with one ``regexp_extract_all``. The pattern follows the
tokenizer of the HTML standard: comments, raw-text elements (one token each, body included), tags
with quoted attribute values, text. All repetition is possessive, so a tag with very many
attributes cannot exhaust the regex engine's stack, and a tag cut off by the end of the document
swallows the remainder instead of being re-read as markup.

Foreign content (drawings and formulas) has another grammar: a slash closes any element there and
raw-text elements are ordinary ones. The document pattern takes a whole foreign span as one token,
up to its end tag or a tag that breaks out of it; such spans are then cut by the second pattern.
"""

from __future__ import annotations

from ..constants import FOREIGN_BREAKOUT_TAGS, HTML_VOID_TAGS, SVG_ATTRIBUTE_NAMES, SVG_NAMESPACE
from .sqltext import extract, extract_all, in_list, lookup, q, rlike, sub

WS = r" \t\n\f\r"
ATTR = (
    rf"[^{WS}/>=][^{WS}/>=]*+"
    rf"(?:[{WS}]*+=[{WS}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{WS}>\"'][^{WS}>]*+))?+"
)
ATTRS = rf"(?:[{WS}/]++|{ATTR})*+(?:=[{WS}]*+)?+"
RAW_TAGS = ["script", "style", "noscript", "textarea", "title", "iframe", "xmp", "noembed", "noframes"]


def _raw_element(name: str) -> str:
    return (
        rf"<(?i:{name})(?:[{WS}/]{ATTRS})?+>(?s:.*?)"
        rf"(?:</(?i:{name})(?:[{WS}/][^>]*+)?+>|\z)"
    )


OPEN_TAG = rf"<[a-zA-Z][^{WS}/>]*+{ATTRS}>"
_COMMENT = r"<!--(?:-?+>|(?s:.*?)(?:--!?+>|\z))"
_TAG_OR_TEXT = [
    rf"</?+[a-zA-Z][^{WS}/>]*+{ATTRS}>",
    r"</?+[a-zA-Z][^'\">]*+>",
    r"</?+[a-zA-Z](?s:.*+)",
    r"</>",
    r"<[!?/][^>]*+>?+",
    r"[^<]++",
    r"<",
]
# Tokens of HTML content, without foreign spans.
_PLAIN_TOKEN = "|".join([_COMMENT, *[_raw_element(n) for n in RAW_TAGS], *_TAG_OR_TEXT])

# The rest of a start tag that no slash closes; a slash in an unquoted value belongs to the value.
_OPEN_REST = rf"(?=[{WS}/>])(?:[{WS}]++|/(?!>)|{ATTR})*+(?:=[{WS}]*+)?+>"
_END_REST = rf"(?:[{WS}/][^>]*+)?+>"
# Text-only style sheets, titles and scripts of a drawing stay one token, as in HTML.
_TEXT_ELEMENTS = [rf"<(?i:{n}){_OPEN_REST}[^<]*+</(?i:{n}){_END_REST}" for n in RAW_TAGS]
# HTML inside a drawing.
_EMBEDDED_HTML = rf"<(?i:foreignobject){_OPEN_REST}(?:(?!</(?i:foreignobject|svg)[{WS}/>])(?:{_PLAIN_TOKEN}))*+"
FOREIGN_TOKEN = "|".join([_COMMENT, r"<!\[CDATA\[(?s:.*?)(?:\]\]>|\z)", _EMBEDDED_HTML, *_TEXT_ELEMENTS, *_TAG_OR_TEXT])
_BREAKOUT = rf"<(?i:{'|'.join(FOREIGN_BREAKOUT_TAGS)})[{WS}/>]|</(?i:p|br)[{WS}/>]"
#: How deep drawings in drawings are told from HTML by their raw-text elements.
FOREIGN_DEPTH = 3


def _foreign_span(name: str, depth: int) -> str:
    """A foreign element with its content, spans of the same kind in it included."""
    nested = f"{_foreign_span(name, depth - 1)}|" if depth > 1 else ""
    content = rf"(?:(?!</(?i:{name})[{WS}/>]|{_BREAKOUT})(?:{nested}{FOREIGN_TOKEN}))*+"
    return rf"<(?i:{name}){_OPEN_REST}{content}(?:</(?i:{name}){_END_REST})?+"


FOREIGN_TAGS = ["svg", "math"]
TOKEN = "|".join([*[_foreign_span(n, FOREIGN_DEPTH) for n in FOREIGN_TAGS], _PLAIN_TOKEN])
RAW_TOKEN = rf"^<(?i:{'|'.join(RAW_TAGS)})[{WS}/>]"


def starts_tag(tok: str, *names: str) -> str:
    """Is the token an open tag (or raw element) with one of these names?"""
    return rlike(tok, rf"^<(?i:{'|'.join(names)})[{WS}/>]")


def tokenize(html: str) -> str:
    """ARRAY<STRING> of tokens in document order, foreign spans cut by their own grammar."""
    embedded = f"CASE WHEN {starts_tag('f_', 'foreignobject')} THEN {extract_all('f_', _PLAIN_TOKEN)} ELSE array(f_) END"
    cut = f"flatten(transform({extract_all('t_', FOREIGN_TOKEN)}, f_ -> {embedded}))"
    foreign = starts_tag("t_", *FOREIGN_TAGS)
    spread = f"flatten(transform(w_, t_ -> CASE WHEN {foreign} THEN {cut} ELSE array(t_) END))"
    return f"transform(array({extract_all(html, TOKEN)}), w_ -> CASE WHEN exists(w_, t_ -> {foreign}) THEN {spread} ELSE w_ END)[0]"


def is_raw(tok: str) -> str:
    """Does the token carry a raw-text body? In foreign content start tags of these names don't."""
    return f"({rlike(tok, RAW_TOKEN)} AND NOT {rlike(tok, '^' + OPEN_TAG + chr(92) + 'z')})"


def drop_cut_tag(toks: str) -> str:
    """Remove a tag that the end of the document cut off; it can only be the last token."""
    last = f"try_element_at({toks}, -1)"
    whole = rf"^</?+[a-zA-Z](?:[^{WS}/>]*+{ATTRS}>|[^'\">]*+>)\z"
    cut = f"{rlike(last, '^</?[a-zA-Z]')} AND NOT {rlike(last, RAW_TOKEN)} AND NOT {rlike(last, whole)}"
    return f"CASE WHEN {cut} THEN slice({toks}, 1, size({toks}) - 1) ELSE {toks} END"


def tag_name(tok: str) -> str:
    """Lower-cased tag name, '' for text, comments and declarations."""
    return f"lower({extract(tok, rf'^</?([a-zA-Z][^{WS}/>]*)')})"


def open_tag(tok: str) -> str:
    """The start tag alone: raw elements carry their body in the same token."""
    return f"CASE WHEN {rlike(tok, RAW_TOKEN)} THEN {extract(tok, '^' + OPEN_TAG, 0)} ELSE {tok} END"


def raw_body(tok: str) -> str:
    """Text between the tags of a raw element token."""
    inner = f"substring({tok}, length({extract(tok, '^' + OPEN_TAG, 0)}) + 1, length({tok}))"
    return sub(inner, rf"</(?i:{'|'.join(RAW_TAGS)})(?:[{WS}/][^>]*+)?+>\z", "")


def self_closing(tag: str) -> str:
    bare = sub(tag, rf"=[{WS}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{WS}>\"'][^{WS}>]*+)", "")
    return f"({bare} LIKE '%/>')"


def attributes(tok: str, names: list[str] | None = None) -> str:
    """ARRAY<STRUCT<name, value>> in markup order, duplicates kept, optionally only some names."""
    inner = sub(open_tag(tok), rf"^</?[a-zA-Z][^{WS}/>]*+", "")
    parts = extract_all(inner, ATTR)
    if names is not None:
        pattern = rf"^(?i:{'|'.join(names)})(?:[{WS}=]|\z)"
        parts = f"filter({parts}, a_ -> {rlike('a_', pattern)})"
    raw = extract("a_", rf"^[^=]*+=[{WS}]*+((?s:.*))\z")
    pairs = (
        f"transform({parts}, a_ -> struct(lower({extract('a_', rf'^[^={WS}]++', 0)}) AS name, {raw} AS v))"
    )
    unquoted = "CASE WHEN left(p_.v, 1) IN ('\"', '\\'') THEN substring(p_.v, 2, length(p_.v) - 2) ELSE p_.v END"
    return f"transform({pairs}, p_ -> struct(p_.name AS name, {unquoted} AS value))"


def attr(attrs: str, name: str) -> str:
    """First value of an attribute, NULL when absent (the first duplicate counts)."""
    return f"get(filter({attrs}, a_ -> a_.name = {q(name)}), 0).value"


def _escape_text(s: str) -> str:
    return f"replace(replace(replace({s}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def encode_uri_component(s: str) -> str:
    """Percent-encode all but letters, digits and ``- _ . ! ~ * ' ( )``."""
    out = f"replace(url_encode({s}), '+', '%20')"
    for code, char in [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = f"replace({out}, {q(code)}, {q(char)})"
    return out


def _svg_piece(tok: str, is_root: str) -> str:
    """One token of an inline drawing, re-serialized as XML."""
    # A token's attributes are needed twice; binding them with a one-element array parses them once.
    name = f"coalesce({lookup({n.lower(): n for n in SVG_ATTRIBUTE_NAMES}, 'x_.name')}, x_.name)"
    value = f"""replace({_escape_text('x_.value')}, '"', '&quot;')"""
    serialized = f"""array_join(transform(b_.attrs, x_ -> concat(' ', {name}, '="', {value}, '"')), '')"""
    namespace = (
        f"CASE WHEN {is_root} AND NOT exists(b_.attrs, x_ -> x_.name = 'xmlns') "
        f"THEN {q(f' xmlns={chr(34)}{SVG_NAMESPACE}{chr(34)}')} ELSE '' END"
    )
    empty = f"({self_closing('b_.tag')} OR {in_list('b_.name', HTML_VOID_TAGS)})"
    bound = f"array(struct({attributes(tok)} AS attrs, {open_tag(tok)} AS tag, {tag_name(tok)} AS name))"
    start = (
        f"transform({bound}, b_ -> concat('<', b_.name, {serialized}, {namespace}, "
        f"CASE WHEN {empty} THEN '/>' ELSE '>' END))[0]"
    )
    end = f"concat('</', {tag_name(tok)}, '>')"
    return (
        f"CASE WHEN left({tok}, 1) <> '<' THEN {_escape_text(tok)} WHEN {tok} = '<' THEN '&lt;' "
        f"WHEN {is_raw(tok)} THEN concat({start}, {_escape_text(raw_body(tok))}, {end}) "
        f"WHEN {rlike(tok, '^<[a-zA-Z]')} THEN {start} WHEN {rlike(tok, '^</[a-zA-Z]')} THEN {end} ELSE '' END"
    )


def svg_islands(toks: str, max_data_uri: int | None = None) -> str:
    """Outermost <svg>…</svg> spans of a token array: ARRAY<STRUCT<pos, uri>>.

    Nesting is tracked over the svg tags alone, so the fold is as short as their number; each span
    is then cut out with ``slice`` and serialized. ``pos`` is the closing token's position.
    Drawings never closed are left out, as are ones longer than ``max_data_uri``, if given.
    """
    closes = rlike("t_", rf"^</(?i:svg)[{WS}/>]")
    delta = (
        f"CASE WHEN {closes} THEN -1 WHEN {starts_tag('t_', 'svg')} THEN "
        f"CASE WHEN {self_closing('t_')} THEN 2 ELSE 1 END ELSE 0 END"
    )
    marks = f"filter(transform({toks}, (t_, i_) -> struct(i_ AS i, {delta} AS d)), m_ -> m_.d <> 0)"
    zero = "struct(0 AS depth, -1 AS start, CAST(array() AS array<struct<s:int,e:int>>) AS spans)"
    emits = "(m_.d = 2 AND acc_.depth = 0) OR (m_.d = -1 AND acc_.depth = 1)"
    step = (
        "struct(CASE WHEN m_.d = 1 THEN acc_.depth + 1 WHEN m_.d = -1 THEN greatest(acc_.depth - 1, 0) "
        "ELSE acc_.depth END AS depth, "
        "CASE WHEN m_.d = 1 AND acc_.depth = 0 THEN m_.i ELSE acc_.start END AS start, "
        f"CASE WHEN {emits} THEN concat(acc_.spans, array(struct("
        "CASE WHEN m_.d = 2 THEN m_.i ELSE acc_.start END AS s, m_.i AS e))) ELSE acc_.spans END AS spans)"
    )
    spans = f"aggregate({marks}, {zero}, (acc_, m_) -> {step}).spans"
    markup = (
        f"array_join(transform(slice({toks}, s_.s + 1, s_.e - s_.s + 1), "
        f"(l_, j_) -> {_svg_piece('l_', 'j_ = 0')}), '')"
    )
    islands = (
        f"transform({spans}, s_ -> struct(s_.e AS pos, "
        f"concat('data:image/svg+xml,', {encode_uri_component(markup)}) AS uri))"
    )
    found = f"exists({toks}, t_ -> {starts_tag('t_', 'svg')})"
    if max_data_uri is not None:
        islands = f"filter({islands}, s_ -> length(s_.uri) <= {max_data_uri})"
    return f"CASE WHEN {found} THEN {islands} ELSE array() END"


def noscript_bodies(toks: str, budget: int | None = None) -> str:
    """Non-blank <noscript> bodies in order, cut so that all together hold ``budget`` chars, if given.

    The running total is a scalar fold that finds the body in which the budget ends.
    """
    bodies = f"transform(filter({toks}, t_ -> {starts_tag('t_', 'noscript')}), t_ -> {raw_body('t_')})"
    blank = rlike("b_", r"[^\s\x{00a0}\x{feff}]")
    if budget is None:
        return f"filter({bodies}, b_ -> {blank})"
    over = f"(acc_.cross < 0 AND acc_.total + length(b_) > {budget})"
    step = (
        f"struct(acc_.total + length(b_) AS total, acc_.i + 1 AS i, "
        f"CASE WHEN {over} THEN acc_.i ELSE acc_.cross END AS cross, "
        f"CASE WHEN {over} THEN {budget} - acc_.total ELSE acc_.room END AS room)"
    )
    cut = f"aggregate(n_, struct(0 AS total, 0 AS i, -1 AS cross, 0 AS room), (acc_, b_) -> {step})"
    kept = (
        "CASE WHEN c_.cut.cross < 0 THEN c_.n ELSE transform(slice(c_.n, 1, c_.cut.cross + 1), "
        "(b_, i_) -> CASE WHEN i_ = c_.cut.cross THEN substring(b_, 1, c_.cut.room) ELSE b_ END) END"
    )
    bound = f"transform(array({bodies}), n_ -> struct(n_ AS n, {cut} AS cut))"
    return f"filter(transform({bound}, c_ -> {kept})[0], b_ -> {blank})"
