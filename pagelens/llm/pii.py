"""PII: format-preserving pseudonyms by keyed Feistel permutations, with DataFrame functions only.

Found and validated values are replaced by other valid values of the same format. Each format's values are numbered as
pairs (a, b) in Z_m x Z_n, and alternating rounds ``a += F(key, round, b) mod m``, ``b += F(key, round, a) mod n`` permute
exactly that domain, so nothing has to be walked or stored: equal values get equal pseudonyms in every document and at
every size, different values get different ones, and whoever has the key can undo it. F is taken from SHA-256.

| kind | valid if | permuted, kept |
|---|---|---|
| card | 13 to 19 digits with a right check digit | digits after the sixth; the check digit follows |
| iban | the length of its country, right check number | account digits, account letters; the check number follows |
| phone | 10 digits in the North American form | area with exchange, line; a number with both from 200 stays one, any other stays another |
| phone | + or 00 with 8 to 15 digits, or a first 0 with its area set apart | digits after country code or 0 |
| ssn | area 1-899 but 666, group 1-99, serial 1-9999 | all parts |
| date | a day of 1700-2099 | day number; the order of parts is kept |
| ipv4 | four numbers up to 255 | all 32 bits |
| email | local part of letters, digits and . _ % + - | letters and digits as base 36, other signs in place, domain kept |

Dates with strokes are read month first, and day first only where that fails; a moved day-first date may look like a
month-first one, the one case in which two values can get one pseudonym.

A run of digit groups is searched for cards from each group on: first for 16 digits, then for the longest. A run counts as
one value. Digits without +, 00, brackets or separators are not taken for a phone number.

Separators stay where they were. Values that match a format but don't validate stay as they are.

Nulls and ties: null text stays null with no finds; an empty text stays empty. Rows come back as often as they came, with
their other columns untouched. Null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROUNDS = 10

#: Countries by the length of their IBANs.
_IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU",
}
_OWN_LENGTH = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in _IBANS.items())
_TEN = r"(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
#: North American form: with +1 in any spacing, without it only where its parts are set apart.
_AMERICAN = rf"\+1[ .-]?\(?[0-9]{{3}}\)?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}\b|(?<![0-9A-Za-z])(?:1[ .-])?{_TEN}"
_ABROAD = r"(?:\+|(?<![0-9A-Za-z])00)[1-9](?:[ ./-]?\(?[0-9]\)?){7,14}\b"
_TRUNK = r"(?<![0-9A-Za-z])(?:(?:\(0[0-9]{1,5}\) ?|0[1-9][0-9]{1,4}[ /-])[0-9](?:[ -]?[0-9]){4,8}|0[1-9](?:[ .-][0-9]{2}){4})\b"

# Java's matcher calls itself for each round of a group that may give rounds back, so a run of some thousand digits or labels
# ends the JVM. Groups without an upper bound are possessive, and what follows them needs nothing back.
#: Labels up to the last that begins with two letters.
_ENDS, _OTHER = (rf"\.(?{sign}[A-Za-z]{{2}})[A-Za-z0-9-]++" for sign in "=!")
_LABELS = rf"[A-Za-z0-9-]++(?:(?:{_OTHER})*+{_ENDS}(?=(?:{_OTHER})*+{_ENDS}))*+(?:{_OTHER})*+"

_PATTERNS = {
    # A local part starts behind no letter or digit unless a find ends there, so a long run without @ is read once.
    "email": rf"(?:(?<![A-Za-z0-9])|\G)[A-Za-z0-9][A-Za-z0-9._%+-]*+@{_LABELS}\.[A-Za-z]{{2,}}",
    "iban": rf"\b(?:{_OWN_LENGTH}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{2,6}}(?: ?[0-9]{{1,3}})?)\b",
    "date": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": f"{_AMERICAN}|{_ABROAD}|{_TRUNK}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12}[0-9]*+\b(?:[ -][0-9]++\b)*+",
}
ANY = "|".join(_PATTERNS.values())


def let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(kind: str, a: str, b: str, m: str, n: str, key: str) -> str:
    """SQL text of the struct (a, b) permuted over Z_m x Z_n; m and n are at most 10^15."""
    f = f"cast(conv(substr(sha2(concat_ws('|', {key}, '{kind}', i, m, n, if(i % 2 = 1, s.b, s.a)), 256), 1, 15), 16, 10) AS bigint)"
    step = f"if(i % 2 = 1, named_struct('a', pmod(s.a + {f}, m), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b + {f}, n)))"
    body = f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} AS bigint), 'b', cast({b} AS bigint)), (s, i) -> {step})"
    return let(f"cast({m} AS bigint)", "m", let(f"cast({n} AS bigint)", "n", body))


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _refilled(template: str, signs: str, new: str) -> str:
    """``template`` with its characters of the class ``signs`` replaced in order by those of ``new``."""
    step = f"if(c RLIKE '[{signs}]', named_struct('s', concat(r.s, substr(fill, r.i, 1)), 'i', r.i + 1), named_struct('s', concat(r.s, c), 'i', r.i))"
    return let(new, "fill", f"aggregate(filter(split({template}, ''), c -> c <> ''), named_struct('s', '', 'i', 1), (r, c) -> {step}).s")


def luhn_sum(d: str, doubled_last: bool) -> str:
    """Sum of digits, every other one doubled, counted from the right."""
    other = 1 if doubled_last else 0
    return f"aggregate(transform(split(reverse({d}), '', length({d})), (c, i) -> if(i % 2 = {1 - other}, (cast(c AS int) * 2) div 10 + (cast(c AS int) * 2) % 10, cast(c AS int))), 0L, (t, x) -> t + x)"


def _halves(kind: str, digits: str, base: int, key: str) -> str:
    """A string of digits of a base permuted among those of its length, in pieces of at most 16 digits."""
    number = lambda x: x if base == 10 else f"conv({x}, {base}, 10)"
    text = lambda x: f"cast({x} AS string)" if base == 10 else f"lower(conv({x}, 10, {base}))"
    half, rest = "length(p) div 2", "length(p) - length(p) div 2"
    pair = feistel(kind, f"if({half} = 0, '0', {number(f'left(p, {half})')})", number(f"right(p, {rest})"), f"power({base}, {half})", f"power({base}, {rest})", key)
    one = let(pair, "q", f"concat(if({half} = 0, '', lpad({text('q.a')}, {half}, '0')), lpad({text('q.b')}, {rest}, '0'))")
    return f"array_join(transform(sequence(0, (length({digits}) - 1) div 16), g -> {let(f'substr({digits}, g * 16 + 1, 16)', 'p', one)}), '')"


def _cards(v: str, key: str) -> str:
    """A run of digit groups with each card in it replaced; groups keep the separator after them."""
    digits = _digits("array_join(slice(gs, gi, gk), '')")
    order = "sequence(least(19, size(gs) - gi + 1), 1, -1)"  # a group has a digit at least
    fits = let(digits, "gd", f"length(gd) BETWEEN 13 AND 19 AND ({luhn_sum('gd', False)}) % 10 = 0")
    cards = let(f"filter({order}, gk -> {fits})", "ks", f"coalesce(get(filter(ks, gk -> length({digits}) = 16), 0), get(ks, 0))")
    one = let("array_join(slice(gs, gi, gk), '')", "x", _card("x", key))
    step = let(cards, "gk", f"if(gk IS NULL, named_struct('s', concat(acc.s, gs[gi - 1]), 'at', gi), named_struct('s', concat(acc.s, {one}), 'at', gi + gk - 1))")
    run = f"aggregate(sequence(1, size(gs)), named_struct('s', '', 'at', 0), (acc, gi) -> if(gi <= acc.at, acc, {step})).s"
    return let(f"regexp_extract_all({v}, '[0-9]+[ -]?', 0)", "gs", run)


def _card(v: str, key: str) -> str:
    payload = f"concat(left(d, 6), {_halves('card', 'substr(d, 7, length(d) - 7)', 10, key)})"
    fixed = let(payload, "y", f"concat(y, (10 - ({luhn_sum('y', True)}) % 10) % 10)")
    return let(_digits(v), "d", f"if(({luhn_sum('d', False)}) % 10 = 0, {_refilled(v, '0-9', fixed)}, {v})")


def _iban(v: str, key: str) -> str:
    value = "if(ch RLIKE '[0-9]', m97 * 10 + ascii(ch) - 48, m97 * 100 + ascii(ch) - 55) % 97"
    left = lambda account, check: f"aggregate(filter(split(concat({account}, left(z, 2), {check}), ''), ch -> ch <> ''), 0, (m97, ch) -> cast({value} AS int))"
    # Letters are numbers of base 26 by themselves, so each place keeps its class.
    numbers = let("regexp_replace(substr(z, 5), '[^0-9]', '')", "own", f"if(own = '', '', {_halves('iban', 'own', 10, key)})")
    base26, letters = "'0123456789abcdefghijklmnop'", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    names = let(f"translate(regexp_replace(substr(z, 5), '[^A-Z]', ''), {letters}, {base26})", "own", f"if(own = '', '', translate({_halves('iban letters', 'own', 26, key)}, {base26}, {letters}))")
    account = let(_refilled(_refilled("substr(z, 5)", "0-9", numbers), "A-Z", names), "y", f"concat(left(z, 2), lpad(cast(98 - {left('y', chr(39) + '00' + chr(39))} AS string), 2, '0'), y)")
    valid = f"length(z) BETWEEN 12 AND 34 AND {left('substr(z, 5)', 'substr(z, 3, 2)')} = 1"
    return let(f"replace({v}, ' ', '')", "z", f"if({valid}, {_refilled(v, 'A-Z0-9', account)}, {v})")


def _date(v: str, key: str) -> str:
    """Days from 1700-01-01 over 400 years are 189 x 773."""
    epoch = "DATE'1700-01-01'"
    iso = f"substr({v}, 5, 1) = '-'"
    day = f"coalesce(try_to_date({v}, 'yyyy-MM-dd'), try_to_date({v}, 'MM/dd/yyyy'), try_to_date({v}, 'dd/MM/yyyy'))"
    shape = f"if({iso}, 'yyyy-MM-dd', if(try_to_date({v}, 'MM/dd/yyyy') IS NOT NULL, 'MM/dd/yyyy', 'dd/MM/yyyy'))"
    number = f"datediff({day}, {epoch})"
    moved = let(feistel("date", "x div 773", "x % 773", "189", "773", key), "q", f"date_format(date_add({epoch}, cast(q.a * 773 + q.b AS int)), {shape})")
    return let(number, "x", f"if(x BETWEEN 0 AND 146096, {moved}, {v})")


def _ssn(v: str, key: str) -> str:
    area = "cast(substr(d, 1, 3) AS int)"
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND substr(d, 4, 2) <> '00' AND substr(d, 6) <> '0000'"
    a = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + cast(substr(d, 4, 2) AS int) - 1"
    new_area = "(q.a div 99) + 1 + if(q.a div 99 >= 665, 1, 0)"
    new = f"concat(lpad(cast({new_area} AS string), 3, '0'), lpad(cast(q.a % 99 + 1 AS string), 2, '0'), lpad(cast(q.b + 1 AS string), 4, '0'))"
    return let(_digits(v), "d", f"if({valid}, {_refilled(v, '0-9', let(feistel('ssn', a, 'cast(substr(d, 6) AS int) - 1', '88902', '9999', key), 'q', new))}, {v})")


def _phone(v: str, key: str) -> str:
    """North American numbers with area and exchange from 200 are permuted among themselves, the 360,000 other beginnings too."""
    area, exchange, line = "cast(left(t, 3) AS int)", "cast(substr(t, 4, 3) AS int)", "cast(substr(t, 7) AS int)"
    valid = f"{area} >= 200 AND {exchange} >= 200"
    first = "concat(cast(q.a div 800 + 200 AS string), cast(q.a % 800 + 200 AS string), lpad(cast(q.b AS string), 4, '0'))"
    usual = let(feistel("phone", f"({area} - 200) * 800 + {exchange} - 200", line, "640000", "10000", key), "q", first)
    begin = "if(q.a < 200000, lpad(cast(q.a AS string), 6, '0'), concat(cast((q.a - 200000) div 200 + 200 AS string), lpad(cast((q.a - 200000) % 200 AS string), 3, '0')))"
    number = f"if({area} < 200, {area} * 1000 + {exchange}, 200000 + ({area} - 200) * 200 + {exchange})"
    other = let(feistel("phone", number, line, "360000", "10000", key), "q", f"concat({begin}, lpad(cast(q.b AS string), 4, '0'))")
    american = f"concat(left(d, length(d) - 10), {let('right(d, 10)', 't', f'if({valid}, {usual}, {other})')})"
    # Digits that stay: 00, the country code, or the 0 before an area.
    code = "if(n RLIKE '^[17]', 1, if(n RLIKE '^(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])', 2, 3))"
    stays = f"if({v} LIKE '+%', {let('d', 'n', code)}, if(d LIKE '00%', 2 + {let('substr(d, 3)', 'n', code)}, 1))"
    elsewhere = let(stays, "k", f"concat(left(d, k), {_halves('phone', 'substr(d, k + 1)', 10, key)})")
    new = f"if({v} RLIKE {_literal(f'^(?:{_AMERICAN})$')}, {american}, {elsewhere})"
    return let(_digits(v), "d", _refilled(v, "0-9", new))


def _ipv4(v: str, key: str) -> str:
    part = lambda i: f"cast(d[{i}] AS int)"
    new = "concat_ws('.', q.a div 256, q.a % 256, q.b div 256, q.b % 256)"
    valid = "forall(d, x -> cast(x AS int) <= 255)"
    return let(f"split({v}, '[.]')", "d", f"if({valid}, {let(feistel('ipv4', f'{part(0)} * 256 + {part(1)}', f'{part(2)} * 256 + {part(3)}', '65536', '65536', key), 'q', new)}, {v})")


def _email(v: str, key: str) -> str:
    local = f"lower(substring_index({v}, '@', 1))"
    return let(local, "w", f"concat({_refilled('w', 'a-z0-9', _halves('email', "regexp_replace(w, '[^a-z0-9]', '')", 36, key))}, '@', substring_index({v}, '@', -1))")


def pseudonym(v: str, key: str) -> str:
    """SQL text of the pseudonym of one matched value ``v``; the value itself where it isn't valid."""
    rules = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "card": _cards}
    cases = " ".join(f"WHEN {v} RLIKE {_literal(f'^(?:{_PATTERNS[kind]})$')} THEN {rule(v, key)}" for kind, rule in rules.items())
    return f"CASE {cases} ELSE {v} END"


def pseudonymized(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """All rows and columns, with pseudonyms in the text, and ``n_values``, the number of replaced values."""
    key = _literal(secret)
    held = F.col(text).rlike("[0-9@]")
    found = docs.withColumn("__found", F.explode(F.array(F.when(held, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))))
    new = found.withColumn("__new", F.explode(F.array(F.expr(f"if(size(__found) = 0, __found, transform(__found, v -> {pseudonym('v', key)}))"))))
    parts = F.when(F.size("__found") == 0, F.col(text)).otherwise(F.array_join(F.zip_with(F.split(F.col(text), ANY, -1), F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    changed = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x)).cast("bigint")
    return new.withColumns({text: parts, "n_values": changed}).drop("__found", "__new")
