"""Address literals and reserved ranges as native column expressions (SQL text)."""

from __future__ import annotations

from ..constants import INTERNAL_HOSTNAMES, INTERNAL_SUFFIXES, RESERVED_V4
from .sqltext import extract, in_list, q, rlike, sub

TOO_BIG = 2**53


def reserved_v4(ip: str) -> str:
    """CIDR of the first reserved range that holds a 32-bit address, else NULL."""
    ranges = ", ".join(
        f"struct({base}L AS lo, {base + 2 ** (32 - bits) - 1}L AS hi, '{cidr}' AS cidr)"
        for cidr, base, bits in RESERVED_V4
    )
    return f"get(filter(array({ranges}), r_ -> {ip} BETWEEN r_.lo AND r_.hi), 0).cidr"


def _number(p: str) -> str:
    """One address part as a number, NULL when it is none: the prefix gives the radix, then digits are checked once."""
    parts = (
        f"CASE WHEN {rlike(p, '^0[xX]')} THEN struct(16 AS radix, substring({p}, 3) AS digits) "
        f"WHEN {rlike(p, '^0.')} THEN struct(8 AS radix, substring({p}, 2) AS digits) ELSE struct(10 AS radix, {p} AS digits) END"
    )
    allowed = "CASE n_.radix WHEN 16 THEN '^[0-9a-fA-F]*$' WHEN 8 THEN '^[0-7]*$' ELSE '^[0-9]+$' END"
    # Twelve digits of any radix stay below the limit; longer values are too big for an address anyway.
    value = f"CASE WHEN length(ltrim('0', n_.digits)) > 12 THEN {TOO_BIG}L ELSE coalesce(CAST(conv(n_.digits, n_.radix, 10) AS BIGINT), 0L) END"
    return f"transform(array({parts}), n_ -> CASE WHEN n_.digits RLIKE {allowed} THEN {value} END)[0]"


def ipv4_literal(host: str) -> str:
    """32-bit value of an address literal in any accepted spelling, else NULL."""
    parts = f"split({sub(host, r'\.$', '')}, {q(r'\.')})"
    numbers = f"transform({parts}, p_ -> {_number('p_')})"
    prefix = "slice(n_, 1, size(n_) - 1)"
    room = "CAST(pow(256, 5 - size(n_)) AS BIGINT)"
    value = f"aggregate({prefix}, 0L, (acc_, x_) -> acc_ * 256L + x_) * {room} + element_at(n_, -1)"
    ok = (
        f"size(n_) <= 4 AND NOT exists(n_, x_ -> x_ IS NULL) AND NOT exists({prefix}, x_ -> x_ > 255) "
        f"AND element_at(n_, -1) < {room}"
    )
    return f"transform(array({numbers}), n_ -> CASE WHEN size(n_) > 4 THEN NULL WHEN {ok} THEN {value} END)[0]"


def dotted_quad(text: str) -> str:
    """Strict a.b.c.d value, else NULL."""
    parts = f"transform(split({text}, {q(r'\.')}), p_ -> CAST(p_ AS BIGINT))"
    shape = rlike(text, r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    value = "aggregate(n_, 0L, (acc_, x_) -> acc_ * 256L + x_)"
    return (
        f"CASE WHEN {shape} THEN transform(array({parts}), n_ -> "
        f"CASE WHEN NOT exists(n_, x_ -> x_ > 255) THEN {value} END)[0] END"
    )


def ipv6_groups(literal: str) -> str:
    """ARRAY<BIGINT> of the eight 16-bit groups, NULL when the literal is malformed."""
    v4 = dotted_quad(extract(literal, r"([0-9.]+)$"))
    as_hex = (
        f"concat({extract(literal, r'^(.*:)[0-9.]+$')}, lower(hex(shiftright({v4}, 16))), ':', "
        f"lower(hex({v4} & 65535L)))"
    )
    text = f"CASE WHEN contains({literal}, '.') THEN {as_hex} ELSE {literal} END"
    side = lambda s: f"CASE WHEN {s} = '' THEN CAST(array() AS array<string>) ELSE split({s}, ':') END"
    halves = (
        f"transform(array({text}), t_ -> CASE WHEN t_ IS NULL THEN NULL WHEN contains(t_, '::') THEN "
        f"struct(true AS short, {side('''regexp_extract(t_, '^(.*?)::', 1)''')} AS head, "
        f"{side('''regexp_extract(t_, '::(.*)$', 1)''')} AS tail) "
        f"ELSE struct(false AS short, split(t_, ':') AS head, CAST(array() AS array<string>) AS tail) END)[0]"
    )
    missing = "8 - size(h_.head) - size(h_.tail)"
    ok = (
        f"h_ IS NOT NULL AND NOT exists(concat(h_.head, h_.tail), g_ -> NOT {rlike('g_', '^[0-9a-fA-F]{1,4}$')}) "
        f"AND CASE WHEN h_.short THEN {missing} >= 1 ELSE {missing} = 0 END"
    )
    groups = (
        f"transform(concat(h_.head, array_repeat('0', {missing}), h_.tail), g_ -> CAST(conv(g_, 16, 10) AS BIGINT))"
    )
    return f"transform(array({halves}), h_ -> CASE WHEN {ok} THEN {groups} END)[0]"


def reserved_v6(groups: str) -> str:
    """Reserved range of an IPv6 address (embedded IPv4 judged by its own range), else NULL."""
    zero = lambda n: f"NOT exists(slice(v_, 1, {n}), x_ -> x_ <> 0)"
    embedded = reserved_v4("(v_[6] * 65536L + v_[7])")
    return (
        f"transform(array({groups}), v_ -> CASE WHEN v_ IS NULL THEN NULL "
        f"WHEN {zero(7)} AND v_[7] = 1 THEN '::1' WHEN {zero(8)} THEN ':: (unspecified)' "
        f"WHEN (v_[0] & 65024L) = 64512 THEN 'fc00::/7' WHEN (v_[0] & 65472L) = 65152 THEN 'fe80::/10' "
        f"WHEN (v_[0] & 65280L) = 65280 THEN 'ff00::/8' "
        f"WHEN v_[0] = 8193 AND v_[1] = 3512 THEN '2001:db8::/32' "
        f"WHEN {zero(5)} AND v_[5] IN (0, 65535) THEN concat('IPv4-in-IPv6 ', {embedded}) END)[0]"
    )


def internal_name(host: str) -> str:
    suffixes = " OR ".join(f"endswith({host}, {q(s)})" for s in INTERNAL_SUFFIXES)
    return f"({in_list(host, INTERNAL_HOSTNAMES)} OR {suffixes})"
