"""Secret scan: three fixed patterns, and a linear-chain conditional random field for secrets of other looks.

Patterns, leftmost and non-overlapping each: ``assign`` (a keyword, a colon or equals sign and a value of 6 characters or
more), ``access`` (AKIA and capitals or digits, 20 characters or more), ``hex`` (24 lower-case hex digits or more). A span
is the whole match, in code points, end exclusive.

The field tags tokens (runs of ``[A-Za-z0-9+/_.-]`` and non-ASCII characters) as the begin of a secret, inside one or
outside. Features of a token, hashed into a table of fixed size: its shape (length, character classes, changes between
them, hex digits only), its word and first characters, the two words before and the one after, the shapes beside it, the
characters around it, and of its file the number of equals signs and the length. It is decoded by Viterbi over the whole
text. A token whose begin and inside scores are so low that no pair of neighbours could make up for it is outside on the
best path, which cuts the text there, so only runs of the other tokens are decoded step by step; the path is the same.
Spans of the field that meet no pattern's span are added with the kind ``crf``, without full stops, dashes and slashes at
their ends and with up to two equals signs behind them.

The field is fitted by AdaGrad in one task on at most ``max_texts`` distinct texts, half with and half without a match of
the patterns, those with the smallest hashes. Tokens of matched values are secrets, all others not. So that it learns
looks and not only these patterns, pieces of texts with an unmatched long run of mixed letters and digits are no examples, part of the values, keywords and signs are exchanged for random ones of other formats,
random secrets are put into texts without any, and into others ordinary identifiers, numbers and paths.
The weights (2^18 pairs of single precision) go to all tasks, whatever the input's size.

Nulls and odd input: a null text is empty and has no spans. Every row is scanned by itself: repeated rows and ids and null
ids get their own rows. An empty table gives no rows and fits nothing. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textscan import Scan, buffers, scan

KINDS = ("assign", "access", "hex", "crf")
#: On texts in lower case.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: The same in the JVM's patterns, to tell texts with and without a match.
MATCHED = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""

TOKEN = np.zeros(256, dtype=bool)
TOKEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *map(ord, "+/_.-"), *range(0x80, 0x100)]] = True
BITS = 18
_ODD = [pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) | 1 for k in range(16)]
_LENGTHS = np.array([2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64])
_CHANGES = np.array([1, 2, 3, 5, 9])
#: Classes of bytes: lower, upper, digit, other signs, non-ASCII; and two tables of counts, 20 bits each.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[128:] = 0, 1, 2, 4
_COUNT = np.array([1, 1 << 20, 1 << 40, 0, 0], np.uint64)[_CLASS]
_MORE = np.array([0, 0, 0, 1, 1 << 20], np.uint64)[_CLASS]
_MORE[ord("a") : ord("f") + 1] += np.uint64(1 << 40)


def base_spans(text: bytes, low: bytes, longest: int) -> list[tuple[int, int, int, int, int]]:
    """Matches of the patterns as (kind, start, end, start of the value, its end), in bytes.

    ``low`` is the text in lower case (A-Z), ``longest`` the length of its longest token, in which the other two must lie.
    """
    out = []
    if any(k in low for k in _KEYWORDS):
        out += [(0, m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 6]
    if longest >= 20 and b"AKIA" in text:
        out += [(1, m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if longest >= 24:
        out += [(2, m.start(), m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def file_kinds(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text a number for how many equals signs it has and how long it is."""
    signs = np.diff(_sums(raw == ord("="))[at]).astype(np.int64)
    return np.minimum(7, np.ceil(np.log2(signs + 1))).astype(np.int64) * 8 + np.minimum(7, np.log2(np.diff(at) + 1) / 3).astype(np.int64)


def features(s: Scan, raw: np.ndarray, files: np.ndarray) -> np.ndarray:
    """Slots of the features of all tokens of a slice of texts, one row per feature."""
    n = len(s.starts)
    cls = _CLASS[raw]
    change = np.zeros(len(raw), np.uint64)
    change[1:] = cls[1:] != cls[:-1]
    one, two, turn = _sums(_COUNT[raw]), _sums(_MORE[raw]), _sums(change)
    one, two = one[s.ends] - one[s.starts], two[s.ends] - two[s.starts]
    turns = turn[s.ends] - turn[s.starts + 1] if n else np.empty(0, np.uint64)
    field = lambda x, k: (x >> np.uint64(20 * k)) & np.uint64((1 << 20) - 1)
    length = s.ends - s.starts
    digits, hexes = field(one, 2), field(two, 2)
    mask = (field(one, 0) > 0) | ((field(one, 1) > 0) * 2) | ((digits > 0) * 4) | ((field(two, 0) > 0) * 8) | ((field(two, 1) > 0) * 16) | ((digits + hexes == length.astype(np.uint64)) * 32)
    sizes = np.searchsorted(_LENGTHS, length, "right")
    shape = ((mask * 16 + sizes) * 8 + np.searchsorted(_CHANGES, turns.astype(np.int64), "right")).astype(np.uint64) + np.uint64(1)
    share = ((digits.astype(np.float64) * 8 / np.maximum(1, length)).astype(np.uint64) * np.uint64(16) + sizes.astype(np.uint64)) + np.uint64(1)
    word, prefix = s.hashes(), s.hashes(4)
    text = np.repeat(np.arange(s.texts), np.diff(s.word_at))

    def beside(x: np.ndarray, by: int) -> np.ndarray:
        """The value of a token before or after in the same text, or 0."""
        out = np.zeros(n, np.uint64)
        if abs(by) < n:
            src, dst = (slice(0, n - by), slice(by, n)) if by > 0 else (slice(-by, n), slice(0, n + by))
            out[dst] = np.where(text[src] == text[dst], x[src], np.uint64(0))
        return out

    padded = np.concatenate([np.zeros(2, np.uint64), raw, np.zeros(2, np.uint64)])
    inside = lambda at, lo, hi: np.where((at >= lo) & (at < hi), padded[at + 2], np.uint64(0))
    lo, hi = s.text_at[text], s.text_at[text + 1]
    left = inside(s.starts - 1, lo, hi) * np.uint64(256) + inside(s.starts - 2, lo, hi)
    right = inside(s.ends, lo, hi) * np.uint64(256) + inside(s.ends + 1, lo, hi)
    file = files[text].astype(np.uint64)
    plain = np.ones(n, np.uint64)
    columns = [plain, shape, word, prefix ^ sizes.astype(np.uint64), beside(word, 1), beside(word, 2), beside(word, -1), beside(shape, 1), beside(shape, -1), left, right, share, left * np.uint64(1 << 16) + shape, file * np.uint64(1 << 16) + shape]
    out = np.empty((len(columns), n), np.uint32)
    for k, x in enumerate(columns):
        out[k] = ((x + np.uint64(k)) * np.uint64(_ODD[k])) >> np.uint64(64 - BITS)
    return out


# Fitting


def _chains(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of tags, expected transitions and first tags, of chains of one length: e is (chains, length, 3)."""
    m, length, _ = e.shape
    forward, backward = np.empty_like(e), np.zeros_like(e)
    forward[:, 0] = start + e[:, 0]
    lse = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
    for t in range(1, length):
        forward[:, t] = e[:, t] + lse(forward[:, t - 1, :, None] + trans, 1)
    for t in range(length - 2, -1, -1):
        backward[:, t] = lse(trans + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
    z = lse(forward[:, -1], 1)
    marginal = np.exp(forward + backward - z[:, None, None])
    moves = np.zeros((3, 3))
    for t in range(1, length):
        moves += np.exp(forward[:, t - 1, :, None] + trans + (e[:, t] + backward[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
    return marginal, moves, marginal[:, 0].sum(axis=0)


def fit(slots: np.ndarray, tags: np.ndarray, border: np.ndarray, epochs: int = 6, rate: float = 0.3, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (one complex number per slot: begin and inside against outside), transitions and start scores."""
    rng = np.random.default_rng(seed)
    weights = np.zeros((1 << BITS, 2))
    trans, start = np.zeros((3, 3)), np.zeros(3)
    sq, sq_trans, sq_start = np.full(weights.shape, 1e-8), np.full((3, 3), 1e-8), np.full(3, 1e-8)
    length = np.diff(border)
    for _ in range(epochs):
        # Chains of like length go together, in random order.
        order = np.argsort(length + rng.random(len(length)), kind="stable")
        batches = np.split(order, np.arange(256, len(order), 256))
        for b in rng.permutation(len(batches)):
            chains = batches[b]
            used, gradient, moves, first, done = [], [], np.zeros((3, 3)), np.zeros(3), 0
            for size in np.unique(length[chains]).tolist():
                rows = border[chains[length[chains] == size]][:, None] + np.arange(size)
                if not size:
                    continue
                at = slots[:, rows.ravel()]
                e = np.zeros((rows.shape[0], size, 3))
                e[:, :, 1:] = weights[at].sum(axis=0).reshape(*rows.shape, 2)
                marginal, expected, begins = _chains(e, trans, start)
                seen = np.eye(3)[tags[rows]]
                used.append(at)
                gradient.append((marginal - seen)[:, :, 1:].reshape(-1, 2))
                moves += expected - np.einsum("itj,itk->jk", seen[:, :-1], seen[:, 1:])
                first += begins - seen[:, 0].sum(axis=0)
                done += rows.shape[0]
            if not done:
                continue
            at, g = np.concatenate(used, axis=1).ravel(), np.concatenate(gradient) / done
            full = np.stack([np.bincount(at, np.tile(g[:, c], slots.shape[0]), 1 << BITS) for c in (0, 1)], axis=1)
            touched = np.flatnonzero(full.any(axis=1))
            step = full[touched] + l2 * weights[touched]
            sq[touched] += step * step
            weights[touched] -= rate * step / np.sqrt(sq[touched])
            for x, s, d in ((trans, sq_trans, moves / done), (start, sq_start, first / done)):
                s += d * d
                x -= rate * d / np.sqrt(s)
                np.clip(x, -6, 6, out=x)
    return weights.astype(np.float32).view(np.complex64).ravel(), trans, start


# Examples. Random secrets and their surroundings, and ordinary strings that only look like them.

_UPPER, _SMALL, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_NAMES = "password passwd secret token api_key apikey client_secret access_key auth credential private_key bearer key pwd signature".split()
_SIGNS = [" = ", "=", ": ", ":", " => ", ' = "', '="', '": "', " ", " is "]
_IDENTIFIERS = "getUserName max_length README.md http/1.1 utf-8 std.io.Reader v1.2.3 /usr/local/lib/python3 node_modules/react 2024-03-01T10 user_id x86_64 ISO-8859-1 background-color parseInt32 e.g. A4 CO2 3.14159 10.0.0.1".split()


def _random_secret(rng: np.random.Generator) -> str:
    pick = lambda letters, lo, hi: "".join(rng.choice(list(letters), rng.integers(lo, hi + 1)))
    kind = rng.integers(8)
    if kind == 0:
        return pick("abcdef" + _DIGITS, 24, 64)
    if kind == 1:
        return pick(_UPPER[:6] + _DIGITS, 24, 64)
    if kind == 2:
        return pick(_SMALL, 2, 4) + "_" + pick(_SMALL + _UPPER + _DIGITS, 20, 40)
    if kind == 3:
        return pick(_UPPER + _SMALL + _DIGITS + "+/", 24, 64)
    if kind == 4:
        return "eyJ" + pick(_UPPER + _SMALL + _DIGITS + "_-", 16, 40) + "." + pick(_UPPER + _SMALL + _DIGITS + "_-", 20, 60)
    if kind == 5:
        return pick(_UPPER, 4, 4) + pick(_UPPER + _DIGITS, 12, 20)
    if kind == 6:
        return pick(_SMALL, 2, 3) + "-" + pick(_SMALL + _UPPER + _DIGITS, 20, 48)
    return pick(_UPPER + _SMALL + _DIGITS, 16, 40)


def _ordinary(rng: np.random.Generator) -> str:
    if rng.random() < 0.1:  # a UUID
        return "-".join("".join(rng.choice(list("abcdef" + _DIGITS), n)) for n in (8, 4, 4, 4, 12))
    if rng.random() < 0.5:
        return str(rng.choice(_IDENTIFIERS))
    return "".join(rng.choice(list(_DIGITS), rng.integers(1, 20)))


_RUN = re.compile(rb"[A-Za-z0-9]{16,}")


def _unsure(piece: bytes, marked: list[tuple[int, int]]) -> bool:
    """Whether the piece has an unmarked long run of mixed letters and digits, of which nobody told what it is."""
    for m in _RUN.finditer(piece):
        kinds = _CLASS[np.frombuffer(m[0], np.uint8)]
        if (np.diff(kinds.astype(int)) != 0).sum() >= 4 and (kinds == 2).any() and not any(a < m.end() and b > m.start() for a, b in marked):
            return True
    return False


def examples(texts: list[bytes], seed: int = 11) -> tuple[list[bytes], list[list[tuple[int, int]]], list[int]]:
    """Pieces of texts with the byte ranges of secrets in them, and the text of each; part of them altered."""
    rng = np.random.default_rng(seed)
    pieces, spans, source = [], [], []

    def add(k: int, piece: bytes, marked: list[tuple[int, int]]) -> None:
        if _unsure(piece, marked):
            return
        pieces.append(piece)
        spans.append(marked)
        source.append(k)

    def border(text: bytes, at: int) -> int:
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return at

    for k, text in enumerate(texts):
        found = sorted((v, w) for _, _, _, v, w in base_spans(text, text.lower(), len(text)))
        for v, w in found[:8]:
            lo, hi = border(text, max(0, v - 160)), border(text, min(len(text), w + 160))
            inside = [(max(a, lo) - lo, min(b, hi) - lo) for a, b in found if a < hi and b > lo]
            add(k, text[lo:hi], inside)
            alone = all(b <= v - 40 or a >= w + 40 for a, b in found if (a, b) != (v, w))
            if alone:  # with another value, and half of the time with another name and sign before it
                value = _random_secret(rng).encode()
                before = text[lo:v] if rng.random() < 0.5 else text[lo : border(text, max(lo, v - 40))] + f" {rng.choice(_NAMES)}{rng.choice(_SIGNS)}".encode()
                kept = [(a - lo, b - lo) for a, b in found if a >= lo and b <= lo + min(len(before), v - 40 - lo)]
                add(k, before + value + text[w:hi], [*kept, (len(before), len(before) + len(value))])
        for _ in range(3):
            lo = border(text, int(rng.integers(0, len(text) + 1)))
            hi = border(text, min(len(text), lo + 400))
            if any(a < hi and b > lo for a, b in found):
                continue
            piece, chance = text[lo:hi], rng.random()
            at = piece.rfind(b" ", 0, len(piece) // 2) + 1
            if chance < 0.2:
                value = _random_secret(rng).encode()
                before = piece[: at * int(rng.integers(0, 4) > 0)] + (f"{rng.choice(_NAMES)}{rng.choice(_SIGNS)}".encode() if rng.random() < 0.6 else b"")
                add(k, before + value + b" " + piece[at:], [(len(before), len(before) + len(value))])
            elif chance < 0.5:
                name = f"{rng.choice(_NAMES)}{rng.choice([' ', ', ', '. '])}" if rng.random() < 0.3 else ""
                add(k, piece[:at] + name.encode() + _ordinary(rng).encode() + b" " + piece[at:], [])
            else:
                add(k, piece, [])
    return pieces, spans, source


def fitted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The field's weights from these texts."""
    lengths = np.cumsum([0, *map(len, texts)])
    kinds = file_kinds(np.frombuffer(b"".join(texts), np.uint8), lengths)
    pieces, spans, source = examples(texts)
    slots, tags, sizes = [], [], []
    column = pa.array(pieces, pa.binary())
    raw, offsets = buffers(column)
    for s in scan(column, TOKEN):
        rows = slice(s.first, s.first + s.texts)
        slots.append(features(s, raw[offsets[s.first] : offsets[s.first + s.texts]], kinds[np.array(source[rows], np.int64)]))
        for t in range(s.texts):
            lo, hi = s.word_at[t], s.word_at[t + 1]
            starts, ends = s.starts[lo:hi] - s.text_at[t], s.ends[lo:hi] - s.text_at[t]
            tag = np.zeros(hi - lo, np.int64)
            for a, b in spans[s.first + t]:
                inside = np.flatnonzero((starts < b) & (ends > a))
                tag[inside] = 2
                tag[inside[:1]] = 1
            tags.append(tag)
            sizes.append(len(tag))
    if not sum(sizes):
        return np.zeros(1 << BITS, np.complex64), np.zeros((3, 3)), np.array([0.0, -6, -6])
    return fit(np.concatenate(slots, axis=1), np.concatenate(tags), np.cumsum([0, *sizes]))


# Decoding


def viterbi(e: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best tags of chains of one length; first and last are the scores beside the chains."""
    best, back = first + e[:, 0], np.empty(e.shape, np.int8)
    for t in range(1, e.shape[1]):
        step = best[:, :, None] + trans
        back[:, t] = step.argmax(axis=1)
        best = step.max(axis=1) + e[:, t]
    tags = np.empty(e.shape[:2], np.int8)
    tags[:, -1] = (best + last).argmax(axis=1)
    for t in range(e.shape[1] - 1, 0, -1):
        tags[:, t - 1] = np.take_along_axis(back[:, t], tags[:, t, None].astype(np.int64), 1)[:, 0]
    return tags


def decoded(scores: np.ndarray, text_at: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tags of all tokens; scores are (tokens, 2) against outside, text_at the range of tokens of each text."""
    n = len(scores)
    tags = np.zeros(n, np.int8)
    # What a tag other than outside can gain from both neighbours at most; beside a text's ends nothing stands.
    ahead = np.vstack([trans, start])
    behind = np.hstack([trans, np.zeros((3, 1))])
    gain = max((ahead[:, x] - ahead[:, 0]).max() + (behind[x] - behind[0]).max() for x in (1, 2))
    open_ = scores.max(axis=1, initial=-np.inf) + gain >= 0
    text = np.zeros(n + 1, np.int64)
    np.add.at(text, text_at[1:-1], 1)
    text = np.cumsum(text[:n])
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    new = np.r_[True, (np.diff(at) > 1) | (np.diff(text[at]) > 0)]
    lo = at[new]
    hi = at[np.r_[new[1:], True]] + 1
    for size in np.unique(hi - lo).tolist():
        run = lo[hi - lo == size]
        rows = run[:, None] + np.arange(size)
        e = np.zeros((*rows.shape, 3))
        e[:, :, 1:] = scores[rows]
        first = np.where((run == text_at[text[run]])[:, None], start, trans[0])
        last = np.where((run + size == text_at[text[run] + 1])[:, None], 0.0, trans[:, 0])
        tags[rows] = viterbi(e, trans, first, last)
    return tags


def _found(weights: np.ndarray, trans: np.ndarray, start: np.ndarray, texts: pa.Array) -> Iterator[tuple[int, list[list[tuple[int, int, int]]]]]:
    """Per text of each slice its spans (start, kind, end) in code points, in order."""
    raw, offsets = buffers(texts)
    for s in scan(texts, TOKEN):
        own = raw[offsets[s.first] : offsets[s.first + s.texts]]
        slots = features(s, own, file_kinds(own, s.text_at))
        scores = np.zeros(slots.shape[1], np.complex64)
        for row in slots:
            scores += weights[row]
        tags = decoded(scores.view(np.float32).reshape(-1, 2).astype(np.float64), s.word_at, trans, start)
        inside = np.flatnonzero(tags)
        text = np.searchsorted(s.word_at, inside, "right") - 1
        # A span begins at a begin tag, and where an inside tag follows no token of a span of the same text.
        begins = np.r_[True, (tags[inside][1:] == 1) | (np.diff(inside) > 1) | (np.diff(text) > 0)] if len(inside) else np.empty(0, bool)
        starts, ends = s.starts[inside[begins]], s.ends[inside[np.r_[begins[1:], True]]] if len(inside) else np.empty(0, np.int64)
        of = dict()
        for t, a, b in zip(text[begins].tolist(), starts.tolist(), ends.tolist()):
            of.setdefault(t, []).append((a, b))
        data, low, out = own.tobytes(), s.data.tobytes(), []
        longest = np.zeros(s.texts, np.int64)
        np.maximum.at(longest, np.repeat(np.arange(s.texts), np.diff(s.word_at)), s.ends - s.starts)
        for t in range(s.texts):
            lo, hi = int(s.text_at[t]), int(s.text_at[t + 1])
            body = data[lo:hi]
            spans = [(a, kind, b) for kind, a, b, _, _ in base_spans(body, low[lo:hi], longest[t])]
            for a, b in of.get(t, ()):
                a, b = a - lo, b - lo
                value = body[a:b]
                a, b = a + len(value) - len(value.lstrip(b"./-+")), b - (len(value) - len(value.rstrip(b"./-+")))
                if a < b:
                    b += len(body[b : b + 2]) - len(body[b : b + 2].lstrip(b"="))
                    if not any(x < b and y > a for x, kind, y in spans if kind < 3):
                        spans.append((a, 3, b))
            if spans and not body.isascii():
                place = np.r_[0, np.cumsum((own[lo:hi] & 0xC0) != 0x80)]
                spans = [(int(place[a]), kind, int(place[b])) for a, kind, b in spans]
            out.append(sorted(spans))
        yield s.first, out


@lru_cache(maxsize=2)
def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest = np.frombuffer(packed, np.float64, 12, 8 << BITS)
    return np.frombuffer(packed, np.complex64, 1 << BITS), rest[:9].reshape(3, 3), rest[9:]


def learned(docs: DataFrame, max_texts: int, text: str) -> bytes | None:
    """Weights fitted on at most max_texts texts, or None where there is no text."""
    texts = docs.select(F.col(text).cast("string").alias("text")).filter("length(text) > 0").withColumn("h", F.xxhash64("text"))
    hashes = texts.withColumn("matched", F.col("text").rlike("(?i:" + MATCHED.split("|AKIA")[0] + ")|AKIA" + MATCHED.split("|AKIA")[1])).select("h", "matched").distinct()
    half = [hashes.filter(F.col("matched") == m).orderBy("h").limit(max_texts // 2).select("h") for m in (True, False)]
    # Hashes first, at most max_texts of them; then one text of each.
    chosen = texts.join(F.broadcast(half[0].unionByName(half[1])), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))

    def train(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = pd.concat([*parts, pd.DataFrame({"h": pd.Series(dtype="int64"), "text": pd.Series(dtype="object")})])
        ordered = all_.sort_values("h")
        if len(ordered):
            weights, trans, start = fitted([t.encode() for t in ordered["text"]])
            yield pd.DataFrame({"packed": [weights.tobytes() + trans.astype(np.float64).tobytes() + start.astype(np.float64).tobytes()]})

    row = chosen.coalesce(1).mapInPandas(train, "packed binary").first()
    return None if row is None else bytes(row.packed)


def secret_scan(docs: DataFrame, max_texts: int = 4000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``(doc_id, spans)``: an array of (kind, start, end), by start, then kind in the order of ``KINDS``.

    Fitting runs as a job while the result is built.
    """
    packed = learned(docs, max_texts, text)
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = _unpacked(packed) if packed is not None else (np.zeros(1 << BITS, np.complex64), np.zeros((3, 3)), np.array([0.0, -6, -6]))
        for batch in batches:
            for first, found in _found(*field, batch.column("text")):
                spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in of] for of in found], pa.list_(span))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(first, len(found)), spans], ["doc", "spans"])

    kind = source.schema["doc"].dataType.simpleString()
    found = source.mapInArrow(run, f"doc {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return found.withColumnRenamed("doc", doc_id)
