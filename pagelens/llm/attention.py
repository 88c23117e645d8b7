"""A small causal self-attention model in numpy.

Ids are mapped to slots: the most frequent ids have one each, all others share the last. One layer of attention over a
window mixes values of earlier slots (queries, keys and values are tables by slot, with a learned bias by distance); the
mix and a term of the current slot give scores of 32 groups, and scores of the 32 slots of the next slot's group. Groups
are made by splitting slots in half again and again along the main direction of their neighbourhoods, so that ids which
follow the same ids are together. An id of the shared slot has the share of its count among those ids.
"""

from __future__ import annotations

import numpy as np

GROUPS = MEMBERS = 32
SLOTS = GROUPS * MEMBERS
WIDTH = 16
#: Tokens of a window, and how many of them are scored; the others are context that the window before has scored.
WINDOW, STRIDE = 16, 12


class Slots:
    """Which slot each id has, and the log-probability of an id within its slot."""

    def __init__(self, counts: np.ndarray, bigrams: np.ndarray | None = None):
        order = np.argsort(-counts, kind="stable")
        single, rest = order[: SLOTS - 1], order[SLOTS - 1 :]
        place = np.arange(SLOTS)
        if bigrams is not None:
            place = _grouped(bigrams)
        self.slot = np.full(len(counts), place[SLOTS - 1], dtype=np.int32)
        self.slot[single] = place[: SLOTS - 1]
        self.within = np.zeros(len(counts))
        self.within[rest] = np.log((counts[rest] + 0.1) / (counts[rest] + 0.1).sum())


def _grouped(bigrams: np.ndarray) -> np.ndarray:
    """A slot number for each of SLOTS ranks, of which 32 successive ones are a group."""
    joint = np.sqrt(bigrams)
    joint = joint / np.sqrt((joint * joint).sum(axis=1, keepdims=True) + 1e-9)
    u, s, _ = np.linalg.svd(joint - joint.mean(axis=0), full_matrices=False)
    x = u[:, :8] * s[:8]

    def split(members: np.ndarray) -> list[np.ndarray]:
        if len(members) <= MEMBERS:
            return [members]
        own = x[members] - x[members].mean(axis=0)
        axis = np.linalg.svd(own, full_matrices=False)[2][0]
        order = members[np.argsort(own @ axis, kind="stable")]
        return split(order[: len(order) // 2]) + split(order[len(order) // 2 :])

    place = np.empty(SLOTS, dtype=np.int32)
    place[np.concatenate(split(np.arange(SLOTS)))] = np.arange(SLOTS)
    return place


def windows(slots: np.ndarray, text_at: np.ndarray, start: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and positions of scored tokens (-1: none) of all windows; texts are consecutive ranges of ``slots``."""
    lengths = np.diff(text_at)
    per = -(-lengths // stride)
    first = (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)) * stride
    before = np.empty(len(slots), dtype=np.int32)  # the slot before each token of a text
    before[1:] = slots[:-1]
    before[text_at[:-1][lengths > 0]] = start
    context = WINDOW - stride
    at = (np.repeat(text_at[:-1], per) + first - context)[:, None] + np.arange(WINDOW)  # position of the token that each place predicts
    x = before.take(at, mode="clip") if len(slots) else np.empty((0, WINDOW), dtype=np.int32)
    x[first == 0, :context] = start
    at[at >= np.repeat(text_at[1:], per)[:, None]] = -1
    at[:, :context] = -1
    return x, at


class Model:
    """Parameters by name; ``start`` is the slot before a text's first token."""

    SHAPES = {
        "q": (SLOTS, WIDTH), "k": (SLOTS, WIDTH), "v": (SLOTS, WIDTH), "r": (SLOTS, WIDTH), "near": (WINDOW,), "wg": (WIDTH, GROUPS), "bg": (GROUPS,),
        "wm": (GROUPS, WIDTH, MEMBERS), "bm": (GROUPS, MEMBERS),
    }

    def __init__(self, start: int, flat: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.start = start
        self.p: dict[str, np.ndarray] = {}
        if flat is None:
            rng = np.random.default_rng(7)
            for name, shape in self.SHAPES.items():
                self.p[name] = (rng.standard_normal(shape) * (0.0 if name[0] == "b" or name == "near" else 0.1)).astype(np.float32)
            if counts is not None:  # the shares of groups and of slots in them, to begin with
                by = (counts + 1.0).reshape(GROUPS, MEMBERS)
                self.p["bg"] = np.log(by.sum(1) / by.sum()).astype(np.float32)
                self.p["bm"] = np.log(by / by.sum(1, keepdims=True)).astype(np.float32)
        else:
            at = 0
            for name, shape in self.SHAPES.items():
                n = int(np.prod(shape))
                self.p[name] = flat[at : at + n].reshape(shape).astype(np.float32)
                at += n
        self.delta = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[name].ravel() for name in self.SHAPES])

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tables by slot side by side, biases by distance, layers (groups and one group's slots) with biases below, and what sums both halves."""
        p = self.p
        own = np.concatenate([p["wm"], p["bm"][:, None]], axis=1)
        layers = np.concatenate([np.broadcast_to(np.vstack([p["wg"], p["bg"]]), own.shape), own], axis=2)
        bias = np.where(self.delta >= 0, p["near"][np.maximum(self.delta, 0)], -1e9).astype(own.dtype)
        return np.concatenate([p[name] for name in "qkvr"], axis=1), bias, layers, np.kron(np.eye(2), np.ones((MEMBERS, 1))).astype(own.dtype)

    @staticmethod
    def _attend(x: np.ndarray, table: np.ndarray, bias: np.ndarray) -> tuple:
        """Rows of the tables, weights, and mixes with a one behind each; of the last places, as many as ``bias`` has rows."""
        rows = table.take(x, axis=0)
        q, k, v, r = (rows[:, :, i : i + WIDTH] for i in range(0, 4 * WIDTH, WIDTH))
        q, r = q[:, -len(bias) :], r[:, -len(bias) :]
        a = q @ k.transpose(0, 2, 1)
        if a.size and (a.max() > 60 or a.min() < -60):
            np.clip(a, -60, 60, out=a)
        a += bias
        np.exp(a, out=a)
        a /= (a.reshape(-1, WINDOW) @ np.ones((WINDOW, 1), a.dtype)).reshape(a.shape[:2] + (1,))
        h = np.ones(a.shape[:2] + (WIDTH + 1,), a.dtype)
        np.add(a @ v, r, out=h[:, :, :WIDTH])
        return rows, q, k, v, a, h

    @staticmethod
    def _targets(scored: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places with a token to predict ordered by its slot, its position, borders of groups in them, and the column of each one's slot."""
        at = scored.ravel()
        target = slots.take(at, mode="clip").astype(np.uint16)
        target[at < 0] = SLOTS
        order = np.argsort(target, kind="stable")[: np.count_nonzero(at >= 0)]
        target = target[order]
        return order, at[order], np.searchsorted(target, np.arange(0, SLOTS + 1, MEMBERS)), MEMBERS + (target % MEMBERS).astype(np.int64)

    @staticmethod
    def _shares(h: np.ndarray, layer: np.ndarray, sides: np.ndarray, group: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exponents of the scores of groups and of a group's slots, side by side, sums of both halves, and the scores of each token's own two."""
        e = h @ layer
        picked = e[:, group] + e.ravel()[own]
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(e, out=e)
            sums = e @ sides
        if not (1e-30 < sums.min() and sums.max() < 1e30):  # near the end of the range: once more, lowered by the greatest
            e = h @ layer
            halves = e.reshape(-1, 2, MEMBERS)
            halves -= halves.max(axis=2, keepdims=True)
            picked = e[:, group] + e.ravel()[own]
            np.exp(e, out=e)
            sums = e @ sides
        return e, sums, picked

    def scores(self, x: np.ndarray, scored: np.ndarray, slots: np.ndarray, most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Positions and natural log-probabilities of their slots; a bounded number of windows at once, as they fit a cache."""
        context = WINDOW - STRIDE
        table, bias, layers, sides = self._tables()
        positions, logs = [], []
        for lo in range(0, len(x), most):
            h = self._attend(x[lo : lo + most], table, bias[context:])[-1]
            order, at, border, column = self._targets(scored[lo : lo + most, context:], slots)
            h = h.reshape(-1, WIDTH + 1).take(order, axis=0)
            out, cells = np.empty(len(at)), np.arange(len(at)) * (2 * MEMBERS)
            for g in range(GROUPS):
                i, j = border[g], border[g + 1]
                if j > i:
                    _, sums, picked = self._shares(h[i:j], layers[g], sides, g, cells[: j - i] + column[i:j])
                    np.log(sums, out=sums)
                    out[i:j] = picked - (sums[:, 0] + sums[:, 1])
            positions.append(at)
            logs.append(out)
        return (np.concatenate(positions), np.concatenate(logs)) if positions else (np.empty(0, np.int64), np.empty(0))

    def gradient(self, x: np.ndarray, scored: np.ndarray, slots: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the tokens and its gradient."""
        table, bias, layers, sides = self._tables()
        rows, q, k, v, a, h = self._attend(x, table, bias)
        order, at, border, column = self._targets(scored, slots)
        n = max(1, len(at))
        hs = h.reshape(-1, WIDTH + 1).take(order, axis=0)
        dhs = np.zeros((len(at) + 1, WIDTH), h.dtype)  # the last one for places without a token
        dlayers, cells = np.zeros_like(layers), np.arange(len(at)) * (2 * MEMBERS)
        loss = 0.0
        for g in range(GROUPS):
            i, j = border[g], border[g + 1]
            if j > i:
                own = cells[: j - i] + column[i:j]
                e, sums, picked = self._shares(hs[i:j], layers[g], sides, g, own)
                loss += float(np.log(sums).sum() - picked.sum())
                halves, flat = e.reshape(-1, 2, MEMBERS), e.reshape(-1)
                halves *= (1 / sums)[:, :, None]
                e[:, g] -= 1
                flat[own] -= 1
                dlayers[g] = (e.T @ hs[i:j]).T
                np.matmul(e, layers[g, :WIDTH].T, out=dhs[i:j])
        dlayers /= n
        dhs /= n
        place = np.full(scored.size, len(at))
        place[order] = np.arange(len(at))
        dh = dhs.take(place, axis=0).reshape(x.shape + (WIDTH,))
        ds = dh @ v.transpose(0, 2, 1)
        ds -= np.einsum("bij,bij->bi", ds, a)[:, :, None]
        ds *= a
        drows = np.empty_like(rows)
        np.matmul(ds, k, out=drows[:, :, :WIDTH])
        np.matmul(ds.transpose(0, 2, 1), q, out=drows[:, :, WIDTH : 2 * WIDTH])
        np.matmul(a.transpose(0, 2, 1), dh, out=drows[:, :, 2 * WIDTH : 3 * WIDTH])
        drows[:, :, 3 * WIDTH :] = dh
        near = np.bincount(np.maximum(self.delta, 0).ravel(), (ds.sum(0) * (self.delta >= 0)).ravel(), WINDOW).astype(h.dtype)
        flat = x.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.diff(flat.astype(np.int32), prepend=-1))
        pairs = np.complex64 if h.dtype == np.float32 else np.complex128  # two columns are added at once
        dtable = np.zeros_like(table)
        if len(starts):
            dtable[flat[starts]] = np.add.reduceat(drows.reshape(-1, 4 * WIDTH).take(order, axis=0).view(pairs), starts, axis=0).view(h.dtype)
        grads = {name: dtable[:, i * WIDTH : (i + 1) * WIDTH] for i, name in enumerate("qkvr")}
        groups = dlayers[:, :, :MEMBERS].sum(0)
        grads |= {"near": near, "wg": groups[:WIDTH], "bg": groups[WIDTH], "wm": dlayers[:, :WIDTH, MEMBERS:], "bm": dlayers[:, WIDTH, MEMBERS:]}
        return loss / n, grads

    def train(self, batches, rate: float) -> int:
        """Adam over ``(x, scored, slots)`` batches; the number of tokens learned from."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = tokens = 0
        for x, scored, slots in batches:
            step += 1
            tokens += int((scored >= 0).sum())
            _, grads = self.gradient(x, scored, slots)
            for name, g in grads.items():
                m[name] += 0.1 * (g - m[name])
                s[name] += 0.01 * (g * g - s[name])
                self.p[name] -= rate * min(1.0, step / 20) * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.99**step)) + 1e-6)
        return tokens
