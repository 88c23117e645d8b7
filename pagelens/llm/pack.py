"""Sequence packing by minimum bin slack.

A document is its tokens and one end token. Full windows are cut from it at once; what is left over, of 1 to window - 1
tokens, waits in a pool. Each further window starts with the longest waiting piece, and a bitset subset-sum over the
multiset of the other lengths (a Python integer whose bit s says that s can be filled) finds the multiset that leaves the
least slack; its counts are found again by walking the bitsets backwards. The pool is refilled before it runs short, so
the search always has many lengths to choose from. When the input ends, a gap is closed by cutting a waiting piece, and
the last, incomplete window is laid into sequences whose sizes are powers of two, which need no padding.

Each task packs its own partition as it streams by: no shuffle, and memory for one pool. Sequence ids hold the number of
the partition in the upper bits. A task that runs again packs its rows again, as a whole.

Nulls and ties: null text is empty, its only token is the end token; a null id stays null; equal rows are packed as often
as they come; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .textscan import buffers, slices

#: Waiting pieces below which the pool is refilled before another window is packed.
POOL = 1024


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is the largest that is at most ``room``."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    goal = 1 << room
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0 and not reach & goal:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & full
            left -= take
            take *= 2
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] += take
            at -= length * take
    return dict(out)


class Packer:
    """Pieces in, rows ``(doc, start, ids, doc_tokens, sequence, offset)`` out."""

    def __init__(self, window: int, first_sequence: int = 0):
        self.window, self.sequence = window, first_sequence
        self.waiting: dict[int, list] = defaultdict(list)
        self.count = 0

    def _put(self, pieces: Iterable[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def _take(self, length: int) -> tuple:
        own = self.waiting[length]
        piece = own.pop()
        if not own:
            del self.waiting[length]
        self.count -= 1
        return piece

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            yield from self._put([(doc, start, ids[start : start + self.window], total)])
        if whole < total:
            self.waiting[total - whole].append((doc, whole, ids[whole:].copy(), total))
            self.count += 1
        while self.count >= 2 * POOL:
            yield from self._pack()

    def _pack(self) -> Iterator[tuple]:
        chosen = [self._take(max(self.waiting))]
        room = self.window - len(chosen[0][2])
        for length, n in fill({k: len(v) for k, v in self.waiting.items()}, room).items():
            chosen += [self._take(length) for _ in range(n)]
            room -= length * n
        if room and self.count:  # no multiset fits exactly: cut a piece, which is longer than the gap
            doc, start, ids, total = self._take(max(self.waiting))
            chosen.append((doc, start, ids[:room], total))
            self.waiting[len(ids) - room].append((doc, start + room, ids[room:], total))
            self.count += 1
        yield from self._put(chosen)

    def end(self) -> Iterator[tuple]:
        while sum(k * len(v) for k, v in self.waiting.items()) >= self.window:
            yield from self._pack()
        rest = [self._take(k) for k in sorted(self.waiting, reverse=True) for _ in range(len(self.waiting[k]))]
        left = sum(len(x[2]) for x in rest)
        while left:
            size = 1 << left.bit_length() - 1
            room, now = size, []
            while room:
                doc, start, ids, total = rest.pop(0)
                now.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= len(now[-1][2])
            yield from self._put(now)
            left -= size


class Encoder:
    """Ids of the byte-level vocabulary. The rank file holds the same vocabulary as the tokenizer file and is read by a
    faster library; texts it gives up on go to the tokenizer itself."""

    def __init__(self, tokenizer_file: str | None = None, rank_file: str | None = None):
        import public_tokenizers as vocabularies
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file or vocabularies.path("byte_bpe_50k.json"))
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        with open(rank_file or vocabularies.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.special = list(added)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all" if any(x in text for x in self.special) else set(), disallowed_special=())
        except BaseException as error:  # the pattern library stops at very long runs of one kind, with an error or a panic
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def packed(docs: DataFrame, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", tokenizer_file: str | None = None, rank_file: str | None = None) -> DataFrame:
    """Pieces of all documents: ``(doc_id, start, ids, doc_tokens, sequence_id, offset)``; ids as little-endian 32-bit values."""
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_file, rank_file)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        key_type = None
        rows: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*rows)
            arrays = [pa.array(doc, key_type), pa.array(start, pa.int64()), pa.array([np.asarray(x, "<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["doc", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def pieces() -> Iterator[tuple]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field("doc").type
                raw, at = buffers(batch.column("text"))
                for i, j in slices(at):
                    keys = batch.column("doc").slice(i, j - i).to_pylist()
                    for doc, a, b in zip(keys, at[i:j].tolist(), at[i + 1 : j + 1].tolist()):
                        yield from packer.add(doc, np.append(encode(raw[a:b].tobytes().decode("utf-8", "replace")), np.uint32(end_id)))
            yield from packer.end()

        for row in pieces():
            rows.append(row)
            size += len(row[2])
            if size >= 1 << 19:
                yield batch_of()
                rows, size = [], 0
        if rows:
            yield batch_of()

    out = source.mapInArrow(run, f"doc {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("doc", doc_id)
