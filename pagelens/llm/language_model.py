"""Language-model scores: word counts of the whole corpus beside a causal self-attention model on subword ids.

A text is its words in lower case (A-Z), each with a space before it, and one end token. Words become ids of a public
vocabulary; each distinct word of a slice of texts is encoded once, and the ids of all texts are written once for what follows.

Gathered from all learning texts: counts of words and of subword ids. The attention model (``attention.py``) starts from a
task that learns from ``warm_docs`` texts, those with the smallest hashes; then every partition refines it on all of its
learning texts, each token once, and the refined models are averaged by the tokens they saw. Parameters are one array of
fixed size; averages are made per piece of it.

Scoring lays windows over each text, every one with some context that the window before has scored, and scores each token
once, many windows in one batch. The counts of the most frequent words, at most ``top_words``, are broadcast; other words
are joined by hash and summed per text, so the vocabulary may grow with the corpus.

Nulls and ties: null and empty text is the end token alone; null ids are scored, never learned from; an empty table gives
no rows; without learning texts all counts are 0. Rows equal in id and text come back as often as they came. Words are
told apart by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .attention import SLOTS, WINDOW, Model, Slots, windows
from .pack import Encoder
from .storage import written
from .textscan import NOT_SPACE, Scan, buffers, mix, scan, slices

SLICE = 1 << 21
PIECE = 1 << 10
WORD, SUBWORD, TEXTS, IDS = 0, 1, 2, 3
#: Windows of one step of the refinement.
STEP = 384


def vocabulary(tokenizer_file: str | None = None) -> tuple[int, int]:
    """Number of ids, and the id that closes a text."""
    import public_tokenizers as vocabularies
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file or vocabularies.path("byte_bpe_50k.json"))
    return tokenizer.get_vocab_size(), tokenizer.token_to_id("<|endoftext|>")


class Subwords:
    """Ids of scanned texts; ``end`` closes each text."""

    def __init__(self, tokenizer_file: str | None = None, rank_file: str | None = None):
        self.encoder = Encoder(tokenizer_file, rank_file)
        self.end = self.encoder.tokenizer.token_to_id("<|endoftext|>")
        self.size = self.encoder.tokenizer.get_vocab_size()
        ranks = self.encoder.fast._mergeable_ranks
        self.opens = np.zeros(self.size, dtype=bool)
        self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def _words(self, s: Scan, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after the other, and where each begins."""
        lengths = s.ends[first] - s.starts[first] + 1
        at = np.cumsum(lengths) - lengths
        source = np.repeat(s.starts[first] - 1 - at, lengths) + np.arange(lengths.sum())
        data = s.data[np.maximum(source, 0)]
        data[at] = 0x20
        try:
            ids = self.encoder.fast.encode_to_numpy(data.tobytes().decode("utf-8", "replace"), allowed_special=set(), disallowed_special=())
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(first):
                return ids, begins
        except BaseException as error:
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
        each = [np.array(self.encoder.tokenizer.encode(" " + s.word(i), add_special_tokens=False).ids, np.uint32) for i in first]
        sizes = np.array([len(e) for e in each])
        return np.concatenate(each), np.cumsum(sizes) - sizes

    def __call__(self, s: Scan, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, offsets of texts in them, distinct word hashes, and the number of each word among these."""
        distinct, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        ids, begins = self._words(s, first) if len(first) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        begins = np.append(begins, len(ids))
        lengths = np.append(np.diff(begins), 1)  # the end token is one more word
        ids = np.append(ids, np.uint32(self.end))
        order = np.insert(inverse, s.word_at[1:], len(distinct))
        n = lengths[order]
        to = np.cumsum(n)
        out = ids[np.repeat(begins[order] - (to - n), n) + np.arange(to[-1] if len(to) else 0)].astype(np.int32)
        text_at = np.concatenate([[0], to[s.word_at[1:] + np.arange(s.texts)]])
        return out, text_at, distinct, inverse


def _width(size: int) -> np.dtype:
    """How an id of the vocabulary is written."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _encoded(files: tuple):
    """A row with the ids of each text, and counts of a task's words and ids in texts to learn from; merged as they come, and let go when they are many."""
    names = ["kind", "key", "n", "doc", "body", "learn", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Subwords(*files)
        keys, numbers, held, texts, doc_type = [], [], 0, 0, None
        ids, width = np.zeros(encode.size, np.int64), _width(encode.size)

        def counted(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(key), t) for t in (doc_type, pa.int64(), pa.bool_(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), *none], names)

        def merged() -> pa.RecordBatch:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return counted(WORD, k, np.bincount(at, np.concatenate(numbers), len(k)))

        for batch in batches:
            doc_type = batch.column("doc").type
            for learn in (True, False):
                part = batch.filter(batch.column("learn") if learn else pc.invert(batch.column("learn")))
                for s in scan(part.column("text"), NOT_SPACE, SLICE):
                    out, text_at, distinct, inverse = encode(s, s.hashes())
                    offsets = pa.py_buffer((text_at * width.itemsize).astype(np.int32))
                    own = pa.Array.from_buffers(pa.binary(), s.texts, [None, offsets, pa.py_buffer(out.astype(width))])
                    none = pa.nulls(s.texts, pa.int64())
                    doc, body = part.column("doc").slice(s.first, s.texts), part.column("body").slice(s.first, s.texts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(s.texts, IDS, np.int32)), none, none, doc, body, pa.array(np.full(s.texts, learn)), own], names)
                    if learn:
                        ids += np.bincount(out, minlength=encode.size)
                        texts += s.texts
                        keys.append(distinct)
                        numbers.append(np.bincount(inverse, minlength=len(distinct)))
                        held += len(distinct)
                    if held > 3_000_000:
                        yield merged()
                        keys, numbers, held = [], [], 0
        if keys:
            yield merged()
        if texts:
            some = np.flatnonzero(ids)
            yield counted(SUBWORD, some, ids[some])
            yield counted(TEXTS, np.zeros(1, np.int64), np.array([texts]))

    return run


def _texts(batch: pa.RecordBatch, width: np.dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first row, ids and offsets of texts, a bounded number of bytes at a time."""
    raw, offsets = buffers(batch.column("ids"))
    for i, j in slices(offsets, SLICE):
        yield i, raw[offsets[i] : offsets[j]].view(width), (offsets[i : j + 1] - offsets[i]) // width.itemsize


def _window_batches(batches: Iterator[pa.RecordBatch], slot: np.ndarray, start: int, size: int, seed: int):
    """Windows without context that is scored elsewhere: each token is learned from once, with what its window holds before it."""
    rng, width = np.random.default_rng(seed), _width(len(slot))
    for batch in batches:
        for _, ids, text_at in _texts(batch, width):
            slots = slot[ids]
            x, scored = windows(slots, text_at, start, WINDOW)
            order = rng.permutation(len(x))
            for i in range(0, len(order), size):
                yield x[order[i : i + size]], scored[order[i : i + size]], slots


def _warm(counts: np.ndarray, end: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        rank = np.minimum(np.argsort(np.argsort(-counts, kind="stable"), kind="stable"), SLOTS - 1)
        pairs = np.zeros((SLOTS, SLOTS))
        for batch in kept:
            for _, ids, _ in _texts(batch, _width(len(counts))):
                r = rank[ids]
                pairs += np.bincount(r[1:] * SLOTS + r[:-1], minlength=SLOTS * SLOTS).reshape(SLOTS, SLOTS)
        table = Slots(counts, np.hstack([pairs, pairs.T]))
        model = Model(int(table.slot[end]), counts=np.bincount(table.slot, counts, SLOTS))
        for epoch in range(epochs):
            model.train(_window_batches(iter(kept), table.slot, model.start, 192 << min(epoch, 1), epoch), 0.02 / (1 + epoch))
        yield pa.RecordBatch.from_pydict({"slot": pa.array([table.slot.tobytes()], pa.binary()), "flat": pa.array([model.flat().tobytes()], pa.binary())})

    return run


def _refined(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, start, flat, _ = sent.value
        model = Model(start, flat)
        tokens = model.train(_window_batches(batches, slot, start, STEP, 1), 0.004)
        if tokens:
            new = model.flat()
            pieces = [new[i : i + PIECE].astype("<f4").tobytes() for i in range(0, len(new), PIECE)]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(pieces)), pa.int32()), "tokens": pa.array([tokens] * len(pieces), pa.int64()), "part": pa.array(pieces, pa.binary())})

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    weight: dict[int, float] = {}
    for batch in batches:
        for piece, tokens, part in zip(*(c.to_pylist() for c in batch.columns)):
            total[piece] = total.get(piece, 0) + tokens * np.frombuffer(part, "<f4").astype(np.float64)
            weight[piece] = weight.get(piece, 0) + tokens
    for piece, t in total.items():
        yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "part": pa.array([(t / weight[piece]).astype("<f4").tobytes()], pa.binary())})


def _scored(sent):
    """The model's log10 probability of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, start, flat, within = sent.value
        model, width = Model(start, flat), _width(len(slot))
        for batch in batches:
            for first, ids, text_at in _texts(batch, width):
                slots = slot[ids]
                value = np.empty(len(ids))
                at, log = model.scores(*windows(slots, text_at, start), slots)
                value[at] = log
                value += within[ids]
                n = len(text_at) - 1
                score = pa.array(np.add.reduceat(value, text_at[:-1]) / np.log(10))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(first, n), batch.column("body").slice(first, n), score], ["doc", "body", "score"])

    return run


def _base(top):
    """Per text a row with its sums, and a row for each of its words that isn't in the broadcast counts."""
    names = ["doc", "body", "key", "times", "n_tokens", "n_known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, logs, end_log, end_known = top.value
        for batch in batches:
            for s in scan(batch.column("text"), NOT_SPACE, SLICE):
                distinct, inverse = np.unique(s.hashes(), return_inverse=True)
                text = np.repeat(np.arange(s.texts), np.diff(s.word_at))
                place = np.searchsorted(common, distinct)
                known = (place < len(common)) & (common[np.minimum(place, max(0, len(common) - 1))] == distinct) if len(common) else np.zeros(len(distinct), bool)
                gain = np.where(known, logs[np.minimum(place, max(0, len(logs) - 1))], 0.0) if len(common) else np.zeros(len(distinct))
                base = np.bincount(text, gain[inverse], s.texts) + end_log
                n_known = np.bincount(text, known[inverse], s.texts).astype(np.int64) + end_known
                other = ~known[inverse]
                pair, times = np.unique(text[other].astype(np.int64) * (len(distinct) + 1) + inverse[other], return_counts=True)
                row, word = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
                doc, body = batch.column("doc").slice(s.first, s.texts), batch.column("body").slice(s.first, s.texts)
                none = mix(np.asarray(body).view(np.uint64) if body.null_count == 0 else np.zeros(s.texts, np.uint64))
                n = np.diff(s.word_at) + 1
                yield pa.RecordBatch.from_arrays(
                    [doc, body, pa.array(none.view(np.int64)), pa.array(np.zeros(s.texts, np.int32)), pa.array(n, pa.int64()), pa.array(n_known), pa.array(base)], names
                )
                i = pa.array(row)
                empty = lambda t: pa.nulls(len(row), t)
                yield pa.RecordBatch.from_arrays([doc.take(i), body.take(i), pa.array(distinct[word].view(np.int64)), pa.array(times, pa.int32()), empty(pa.int64()), empty(pa.int64()), empty(pa.float64())], names)

    return run


def lm_scores(
    docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", warm_docs: int = 1500, epochs: int = 2, top_words: int = 1 << 18,
    tokenizer_file: str | None = None, rank_file: str | None = None,
) -> DataFrame:
    """Per document ``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``; ``learn_from`` is a condition on rows."""
    spark, files = docs.sparkSession, (tokenizer_file, rank_file)
    source = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.coalesce(learn_from, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    encoded = written(source.mapInArrow(_encoded(files), f"kind int, key bigint, n bigint, doc {kind}, body bigint, learn boolean, ids binary"), "encoded")
    every = encoded.filter(F.col("kind") == IDS).select("doc", "body", "learn", "ids")
    counts = written(encoded.filter(F.col("kind") < IDS).groupBy("kind", "key").agg(F.sum("n").alias("n")), "word-counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    found = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = counts.filter(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = found.n + texts  # with one end token a text, which is one more distinct token
    scale = total + 0.1 * (found.v + (texts > 0) + 1)
    small = counts.filter(F.col("kind") == SUBWORD).select("key", "n").toPandas()  # one row an id of the vocabulary

    # The least count that at most ``top_words`` words have; few counts differ, so this list is short.
    least, many = 1, 0
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if many + r.words > top_words:
            least = r.n + 1
            break
        many += r.words
    common = words.filter(F.col("n") >= least).toPandas().sort_values("key", key=lambda k: k.to_numpy().view(np.uint64) if len(k) else k)
    end_log = float(np.log10((texts + 0.1) / scale))
    top = spark.sparkContext.broadcast((common["key"].to_numpy(np.int64).view(np.uint64), np.log10((common["n"].to_numpy(float) + 0.1) / scale), end_log, int(texts > 0)))

    size, end = vocabulary(tokenizer_file)
    ids = np.zeros(size, np.int64)
    ids[small["key"].to_numpy(np.int64)] = small["n"].to_numpy(np.int64)
    learn, order = every.filter("learn"), F.xxhash64("doc", "body")
    # The hashes are looked at first, so only texts of the sample leave their tasks.
    most = learn.select(order.alias("hash")).orderBy("hash").limit(warm_docs).agg(F.max("hash")).first()[0]
    sample = learn.filter(order <= F.lit(most)).orderBy(order).limit(warm_docs)
    warm = sample.select("ids").coalesce(1).mapInArrow(_warm(ids, end, epochs), "slot binary, flat binary").first()
    if warm is None:  # no partition to learn from: the model as it begins
        warm = next(_warm(ids, end, 0)(iter(()))).to_pandas().iloc[0]
    slot, flat = np.frombuffer(warm.slot, np.int32), np.frombuffer(warm.flat, np.float32)
    within = Slots(ids).within
    state = (slot, int(slot[end]), flat, within)
    pieces = learn.select("ids").mapInArrow(_refined(spark.sparkContext.broadcast(state)), "piece int, tokens bigint, part binary")
    mean = {r.piece: np.frombuffer(r.part, "<f4") for r in pieces.repartition("piece").mapInArrow(_averaged, "piece int, part binary").collect()}
    if mean:
        state = (*state[:2], np.concatenate([mean[i] for i in range(len(mean))]), within)

    scores = every.select("doc", "body", "ids").mapInArrow(_scored(spark.sparkContext.broadcast(state)), f"doc {kind}, body bigint, score double")
    rows = source.select("doc", "body", "text").mapInArrow(_base(top), f"doc {kind}, body bigint, key bigint, times int, n_tokens bigint, n_known bigint, base double")
    rare = words.filter(F.col("n") < least).select("key", "n")
    own = F.col("times") == 0
    met = rows.join(rare, "key", "left").unionByName(scores, allowMissingColumns=True)
    gain = F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(scale))
    grouped = met.groupBy("doc", "body").agg(
        F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"), F.max("base").alias("base"), F.max("score").alias("score"), F.count(F.when(own, 1)).alias("copies"),
        F.coalesce(F.sum(F.when(~own & F.col("n").isNotNull(), F.col("times"))), F.lit(0)).alias("rare_known"), F.coalesce(F.sum(F.when(~own, gain)), F.lit(0.0)).alias("rare"),
    )
    return grouped.select(
        F.col("doc").alias(doc_id), "n_tokens", (F.col("n_known") + F.expr("rare_known div copies")).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("rare") / F.col("copies")).alias("base_score"), "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
