"""Language-model scores from a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

A token's probability is ``p(class | context) * p(slot | class, context) * p(token | slot)``. The ``HEAD`` most frequent tokens
are classes of their own; all other tokens, unknown ones too, fall into ``TAILS`` classes by their last two bytes. In those
the ``NAMED`` next most frequent tokens have a slot each, and all others of a class one together. The model is
log-bilinear: the ``CONTEXT`` slots before are looked up as vectors, weighted by position and component, and summed; the
sum's product with the vector of a class, or of a slot inside its class, and a bias, is the score of either. It is trained on all learned
tokens without a normaliser, with ``NOISE`` noise classes for a batch and ``SLOT_NOISE`` noise slots of the class for a token, drawn
by their frequency; scoring normalises both exactly, by matrix products of contexts with all class vectors, and with those of the slots
of the token's class. A token with a slot of its own is thereby predicted from its context; the others of a slot have their share of
its count, with a tenth added to each known token and to the unknown ones together, so that all probabilities of a context add up to 1.

Counts cover all learned tokens of the corpus and grow with it: they are a table that is joined to the distinct words
of blocks of texts. Only the trained model has a fixed size. Blocks of about ``BLOCK_TOKENS`` tokens are dealt to ``ROUNDS``
rounds; in a round each of its blocks trains the model alone, from the round's start, and the results are averaged by
the blocks' tokens (as whole multiples of 2^-20, so that the order of additions plays no part). Every learned token is
used once. Blocks are stored and moved as compressed bytes.

Defined cases: a null text is empty and has just its end token; a null id is neither learned from nor held out. A very
long text is split into words in parts, and is a block of its own. Repeated rows each count and are scored alike.
Equally frequent tokens are ordered by their bytes. Without a learned row all counts are 0 and the model is that of
equally likely classes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import textkit as K
from lodestrata.llm.language import held_out
from lodestrata.llm.storage import join_checked, new_path, plain, stored, table

HEAD, TAILS, NAMED = 64, 128, 4096
WIDTH, CONTEXT = 16, 3
NOISE, SLOT_NOISE, BATCH = 32, 2, 1024
RATE, ROUNDS = 0.03, 8
BLOCK_TOKENS = 2_000_000
#: Tokens that are scored by one matrix product.
PRODUCT = 4096
#: Added to each token's count.
ADDED = 0.1
PART_BYTES = 1_000_000

END = b"\n"  # no word has a line end
_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_UNIT = float(1 << 20)
#: Beyond this a score's exponential may not be a float.
_HIGH = 60.0
_BLOCK = "block long, round int, doc_ids array<{id}>, lengths binary, learned binary, ids binary, words binary, n binary"


def numbers(text: str | None, index) -> Iterator[np.ndarray]:
    """The numbers of a text's tokens; ``index`` gives a word's number."""
    data, low = (text or "").encode("utf-8").translate(_FOLD), 0
    while low < len(data):
        high = data.find(b" ", low + PART_BYTES)
        words = data[low : high if high >= 0 else len(data)].split()
        yield np.fromiter(map(index, words), np.int32, len(words))
        low = high if high >= 0 else len(data)
    yield np.array([index(END)], np.int32)


def packed(x: np.ndarray | bytes) -> bytes:
    """Compressed; numbers by their first bytes, then their second ones, and so on, which compresses better."""
    data = x if isinstance(x, bytes) else np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return zstandard.compress(data, 1)


def numbers_of(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def words_of(data: bytes) -> list[bytes]:
    """A block's words; no word has a space."""
    return zstandard.decompress(data).split(b" ")


@K.released
def into_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, learned -> blocks: their tokens as places in the block's own list of words, with the words' counts in learned rows."""
    part, number, size = TaskContext.get().partitionId(), 0, 0
    words, docs, lengths, learned, held = defaultdict(count().__next__), [], [], [], []

    def block(kind: pa.DataType) -> pa.RecordBatch:
        ids, own = np.concatenate(held), np.repeat(np.array(learned, bool), lengths)
        n = np.bincount(ids[own], minlength=len(words))
        columns = [pa.array([(part << 32) + number]), pa.array([(part + number) % ROUNDS], pa.int32()), pa.array([docs], pa.list_(kind))]
        columns += [pa.array([packed(x)], pa.binary()) for x in (np.array(lengths, np.int64), np.array(learned, bool), ids, b" ".join(words), n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["block", "round", "doc_ids", "lengths", "learned", "ids", "words", "n"])

    for batch in batches:
        kind = batch.column("doc_id").type
        for doc, text, learn in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("learned").to_pylist()):
            found = list(numbers(text.as_py(), words.__getitem__))
            docs.append(doc)
            learned.append(learn)
            lengths.append(sum(map(len, found)))
            held += found
            size += lengths[-1]
            if size > BLOCK_TOKENS:
                yield block(kind)
                number, size = number + 1, 0
                words, docs, lengths, learned, held = defaultdict(count().__next__), [], [], [], []
    if docs:
        yield block(kind)


@K.released
def learned_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' columns words, n -> word, n of the words in learned rows."""
    for batch in batches:
        for words, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist()):
            n = numbers_of(n, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words_of(words), pa.binary()), pa.array(n)], ["word", "n"]).filter(pa.array(n > 0))


@dataclass(frozen=True)
class Classes:
    """The tokens that are classes of their own, and the slots of all classes; the class of every other token follows from its bytes."""

    head: dict[bytes, int]
    named: dict[bytes, int]  # the slot of each token that has one of its own, the head's too
    owner: np.ndarray  # the class of each slot, ascending; a tail's first slot is that of its other tokens

    @staticmethod
    def of_frequent(listed: list[bytes]) -> Classes:
        """``listed``: the most frequent tokens, in order."""
        head = {w: k for k, w in enumerate(listed[:HEAD])}
        kinds = np.concatenate((np.arange(len(head) + TAILS), _tails(listed[HEAD:]) + len(head))).astype(np.int32)
        order = np.argsort(kinds, kind="stable")
        slot = np.empty_like(order)
        slot[order] = np.arange(len(order))
        return Classes(head, dict(zip(listed, np.concatenate((slot[: len(head)], slot[len(head) + TAILS :])).tolist())), kinds[order])

    @property
    def size(self) -> int:
        return len(self.head) + TAILS

    @property
    def starts(self) -> np.ndarray:
        """The first slot of each class, and the number of slots."""
        return np.searchsorted(self.owner, np.arange(self.size + 1))

    def slots(self, listed: list[bytes]) -> np.ndarray:
        """The slot of each word."""
        own = np.fromiter((self.named.get(w, -1) for w in listed), np.int32, len(listed))
        return np.where(own >= 0, own, self.starts[len(self.head) + _tails(listed)]).astype(np.int32)

    def of(self, listed: list[bytes]) -> np.ndarray:
        """The class of each word."""
        return self.owner[self.slots(listed)]


def _tails(listed: list[bytes]) -> np.ndarray:
    """The tail of each word, by its last two bytes."""
    if not listed:
        return np.zeros(0, np.int32)
    data, ends = np.frombuffer(b"\0\0" + b"".join(listed), np.uint8), np.cumsum(np.fromiter(map(len, listed), np.int64, len(listed)))
    before = np.where(np.diff(ends, prepend=0) > 1, data[ends], 0).astype(np.uint64)
    return (K.mixed(data[ends + 1].astype(np.uint64) * np.uint64(256) + before + np.uint64(1)) % np.uint64(TAILS)).astype(np.int32)


def other_words(classes: Broadcast):
    """Blocks' columns block, words -> block, place, word of the words without a slot of their own."""

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = classes.value.named
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                words = words_of(words)
                other = pa.array([w not in named for w in words], pa.bool_())
                columns = [pa.array(np.full(len(words), block)), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "place", "word"]).filter(other)

    return run


@dataclass(frozen=True)
class Weights:
    """Vectors of context slots (the last one stands before a text), of positions, of predicted classes and of predicted slots (bias last)."""

    inputs: np.ndarray
    places: np.ndarray
    outputs: np.ndarray
    slots: np.ndarray

    @staticmethod
    def start(share: np.ndarray, inside: np.ndarray | None = None) -> Weights:
        """Small random vectors; the biases are the log frequencies of classes, and of slots in their class. Without slots classes are contexts."""
        draw, inner = np.random.default_rng(1), np.zeros(0) if inside is None else inside
        inputs, outputs, slots = (draw.normal(0, 0.05, (n, WIDTH)).astype(np.float32) for n in ((len(share) if inside is None else len(inside)) + 1, len(share), len(inner)))
        biased = lambda x, p: np.column_stack((x, np.log(p))).astype(np.float32)
        return Weights(inputs, np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32), biased(outputs, share), biased(slots, inner))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.inputs, self.places, self.outputs, self.slots

    def rows(self) -> np.ndarray:
        """All of them as whole multiples of 2^-20, each row as wide as an output."""
        wide = lambda x: np.column_stack((x, np.zeros(len(x)))) if x.shape[1] == WIDTH else x
        return np.rint(np.concatenate([wide(x) for x in self.parts()]).astype(np.float64) * _UNIT).astype(np.int64)

    def of_rows(self, rows: np.ndarray) -> Weights:
        parts = np.split((rows / _UNIT).astype(np.float32), np.cumsum([len(x) for x in self.parts()[:-1]]))
        return Weights(parts[0][:, :WIDTH].copy(), parts[1][:, :WIDTH].copy(), parts[2].copy(), parts[3].copy())

    def summed(self, contexts: np.ndarray) -> np.ndarray:
        """The context vectors, with a 1 for the bias; ``contexts``: a column of slots for each position."""
        out = np.ones((contexts.shape[1], WIDTH + 1), np.float32)
        out[:, :WIDTH] = self.inputs[contexts[0]] * self.places[0]
        for at, place in zip(contexts[1:], self.places[1:]):
            out[:, :WIDTH] += self.inputs[at] * place
        return out

    def log_probabilities(self, contexts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Natural logarithm of the normalised probability of each wanted class after its context."""
        out = np.empty(len(wanted))
        for low in range(0, len(wanted), PRODUCT):
            at = slice(low, low + PRODUCT)
            out[at] = _normalised(self.summed(contexts[:, at]) @ self.outputs.T, wanted[at])
        return out

    def log_inside(self, contexts: np.ndarray, wanted: np.ndarray, classes: Classes) -> np.ndarray:
        """Natural logarithm of the normalised probability of each wanted slot inside its class after its context."""
        out, starts = np.zeros(len(wanted)), classes.starts
        own = classes.owner[wanted]
        several = np.flatnonzero(np.diff(starts)[own] > 1)
        several = several[np.argsort(own[several].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(own[several], np.arange(classes.size + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            vectors = self.slots[starts[c] : starts[c + 1]].T
            for low in range(cuts[c], cuts[c + 1], PRODUCT):
                at = several[low : min(low + PRODUCT, cuts[c + 1])]
                out[at] = _normalised(self.summed(contexts[:, at]) @ vectors, wanted[at] - starts[c])
        return out


def _normalised(score: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of the wanted column of each row; ``score`` is overwritten."""
    if score.max() > _HIGH:
        score -= score.max(1, keepdims=True)
    own = score[np.arange(len(score)), wanted].astype(np.float64)
    np.exp(score, out=score)
    return own - np.log(score.sum(1, dtype=np.float64))


def contexts(classes: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """A row for each of the ``CONTEXT`` positions: the slot that stands so far before each token, ``start`` before a text."""
    place = np.arange(len(classes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((CONTEXT, len(classes)), start, np.int32)
    for k in range(CONTEXT):
        out[k, k + 1 :] = np.where(place[k + 1 :] > k, classes[: len(classes) - k - 1], start)
    return out


def _gathered(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, and the sums of the rows of ``x`` there."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # sorted by radix; there are fewer slots
    sorted_ = at[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return sorted_[first], np.add.reduceat(x[order], first, axis=0)


@dataclass(frozen=True)
class Inside:
    """Noise slots of classes. ``share``: of each slot in its class."""

    classes: Classes
    share: np.ndarray

    def noise(self, owners: np.ndarray, draw: np.random.Generator, upto: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """``SLOT_NOISE`` slots of each class, by their share; ``upto``: the class's number and the shares up to each of its slots."""
        found = np.searchsorted(upto, owners[:, None] + draw.random((len(owners), SLOT_NOISE)), side="right")
        return np.clip(found, starts[owners][:, None], starts[owners + 1][:, None] - 1)

    def upto(self) -> np.ndarray:
        starts, total = self.classes.starts, np.cumsum(self.share)
        below = np.concatenate(([0.0], total))[starts[:-1]]
        return np.minimum(total - below[self.classes.owner], 1.0) + self.classes.owner


def train(weights: Weights, before: np.ndarray, wanted: np.ndarray, share: np.ndarray, rate: float, seed: int, inside: Inside | None = None) -> Weights:
    """Noise-contrastive estimation over all tokens of a block, by adaptive gradient steps on batches in drawn order.

    ``wanted``: slots if ``inside`` tells them apart, else classes.
    """
    draw, steps = np.random.default_rng(seed), -(-len(wanted) // BATCH)
    now = Weights(*(x.copy() for x in weights.parts()))
    squares = [np.full_like(x, 0.1) for x in now.parts()]
    expected, upto = np.log(NOISE * share).astype(np.float32), np.cumsum(share)
    if inside:
        slots, wanted, starts, inner = wanted, inside.classes.owner[wanted], inside.classes.starts, inside.upto()
        several, told = (np.diff(starts) > 1)[wanted], np.log(SLOT_NOISE * inside.share).astype(np.float32)

    def step(x: np.ndarray, square: np.ndarray, at: np.ndarray | slice, by: np.ndarray) -> None:
        total = square[at] + by * by
        square[at] = total
        x[at] += rate * by / np.sqrt(total)

    for k in draw.permutation(steps):
        at = slice(k * BATCH, (k + 1) * BATCH)
        context, own = before[:, at], wanted[at]
        noise = np.minimum(np.searchsorted(upto, draw.random(NOISE) * upto[-1]), len(share) - 1).astype(np.int32)
        q, z, y = now.summed(context), now.outputs[noise], now.outputs[own]
        # how far each is from being told apart: data from noise, noise from data
        lift = 1 / (1 + np.exp((q * y).sum(1) - expected[own]))
        sink = -1 / (1 + np.exp(expected[noise] - q @ z.T))
        slope = (sink @ z + lift[:, None] * y)[:, :WIDTH]
        found, by = _gathered(np.concatenate((own, noise)), np.concatenate((lift[:, None] * q, sink.T @ q)))
        if inside and (some := np.flatnonzero(several[at])).size:
            right, wrong = slots[at][some], inside.noise(own[some], draw, inner, starts)
            q, z, y = q[some], now.slots[wrong], now.slots[right]
            lift = 1 / (1 + np.exp((q * y).sum(1) - told[right]))
            sink = -1 / (1 + np.exp(told[wrong] - np.einsum("nkw,nw->nk", z, q)))
            slope[some] += (np.einsum("nk,nkw->nw", sink, z) + lift[:, None] * y)[:, :WIDTH]
            step(now.slots, squares[3], *_gathered(np.concatenate((right, wrong.ravel())), np.concatenate((lift[:, None] * q, (sink[:, :, None] * q[:, None, :]).reshape(-1, WIDTH + 1)))))
        step(now.outputs, squares[2], found, by)
        found, by = _gathered(context.ravel(), (slope * now.places[:, None, :]).reshape(-1, WIDTH))
        by_place = np.stack([(slope * now.inputs[c]).sum(0) for c in context])
        step(now.inputs, squares[0], found, by)
        step(now.places, squares[1], slice(None), by_place)
    return now


def trained(model: Broadcast, rate: float):
    """Blocks -> place, tokens, columns: what each block has trained."""

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, share, weights = model.value
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, learned, ids = (numbers_of(batch.column(x)[k].as_py(), t) for x, t in (("lengths", np.int64), ("learned", bool), ("ids", np.int32)))
                own = inside.classes.slots(words_of(batch.column("words")[k].as_py()))[ids[np.repeat(learned, lengths)]]
                if len(own):
                    after = train(weights, contexts(own, lengths[learned], len(inside.share)), own, share, rate, batch.column("block")[k].as_py(), inside)
                    places = np.arange(len(after.rows()))
                    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.full(len(places), len(own))), *[pa.array(x) for x in after.rows().T]], ["place", "tokens", *_columns()])

    return run


def _columns() -> list[str]:
    return [f"w{k}" for k in range(WIDTH + 1)]


@dataclass(frozen=True)
class Scorer:
    """All that scoring needs beside the counts of the words of a block."""

    classes: Classes
    weights: Weights
    slot_counts: np.ndarray  # learned tokens of each slot
    slot_kinds: np.ndarray  # distinct ones
    tokens: int
    kinds: int

    def score(self, words: list[bytes], known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score, score of each text. ``known``: the learned count of each word without a slot of its own."""
        slot, tails = self.classes.slots(words), np.zeros(len(self.slot_counts), bool)
        tails[self.classes.starts[len(self.classes.head) : -1]] = True
        own = ~tails[slot]
        n = known.copy()
        n[own] = self.slot_counts[slot[own]]
        base = np.log10((n + ADDED) / (self.tokens + ADDED * (self.kinds + 1)))
        inside = np.where(own, 0.0, np.log10((n + ADDED) / (self.slot_counts + ADDED * (self.slot_kinds + 1))[slot]))
        found = slot[ids]
        before = contexts(found, lengths, len(tails))
        by_class = (self.weights.log_probabilities(before, self.classes.owner[found]) + self.weights.log_inside(before, found, self.classes)) / np.log(10)
        text = np.repeat(np.arange(len(lengths)), lengths)
        total = lambda x: np.bincount(text, x, len(lengths))
        return {"n_tokens": lengths, "n_known": total((n > 0)[ids]).astype(np.int64), "base_score": total(base[ids]), "score": total(inside[ids] + by_class)}


class LanguageModel:
    """The texts of ``docs`` in blocks, the counts of what ``learn`` (a condition on doc_id) holds for, and the model."""

    def __init__(self, docs: DataFrame, learn: Column):
        self.spark, self.kind = docs.sparkSession, docs.schema["doc_id"].dataType
        source = plain(docs, "doc_id", "text").withColumn("learned", F.coalesce(learn, F.lit(False)))
        schema = T.StructType.fromDDL(_BLOCK.format(id=self.kind.simpleString()))
        path = new_path(self.spark, "blocks")
        source.mapInArrow(into_blocks, schema).write.partitionBy("round").option("compression", "zstd").parquet(path)
        self.blocks, again = (self.spark.read.schema(schema).parquet(path) for _ in range(2))
        self.texts = again.select("block", "doc_ids", "lengths", "ids", "words")
        words = self.blocks.select("words", "n").mapInArrow(learned_words, "word binary, n long")
        self.counts = stored(words.groupBy("word").agg(F.sum("n").alias("n")), "counts")
        self.tokens, self.kinds = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        frequent = self.counts.orderBy(F.desc("n"), "word").limit(HEAD + NAMED).collect()
        self.classes = Classes.of_frequent([bytes(r["word"]) for r in frequent])
        self.slot_counts, self.slot_kinds = self._slot_sizes()
        self.class_counts, self.class_kinds = (np.add.reduceat(x, self.classes.starts[:-1]) for x in (self.slot_counts, self.slot_kinds))

    def _slot_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        classes = self.classes

        @K.released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, kinds = np.zeros(len(classes.owner), np.int64), np.zeros(len(classes.owner), np.int64)
            for batch in batches:
                at = classes.slots(batch.column("word").to_pylist())
                np.add.at(n, at, batch.column("n").to_numpy())
                kinds += np.bincount(at, minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(kinds))), pa.array(n), pa.array(kinds)], ["slot", "n", "kinds"])

        rows = self.counts.mapInArrow(run, "slot long, n long, kinds long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
        n, kinds = np.zeros(len(classes.owner), np.int64), np.zeros(len(classes.owner), np.int64)
        n[rows["slot"].to_numpy()], kinds[rows["slot"].to_numpy()] = rows["n"].to_numpy(), rows["kinds"].to_numpy()
        return n, kinds

    def trained(self) -> Weights:
        """The model after all rounds."""
        share = (self.class_counts + 0.5) / (self.tokens + 0.5 * self.classes.size)
        inside = (self.slot_counts + 0.5) / (self.class_counts + 0.5 * np.diff(self.classes.starts))[self.classes.owner]
        weights = Weights.start(share, inside)
        wide = ", ".join(f"{x} long" for x in _columns())
        for k in range(ROUNDS):
            held = self.spark.sparkContext.broadcast((Inside(self.classes, inside), share, weights))
            rows = self.blocks.where(F.col("round") == k).mapInArrow(trained(held, RATE / (1 + k) ** 0.5), f"place long, tokens long, {wide}")
            weighted = [F.sum(F.col(x).cast("decimal(18,0)") * F.col("tokens").cast("decimal(18,0)")).cast("double").alias(x) for x in _columns()]
            got = rows.groupBy("place").agg(F.sum("tokens").alias("tokens"), *weighted).orderBy("place").toArrow()
            if got.num_rows:
                weights = weights.of_rows(np.column_stack([got[x].to_numpy() for x in _columns()]) / got["tokens"].to_numpy()[:, None])
            held.destroy()
        return weights

    def scores(self) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score of every row."""
        held = self.spark.sparkContext.broadcast(Scorer(self.classes, self.trained(), self.slot_counts, self.slot_kinds, self.tokens, self.kinds))
        words = self.blocks.select("block", "words").mapInArrow(other_words(self.spark.sparkContext.broadcast(self.classes)), "block long, place int, word binary")
        known = join_checked(words, self.counts, "word").select("block", "place", "n")

        def judge(block: pa.Table, own: pa.Table) -> pa.Table:
            lengths, ids = (numbers_of(block.column(x)[0].as_py(), t) for x, t in (("lengths", np.int64), ("ids", np.int32)))
            words = words_of(block.column("words")[0].as_py())
            n = np.zeros(len(words), np.int64)
            n[own.column("place").to_numpy()] = own.column("n").to_numpy()
            found = held.value.score(words, n, lengths, ids)
            return pa.table({"doc_id": K.strings(block.column("doc_ids"))[0].values} | {k: pa.array(v) for k, v in found.items()})

        kinds = T.StructType([T.StructField("doc_id", self.kind), *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double")])
        return self.texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(judge, kinds)


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(10, 0)
    model = LanguageModel(table(spark, sf_dir, "documents"), F.col("doc_id").isNotNull() & ~held)
    found = model.scores()
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
