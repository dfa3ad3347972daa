"""Toxicity by class-conditional Kneser-Ney models over byte n-grams.

A toxic and an ordinary model of order ``ORDER`` are counted over all labelled training rows. Both discount
their own n-gram counts and back off to one shared model: interpolated Kneser-Ney continuation probabilities
of both classes' n-grams together, so an expression that is rare in either class is smoothed alike in both.
What scoring needs of an n-gram is one number, ``log p_toxic - log p_ordinary``. These numbers are kept by the
n-gram itself (:class:`Exact`), so no two share one. Their table grows with the distinct n-grams of the labelled
training rows: up to ``HELD_GRAMS_MAX`` n-grams it is broadcast, 12 bytes for each n-gram and context; beyond that it
stays a table and is joined to the distinct n-grams of blocks of texts, which gives the same numbers.

A text's features are its mean log-likelihood difference per byte and the largest mean over any ``SPAN`` bytes;
a logistic function of them gives the score. It is fitted on a sample of at most ``FIT_ROWS`` training rows, and at
most about a fifth of them, stratified by label, under the counts of all other rows; then the sample's own
n-grams are added, so that scores rest on all labelled training rows.

Defined cases: letters A-Z are lower-cased; a null or empty text has neutral features. A null ``doc_id`` is
never learned from. Without rows of both labels the score is the share of label 1 (0 if there is none).
A very long text is a slice of its own, whose n-grams are counted and looked up in parts. Repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import textkit as K
from lodestrata.llm.language import held_out
from lodestrata.llm.storage import drop_path, join_checked, plain, stored, table

ORDER = 5
DISCOUNT = 0.75
#: Sizes of tables that are given as arrays by slot.
GRAM_SLOTS = 1 << 21
CONTEXT_SLOTS = 1 << 19
SPAN = 24  # 16 + 8: see span_means
FIT_ROWS = 20_000
#: N-grams a task gathers before it hands them on.
HELD_GRAMS = 2_000_000
#: N-grams whose numbers are broadcast, with those of their contexts: about 100 MB at most.
HELD_GRAMS_MAX = 4_000_000
#: Text bytes of a block that is given its own numbers, about; a longer text is a block of its own.
BLOCK_BYTES = 16_000_000

_SEPARATOR = b" " * SPAN


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in lower case, all white space as spaces; with the starts and ends of the texts."""
    data, starts, ends = K.joined(texts, _SEPARATOR)
    return np.where(K.NOT_SPACE[data], K.LOWER[data], np.uint8(0x20)), starts, ends


def grams(data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """In parts of ``SLICE_BYTES``: first and last place, and the n-grams that end at the bytes between, as 40-bit numbers."""
    for first in range(0, len(data), K.SLICE_BYTES):
        last = min(first + K.SLICE_BYTES, len(data))
        part = data[max(0, first - ORDER + 1) : last].astype(np.uint64)
        key = part.copy()
        for k in range(1, ORDER):
            key[k:] |= part[:-k] << np.uint64(8 * k)
        yield first, last, key[len(key) - (last - first) :]


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` places is a byte of a text."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    np.subtract.at(edge, ends, 1)
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


@K.released
def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, toxic -> gram, n_toxic, n_ordinary: partial counts of a task."""
    keys, toxic, ordinary = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(toxic), pa.array(ordinary)], ["gram", "n_toxic", "n_ordinary"])

    for batch in batches:
        labels = np.array(batch.column("toxic").to_pylist(), np.int64)
        for low, high in K.slices(batch.column("text")):
            data, starts, ends = folded(batch.column("text").slice(low, high - low))
            own = _inside(len(data), starts, ends)
            label = np.zeros(len(data), bool)
            label[own] = np.repeat(labels[low:high] > 0, ends - starts)
            for first, last, key in grams(data):
                at = own[first:last]
                fresh, place = np.unique(key[at], return_inverse=True)
                ones = np.bincount(place, weights=label[first:last][at], minlength=len(fresh)).astype(np.int64)
                rest = np.bincount(place, minlength=len(fresh)) - ones
                both, place = np.unique(np.concatenate((keys, fresh)), return_inverse=True)
                toxic = np.bincount(place, weights=np.concatenate((toxic, ones)), minlength=len(both)).astype(np.int64)
                ordinary = np.bincount(place, weights=np.concatenate((ordinary, rest)), minlength=len(both)).astype(np.int64)
                keys = both
            if len(keys) > HELD_GRAMS:
                yield emit()
                keys, toxic, ordinary = keys[:0], toxic[:0], ordinary[:0]
    yield emit()


def shared_model(counts: DataFrame) -> DataFrame:
    """gram (of ORDER - 1 bytes), p: interpolated Kneser-Ney continuation probability of its last byte.

    ``counts``: the distinct n-grams of both classes together.
    """
    level = counts.groupBy((F.col("gram") % (1 << 8 * (ORDER - 1))).alias("gram")).agg(F.count("*").alias("n"))
    levels = [level]  # of ORDER - 1 bytes, ORDER - 2, .. 1; n: distinct bytes seen before it
    for size in range(ORDER - 2, 0, -1):
        level = level.groupBy((F.col("gram") % (1 << 8 * size)).alias("gram")).agg(F.count("*").alias("n"))
        levels.append(level)
    lowest = levels[-1]
    total = lowest.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    model = lowest.crossJoin(F.broadcast(total)).select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") / 256) / F.col("total")).alias("p"))
    for size, level in zip(range(2, ORDER), reversed(levels[:-1])):
        seen = level.withColumn("context", F.shiftright("gram", 8)).withColumn("suffix", F.col("gram") % (1 << 8 * (size - 1)))
        contexts = seen.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        lower = model.select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
        model = seen.join(contexts, "context").join(lower, "suffix").select("gram", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p_lower")) / F.col("total")).alias("p"))
    return model


def _slots(keys: np.ndarray, slots: int) -> np.ndarray:
    return (K.mixed(keys) % np.uint64(slots)).astype(np.int64)


class Exact:
    """Numbers by n-gram: sorted by a bijective hash of it, and found from where the hash's leading bits start."""

    def __init__(self, keys: np.ndarray, d: np.ndarray):
        hashes = K.mixed(keys)
        order = np.argsort(hashes)
        self.hashes, self.d = hashes[order], d[order]

    def _starts(self) -> np.ndarray:
        """Made where it is used, so that it is not broadcast."""
        if "starts" not in self.__dict__:
            self.bits = np.uint64(64 - max(1, len(self.d).bit_length() + 1))
            counts = np.bincount((self.hashes >> self.bits).astype(np.int64), minlength=1 << int(np.uint64(64) - self.bits))
            self.starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int32 if len(self.d) < 1 << 31 else np.int64)
        return self.starts

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "d": self.d}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; NaN where there is none."""
        out, starts, hashes = np.full(len(keys), np.nan, np.float32), self._starts(), K.mixed(keys)
        slot = (hashes >> self.bits).astype(np.int64)
        place, end = starts[slot], starts[slot + 1]
        left = np.flatnonzero(place < end)
        while len(left):
            here = place[left]
            equal = self.hashes[here] == hashes[left]
            out[left[equal]] = self.d[here[equal]]
            left = left[~equal]
            place[left] += 1
            left = left[place[left] < end[left]]
        return out


def _looked_up(held: Exact | np.ndarray, keys: np.ndarray, slots: int) -> np.ndarray:
    """The numbers of ``keys`` in an exact table, or in an array by slot."""
    return held.of(keys) if isinstance(held, Exact) else held[_slots(keys, slots)]


def _exact(rows: DataFrame) -> Exact:
    """Of rows (gram, d)."""
    return _exact_of(rows.select("gram", F.col("d").cast("float").alias("d")).toArrow())


def _exact_of(got: pa.Table) -> Exact:
    return Exact(got.column("gram").to_numpy().astype(np.uint64), got.column("d").to_numpy().astype(np.float32))


def _summed(counts: DataFrame) -> DataFrame:
    return stored(counts.groupBy("gram").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_ordinary").alias("n_ordinary")), "grams")


def gram_counts(rows: DataFrame) -> DataFrame:
    """gram, n_toxic, n_ordinary of rows (text, toxic)."""
    return _summed(rows.mapInArrow(count_grams, "gram long, n_toxic long, n_ordinary long"))


def differences(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of n-gram counts, as (gram, d): the log-likelihood difference of seen n-grams, and after seen contexts."""
    keyed = counts.withColumn("context", F.shiftright("gram", 8)).withColumn("suffix", F.col("gram") % (1 << 8 * (ORDER - 1)))
    contexts = counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(*[f(x).alias(a) for x, t in (("n_toxic", "t"), ("n_ordinary", "o")) for f, a in ((F.sum, f"sum_{t}"), (lambda c: F.count_if(F.col(c) > 0), f"kinds_{t}"))])

    def backoff(t: str) -> Column:
        return F.when(F.col(f"sum_{t}") > 0, DISCOUNT * F.col(f"kinds_{t}") / F.col(f"sum_{t}")).otherwise(1.0)

    def p(n: str, t: str) -> Column:
        own = F.when(F.col(f"sum_{t}") > 0, F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / F.col(f"sum_{t}")).otherwise(0.0)
        return own + backoff(t) * F.col("p")

    shared = shared_model(counts.select("gram")).withColumnRenamed("gram", "suffix")
    seen = keyed.join(contexts, "context").join(shared, "suffix").select("gram", (F.log(p("n_toxic", "t")) - F.log(p("n_ordinary", "o"))).alias("d"))
    after = contexts.select(F.col("context").alias("gram"), (F.log(backoff("t")) - F.log(backoff("o"))).alias("d"))
    return tuple(x.withColumn("d", F.col("d").cast("float")) for x in (seen, after))


def difference_tables(counts: DataFrame) -> tuple[Exact, Exact]:
    """The same, gathered."""
    seen, after = differences(counts)
    return _exact(seen), _exact(after)


def span_means(d: np.ndarray) -> np.ndarray:
    """Mean of each SPAN values in a row; each sum is formed in the same way wherever it stands."""
    two = d[:-1] + d[1:]
    four = two[:-2] + two[2:]
    eight = four[:-4] + four[4:]
    sixteen = eight[:-8] + eight[8:]
    return (sixteen[: len(d) - SPAN + 1] + eight[16:]) / SPAN


def features(texts: pa.Array, by_gram: Exact | np.ndarray, by_context: Exact | np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference per byte, and the largest mean over SPAN bytes, of each text."""
    out = []
    for low, high in K.slices(texts):
        data, starts, ends = folded(texts.slice(low, high - low))
        d = np.empty(len(data), np.float32)
        for first, last, key in grams(data):
            part = _looked_up(by_gram, key, GRAM_SLOTS)
            unseen = np.flatnonzero(np.isnan(part))
            part[unseen] = np.nan_to_num(_looked_up(by_context, key[unseen] >> np.uint64(8), CONTEXT_SLOTS))
            d[first:last] = part
        d[~_inside(len(d), starts, ends)] = 0
        mean = K.sums_between(d, starts, ends) / np.maximum(ends - starts, 1)
        # the span that ends at byte k stands at k - SPAN + 1; separators are as long as a span
        largest, full = np.zeros(high - low), ends > starts
        if full.any():
            bounds = np.stack((starts[full] - SPAN + 1, ends[full] - SPAN + 1), 1)
            largest[full] = np.maximum.reduceat(np.append(span_means(d), np.float32(-np.inf)), bounds.ravel())[::2]
        out.append(np.stack((mean, largest), 1))
    return np.concatenate(out) if out else np.zeros((0, 2))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) of a ridge-penalised logistic regression on standardised columns, by Newton's method."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack((np.ones(len(x)), (x - mean) / spread))
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6, *[1e-2] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate(([w[0] - (w[1:] * mean / spread).sum()], w[1:] / spread))


def _with_features(rows: pa.RecordBatch | pa.Table, names: list[str], found: np.ndarray) -> list[pa.Array]:
    return [*[rows.column(x) for x in names], pa.array(found[:, 0]), pa.array(found[:, 1])]


def _features_by(held, names: list[str]):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _with_features(batch, names, features(batch.column("text"), *held.value))
            yield pa.RecordBatch.from_arrays(columns, [*names, "mean", "largest"])

    return run


def into_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``block``, a number that rows in a row share until their texts take BLOCK_BYTES. What it numbers is stored, so a task that runs again renames nothing."""
    block, used = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        numbers = []
        for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
            if used and used + n > BLOCK_BYTES:
                block, used = block + 1, 0
            used += n
            numbers.append(block)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], ["block", *batch.schema.names])


@K.released
def block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, text -> block, gram: the distinct n-grams of each slice of a block's texts."""
    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for first, last in zip(cuts, cuts[1:]):
            texts = batch.column("text").slice(first, last - first)
            for low, high in K.slices(texts):
                data, starts, ends = folded(texts.slice(low, high - low))
                own = _inside(len(data), starts, ends)
                for start, end, key in grams(data):
                    found = np.unique(key[own[start:end]]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), blocks[first])), pa.array(found)], ["block", "gram"])


def features_of(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The columns of ``rows`` beside ``text``, and the features ``mean``, ``largest`` of the text under n-gram ``counts``."""
    spark, kept = rows.sparkSession, [x for x in rows.schema if x.name != "text"]
    names = [x.name for x in kept]
    kinds = T.StructType([*kept, *T.StructType.fromDDL("mean double, largest double")])
    if counts.count() <= HELD_GRAMS_MAX:
        return rows.mapInArrow(_features_by(spark.sparkContext.broadcast(difference_tables(counts)), names), kinds)
    seen, after = differences(counts)
    blocks = stored(rows.mapInArrow(into_blocks, T.StructType([T.StructField("block", T.LongType()), *rows.schema])), "blocks")
    wanted = blocks.select("block", "text").mapInArrow(block_grams, "block long, gram long").distinct()
    numbers = wanted.join(seen, "gram", "left").withColumn("context", F.shiftright("gram", 8))
    backed = numbers.where("d is null").drop("d").join(after.withColumnRenamed("gram", "context"), "context", "left")
    numbers = stored(numbers.where("d is not null").unionByName(backed).select("block", "gram", F.coalesce("d", F.lit(0.0).cast("float")).alias("d")), "numbers")
    none = Exact(np.zeros(0, np.uint64), np.zeros(0, np.float32))

    def judge(texts: pa.Table, own: pa.Table) -> pa.Table:
        found = features(K.strings(texts.column("text")), _exact_of(own), none)
        return pa.Table.from_arrays(_with_features(texts, names, found), [*names, "mean", "largest"])

    return blocks.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(judge, kinds)


def fit_sample(marks: DataFrame) -> DataFrame:
    """Of ``marks`` (doc_id, toxic), the same share of each label, at least one row: a fifth, or less to be FIT_ROWS at most."""
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = min(0.2, (FIT_ROWS - len(sizes)) / max(1, sum(sizes.values())))
    out = marks.limit(0)
    for label, n in sorted(sizes.items()):
        out = out.unionAll(marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(ceil(n * share)))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, score, predicted of each row of ``docs``.

    ``labels``: doc_id, toxic (0 or 1; the larger where an id is repeated). ``learn``: condition on doc_id of the rows to learn from.
    """
    spark = docs.sparkSession
    marks = plain(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    source = plain(docs, "doc_id", "text")
    rows = join_checked(source.where(learn), marks, "doc_id")
    # choose ids first, so that only the chosen rows' texts move
    chosen = stored(fit_sample(marks), "chosen")
    sample = source.join(F.broadcast(chosen), "doc_id")
    others = gram_counts(rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").select("text", "toxic"))
    seen = features_of(sample.select("doc_id", "toxic", "text"), others)
    got = seen.groupBy("doc_id").agg(*[F.max(x).alias(x) for x in ("toxic", "mean", "largest")]).orderBy("doc_id").toPandas()
    y = got["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        weights = fit_logistic(got[["mean", "largest"]].to_numpy(), y)
    else:
        share = y.mean() if len(y) else 0.0
        weights = np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0])
    added = gram_counts(sample.select("text", "toxic"))
    counts = _summed(others.unionAll(added))
    found = features_of(source, counts)
    for used in (others, added, counts, chosen):
        drop_path(spark, used._stored_at)
    linear = F.lit(float(weights[0])) + F.col("mean") * float(weights[1]) + F.col("largest") * float(weights[2])
    found = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), linear)))))
    return found.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("mean").alias("mean_llr"), F.col("largest").alias("largest_llr"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(5, 0)
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", "mean_llr", "largest_llr")
