"""Quality rules: base counts and a hashed n-gram log-likelihood ratio for every document.

Two multinomials over hashed byte n-grams are counted, one over the trusted target (documents labelled of
good quality), one over the whole raw corpus. A document's score is the mean, over its n-grams, of
``log(p_target / p_raw)``; it is kept if the base rules pass and the score reaches a fixed threshold.

Defined cases: a null or empty text has no words, so it fails the base rules and scores 0. Ties and repeated
rows are judged alike. A null or unlabelled ``doc_id`` is never trusted. With no trusted document every
score is 0. A very long text is a slice of its own and is counted and scored in parts. An empty table gives an empty result. Other columns of the input are ignored, or passed on
unchanged by :func:`keep_quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import textkit as K
from lodestrata.llm.storage import BROADCAST_ROWS, plain, table

NGRAM = 4
BUCKETS = 1 << 16
#: Pseudo-counts given to the target, spread as the raw corpus is.
PRIOR = 50_000.0
#: Lowest mean log-likelihood ratio of a document that is kept.
MIN_SCORE = -0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_FOLD = np.arange(256).astype(np.uint8)
_FOLD[[9, 10, 11, 12, 13]] = 0x20

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def buckets_of(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that ends at each byte from the n-th on."""
    key = np.zeros(len(data) - NGRAM + 1, np.uint64)
    for k in range(NGRAM):
        key = (key << np.uint64(8)) | _FOLD[data[k : len(data) - NGRAM + 1 + k]].astype(np.uint64)
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


_PAD = b"\n" * NGRAM


@K.released
def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, trusted -> one row of counts for each bucket that a partition has met."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts, trusted = batch.column("text"), np.array(batch.column("trusted").to_pylist(), bool)
        for low, high in K.slices(texts):
            data, starts, ends = K.joined(texts.slice(low, high - low), _PAD)
            at = np.repeat(trusted[low:high], ends - starts)
            inside = np.ones(len(data), bool)
            for k in range(NGRAM):
                inside[starts - 1 - k] = False
            weight = np.zeros(len(data), np.int8)  # 1: a byte of a text, 2: of a trusted one
            weight[inside] = 1 + at
            for first in range(NGRAM, len(data), K.SLICE_BYTES):  # a very long text in parts
                last = min(first + K.SLICE_BYTES, len(data))
                bucket, kind = buckets_of(data[first - NGRAM + 1 : last]), weight[first:last]
                raw += np.bincount(bucket[kind > 0], minlength=BUCKETS)
                target += np.bincount(bucket[kind > 1], minlength=BUCKETS)
    met = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(raw[met]), pa.array(target[met])], ["bucket", "raw", "target"])


def ratio_table(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """``log(p_target / p_raw)`` of each bucket, from the whole corpus.

    ``trusted``: a table of ``doc_id``. The result has ``BUCKETS`` numbers whatever the corpus' size.
    """
    source, ids = plain(docs, "doc_id", "text"), plain(trusted, "doc_id").where("doc_id is not null").distinct()
    counted = "bucket int, raw long, target long"
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        flagged = source.join(F.broadcast(ids.withColumn("trusted", F.lit(True))), "doc_id", "left")
        counts = flagged.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")).mapInArrow(count_ngrams, counted)
    else:  # the raw corpus in a plain scan; only what is joined to a trusted id is counted again, for the target
        raw = source.select("text", F.lit(False).alias("trusted")).mapInArrow(count_ngrams, counted)
        target = source.join(ids, "doc_id").select("text", F.lit(True).alias("trusted")).mapInArrow(count_ngrams, counted)
        counts = raw.unionAll(target.select("bucket", F.lit(0).cast("long").alias("raw"), "target"))
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"].to_numpy()], target[rows["bucket"].to_numpy()] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    p_target = (target + PRIOR * p_raw) / (target.sum() + PRIOR)
    return np.log(p_target / p_raw)


def measure(texts: pa.Array, ratios: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the score of each text."""
    parts: dict[str, list[np.ndarray]] = {}
    for low, high in K.slices(texts):
        data, starts, ends = K.joined(texts.slice(low, high - low), _PAD)
        n = high - low
        doc_of = lambda at: np.searchsorted(ends, at, "right")
        word, (w0, w1) = K.NOT_SPACE[data], K.word_spans(data, K.NOT_SPACE)
        doc = doc_of(w0)
        found = {"n_words": np.bincount(doc, minlength=n)}
        found["word_chars"] = K.sums_between(word & ((data & 0xC0) != 0x80), starts, ends)
        found["n_symbols"] = K.sums_between(_SYMBOLS[data], starts, ends)

        breaks = np.flatnonzero(data == 0x0A)  # the separators are line ends too: they only add lines without words
        l0, l1 = breaks + 1, np.append(breaks[1:], len(data))
        filled = np.flatnonzero(K.sums_between(word, l0, l1))
        of_line = doc_of(l0[filled])
        _, kept = np.unique(K.mixed(K.span_hashes(data, l0[filled], l1[filled]) + K.mixed(of_line.astype(np.uint64))), return_index=True)
        found["n_dup_lines"] = np.bincount(of_line, minlength=n) - np.bincount(of_line[kept], minlength=n)

        found["n_repeat_words"] = np.zeros(n, np.int64)
        if len(w0) >= 3:
            h = K.span_hashes(data, w0, w1)
            same = np.flatnonzero(doc[:-2] == doc[2:])
            window = K.mixed(h[same] + K.mixed(h[same + 1] + K.mixed(h[same + 2] + doc[same].astype(np.uint64))))
            _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
            again = same[counts[inverse] > 1]
            hit = np.zeros(len(w0), bool)
            for k in range(3):
                hit[again + k] = True
            found["n_repeat_words"] = np.bincount(doc[hit], minlength=n)

        score = np.zeros(len(data), np.float32)
        for first in range(NGRAM, len(data), K.SLICE_BYTES):
            last = min(first + K.SLICE_BYTES, len(data))
            score[first:last] = ratios[buckets_of(data[first - NGRAM + 1 : last])]
        found["llr"] = K.sums_between(score, starts, ends) / np.maximum(ends - starts, 1)
        for k, v in found.items():
            parts.setdefault(k, []).append(v)
    out = {k: np.concatenate(v) for k, v in parts.items()}
    if not out:
        out = {k: np.zeros(0, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"llr": np.zeros(0)}
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["llr"] >= MIN_SCORE)
    return out


def quality_rules(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, base counts, ``llr`` and ``kept`` for each row of ``docs``; two scans, no shuffle of texts."""
    held = docs.sparkSession.sparkContext.broadcast(ratio_table(docs, trusted))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    source = plain(docs, "doc_id", "text")

    @K.released
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[x]) for x in names]], ["doc_id", *names])

    return source.mapInArrow(judge, T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(SCHEMA)]))


def keep_quality(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(ratio_table(docs, trusted))

    @K.released
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure(batch.column(batch.schema.get_field_index("text")), held.value)["kept"]))

    return docs.mapInArrow(judge, docs.schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that ``labels`` marks as of good quality."""
    return labels.where("quality = 1").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))
