"""Collocations: word sequences that occur more often together than apart, by language.

All 1..``MAX_WORDS``-grams become rows (lang, phrase, n) that are hash-aggregated; each candidate's count is joined to the
counts of its prefixes and suffixes, scored in decimals, anti-joined with its one-word extensions, and ranked in a window.

A candidate occurs ``MIN_COUNT`` times, and so do all parts of it. So words are counted first, exactly. Then word pairs are
counted by hash, so that a pair's number is never too low; longer phrases become rows only where all their pairs have reached
``MIN_COUNT``. What has reached it is known to tasks by a filter of at most ``FILTER_BITS`` bits. A filter takes in all that
qualifies, and what else it takes in is counted exactly and then falls out: with more frequent pairs than bits more rows
are counted, down to those of the plain explosion, and results stay the same. Tasks count their own rows before they
hand them on. A longer candidate that has at least ``COVERED`` percent of a candidate's count implies a one-word extension
that has (it occurs at least as often), so extensions by one word suffice.

Defined cases: a null text is empty, a null lang is ``und`` (with the rows that say so). A very long text is read in
parts that end between words, and counted as a whole. Ties of score and count go to the phrase that is first in UTF-8 byte
order. Repeated rows count each. An empty table, or one without a candidate, gives an empty result. Other columns are
ignored. Counts are longs and all products decimals, so nothing overflows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import textkit as K
from lodestrata.llm.storage import drop_path, join_checked, plain, stored, table

MAX_WORDS = 4
MIN_COUNT = 30
#: A candidate goes if a longer one has so many percent of its count.
COVERED = 80
TOP = 2000
SCORE = 2_000_000
#: Largest size of a filter: 16 MB. A smaller one has about 16 bits for each entry.
FILTER_BITS = 1 << 27
#: Words of the texts that a task works on at once, and distinct words that it counts before it hands them on.
BLOCK_WORDS, HELD_WORDS = 1_500_000, 500_000
#: Bytes that are split into words at once.
PART_BYTES = 1_000_000
#: Parts of a language's candidates that are ranked for themselves first.
SALTS = 64

_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK, _NOTHING = 0, 1  # numbers of the end of a piece, and of what stands between two spaces
_LEFT = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Numbers for the words of each language, in the order they are met."""

    def __init__(self):
        self.next = count(2).__next__
        self.of: dict[str, defaultdict[bytes, int]] = {}
        self.size = 2

    def numbers(self, lang: str, text: str) -> Iterator[np.ndarray]:
        """The numbers of a text's words, with _BREAK between pieces."""
        if lang not in self.of:
            self.of[lang] = defaultdict(self.next, {b"\n": _BREAK, b"": _NOTHING})
        index = self.of[lang].__getitem__
        data, low = text.encode("utf-8").translate(_FOLD).replace(b"\n", b" \n "), 0
        while low < len(data):
            high = data.find(b" ", low + PART_BYTES)
            words = data[low : high if high >= 0 else len(data)].split(b" ")
            found = np.fromiter(map(index, words), np.int32, len(words))
            yield found[found != _NOTHING]
            low = high + 1 if high >= 0 else len(data)

    def listed(self) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """By number: language, word, and a 64-bit hash of both."""
        langs, words, hashes, order = [None, None], [b"", b""], [0, 0], [_BREAK, _NOTHING]
        for lang, found in self.of.items():
            own = [w for w in found if w not in (b"\n", b"")]
            seed = xxhash.xxh64_intdigest(lang.encode("utf-8"))
            langs += [lang] * len(own)
            words += own
            hashes += [xxhash.xxh64_intdigest(w, seed) for w in own]
            order += [found[w] for w in own]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = pa.array(place)
        return pa.array(langs, pa.string()).take(at), pa.array(words, pa.binary()).cast(pa.string()).take(at), np.array(hashes, np.uint64)[place]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray]]:
    """Columns lang, text -> words of a block of texts, and their numbers in order, with _BREAK between pieces and texts."""
    words, held, size = Words(), [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            if not text:
                continue
            for found in words.numbers(lang, text):
                held.append(found)
                size += len(found)
            held.append(np.array([_BREAK], np.int32))
            if size > BLOCK_WORDS:
                yield words, np.concatenate(held)
                words, held, size = Words(), [], 0
    if held:
        yield words, np.concatenate(held)


@K.released
def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns lang, text -> lang, phrase, n: a task's counts of single words."""
    words, counts = Words(), np.zeros(0, np.int64)

    def emit() -> pa.RecordBatch:
        langs, texts, _ = words.listed()
        n = np.zeros(len(texts), np.int64)
        n[: len(counts)] = counts[: len(n)]
        at = pa.array(np.flatnonzero(n[2:]) + 2)
        return pa.RecordBatch.from_arrays([langs.take(at), texts.take(at), pa.array(n).take(at)], ["lang", "phrase", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for found in words.numbers(lang, text.as_py() or ""):
                fresh = np.bincount(found, minlength=len(counts))
                fresh[: len(counts)] += counts
                counts = fresh
            if len(counts) > HELD_WORDS:
                yield emit()
                words, counts = Words(), np.zeros(0, np.int64)
    yield emit()


def pair_keys(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return K.mixed(hashes[first] * _LEFT + hashes[second])


class Filter:
    """A set of 64-bit hashes by their leading bits: it has all that were put in, and some others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (64 * len(bits)).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return ((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)

    @staticmethod
    def of(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> Filter:
        """Of all ``rows``; a task's part of it has at most FILTER_BITS bits too."""
        size = min(FILTER_BITS, 1 << max(6, (16 * rows.count() - 1).bit_length())) // 64
        shift = np.uint64(64 - (64 * size).bit_length() + 1)

        @K.released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size, np.uint64)
            for batch in batches:
                at = hashes(batch) >> shift
                np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            met = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(bits[met].view(np.int64))], ["place", "bits"])

        got = rows.mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(size, np.uint64)
        bits[got["place"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        return Filter(bits)


def _word_hashes(batch: pa.RecordBatch) -> np.ndarray:
    seeds: dict[str, int] = {}
    out = []
    for lang, word in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
        if lang not in seeds:
            seeds[lang] = xxhash.xxh64_intdigest(lang.encode("utf-8"))
        out.append(xxhash.xxh64_intdigest(word.encode("utf-8"), seeds[lang]))
    return np.array(out, np.uint64)


def count_pairs(frequent: Broadcast):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns lang, text -> key, n: pairs of words that are frequent, by hash."""
        for words, ids in blocks(batches):
            hashes = words.listed()[2]
            good = frequent.value.has(hashes)
            good[:2] = False
            at = np.flatnonzero(good[ids[:-1]] & good[ids[1:]])
            codes, n = np.unique(ids[at].astype(np.int64) * len(hashes) + ids[at + 1], return_counts=True)
            keys = pair_keys(hashes, codes // len(hashes), codes % len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int32())], ["key", "n"])

    return run


def count_phrases(frequent: Broadcast, pairs: Broadcast, most: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns lang, text -> lang, phrase, n: phrases of 2 to ``most`` words all of whose pairs may be frequent."""
        for words, ids in blocks(batches):
            langs, texts, hashes = words.listed()
            good = frequent.value.has(hashes)
            good[:2] = False
            size = len(hashes)
            # linked: whether the pair that starts at a place may be frequent; number: of the phrase that starts there
            linked, number, strings = np.zeros(len(ids) + most, bool), ids.astype(np.int64), texts
            start = np.flatnonzero(good[ids[:-1]] & good[ids[1:]])
            for length in range(2, most + 1):
                codes, inverse, n = np.unique(number[start] * size + ids[start + length - 1], return_inverse=True, return_counts=True)
                if length == 2:
                    keep = pairs.value.has(pair_keys(hashes, codes // size, codes % size))
                    start, inverse = start[keep[inverse]], (np.cumsum(keep) - 1)[inverse[keep[inverse]]]
                    codes, n = codes[keep], n[keep]
                    linked[start] = True
                if not len(codes):
                    break
                strings = pc.binary_join_element_wise(strings.take(pa.array(codes // size)), texts.take(pa.array(codes % size)), " ")
                first = np.zeros(len(codes), np.int64)
                first[inverse] = ids[start]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(first)), strings, pa.array(n, pa.int64())], ["lang", "phrase", "n"])
                number = np.zeros(len(ids), np.int64)
                number[start] = inverse
                start = start[linked[start + length - 1]]  # the pair of the last word and the next

    return run


def phrase_counts(docs: DataFrame, most: int = MAX_WORDS, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f, size of all phrases of 1 to ``most`` words that occur ``least`` times; and lang, n: all words."""
    spark = docs.sparkSession
    source = plain(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counted = "lang string, phrase string, n long"
    total = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    every = stored(total(source.mapInArrow(count_words, counted)), "words")
    sizes = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    words = stored(every.where(F.col("f") >= least), "frequent", replaces=every)
    frequent = spark.sparkContext.broadcast(Filter.of(words, _word_hashes))
    keys = source.mapInArrow(count_pairs(frequent), "key long, n int").groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= least).select("key")
    keys = stored(keys, "pairs")
    pairs = spark.sparkContext.broadcast(Filter.of(keys, lambda batch: batch.column("key").to_numpy().view(np.uint64)))
    drop_path(spark, keys._stored_at)
    longer = total(source.mapInArrow(count_phrases(frequent, pairs, most), counted)).where(F.col("f") >= least)
    size = F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1
    return stored(words.unionAll(longer).withColumn("size", size), "phrases", replaces=words), sizes


def _decimal(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates: each cut where its score is lowest, ties at the first cut."""
    candidates = phrases.where("size > 1")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part = lambda low, n: F.array_join(F.slice("ws", low, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.size("ws") - F.col("k")).alias("rest"))
    of = lambda name, value: phrases.where(F.col("size") < F.lit(MAX_WORDS)).select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    joined = join_checked(join_checked(cuts, of("first", "l"), ["lang", "first"]), of("rest", "r"), ["lang", "rest"])
    score = joined.select("*", _decimal("a").alias("da"), (_decimal("l") + _decimal("r")).alias("parts")).withColumn("score", F.expr(f"(cast({SCORE} as decimal(7,0)) * da) div parts"))
    return score.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def uncovered(found: DataFrame, phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """The rows of ``found`` (lang, phrase, a) without a one-word extension of at least ``covered`` percent of their count."""
    words = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " "))
    longer = phrases.where("size > 2").select("lang", F.col("f"), F.explode(inner).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest")).select(F.col("lang").alias("l_lang"), F.col("phrase").alias("l_phrase"), "longest")
    longer = stored(longer, "extensions")
    same = (F.col("lang") == F.col("l_lang")) & (F.col("phrase") == F.col("l_phrase"))
    return join_checked(found, longer, same & (F.lit(100).cast("decimal(3,0)") * _decimal("longest") >= F.lit(covered).cast("decimal(3,0)") * _decimal("a")), "left_anti")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` candidates of each language."""
    phrases, sizes = phrase_counts(docs)
    found = stored(uncovered(scored(phrases), phrases), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # each part of a language hands on its first rows only, so no task sorts all candidates of one
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return join_checked(ranked, sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, size, array_to_string(ws[k:k + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM w, unnest([1, 2, 3, 4]) AS s(size)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM g WHERE size > 1),
s AS (
  SELECT c.lang, c.phrase, c.size, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:c.size], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
r AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = s.lang AND g.size > s.size AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * g.f >= 80::HUGEINT * s.a))
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r JOIN t USING (lang) WHERE rank <= 2000
"""
