"""Benchmark decontamination with a positional inverted index.

The training side is indexed once: every segment (about ``SEGMENT_BYTES`` of text) becomes one stored row with
its sorted term hashes and, for each term, the sorted list of positions of its tokens. Test phrases are then
matched in bounded blocks, one after the other, against all segments: for each phrase the posting lists are taken
from the rarest term on, each moved back by the term's offset in the phrase, and intersected. With ``slop`` 0 the
matches are exact phrases; with a larger one, all terms but the first may stand up to ``slop`` words from their place
(proximity matches). Proximity matches are reported (``n_near_items``); only exact ones make a document contaminated.

Defined cases: a null or empty text has no words, is indexed without postings and has no hits. Rows are told
apart by segment and row number, so repeated or null ``doc_id`` are judged row by row, and
:func:`drop_contaminated` drops rows by their text. A very long text is a segment of its own. An item without words
has no phrase. Repeated items each count under their own ``item_id``; a null ``item_id`` is left out of the
list of items (its windows still hit). Empty tables give empty results or no hits. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import textkit as K
from lodestrata.llm.storage import join_checked, new_path, plain, stored, table

WINDOW = 10
SEGMENT_BYTES = 4_000_000
#: Phrases matched in one pass over the index, about; 80 bytes each, so a block is some 16 MB.
BLOCK_PHRASES = 200_000
#: Words that a term may be from its place in a proximity match of :func:`decontaminate`.
NEAR = 2
#: Start positions that are intersected at a time (or those of one phrase's rarest term, if more).
CANDIDATES = 500_000
#: Free positions before each document: no phrase, moved by a slop of up to MAX_SLOP, crosses them.
GAP = 64
MAX_SLOP = GAP - WINDOW

_SHIFT = np.uint64(32)


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts (A-Z lower-cased), and each text's number of words."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, high in K.slices(texts):
        data, _, ends = K.joined(texts.slice(low, high - low), b" ")
        data = K.LOWER[data]
        w0, w1 = K.word_spans(data, K.LOWER_ALNUM)
        hashes.append(K.span_hashes(data, w0, w1))
        counts.append(np.bincount(np.searchsorted(ends, w0, "right"), minlength=high - low))
    return np.concatenate(hashes), np.concatenate(counts)


SEGMENT = "segment long, rows array<struct<doc_id: {id}, h: long, n_words: long>>, terms binary, lengths binary, steps binary"


@K.released
def build_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, h, part -> one index row per segment."""
    number = 0
    for batch in batches:
        for low, high in K.slices(batch.column("text"), SEGMENT_BYTES):
            part = batch.column("part")[low].as_py()
            hashes, n_words = term_hashes(batch.column("text").slice(low, high - low))
            position = np.arange(len(hashes)) + GAP * np.repeat(np.arange(high - low), n_words)
            order = np.argsort(hashes, kind="stable")
            terms, lengths = np.unique(hashes, return_counts=True)
            steps = np.diff(position[order], prepend=0).astype(np.int32)
            rows = pa.StructArray.from_arrays([*[batch.column(x).slice(low, high - low) for x in ("doc_id", "h")], pa.array(n_words, pa.int64())], ["doc_id", "h", "n_words"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), rows), *[pa.array([x.tobytes()], pa.binary()) for x in (terms, lengths.astype(np.int32), steps)]],
                ["segment", "rows", "terms", "lengths", "steps"],
            )
            number += 1


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Store the positional index of all texts at ``path``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = plain(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    schema = T.StructType.fromDDL(SEGMENT.format(id=kind))
    source.mapInArrow(build_segments, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def phrase_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns item_id, text -> each item's distinct windows, as the bytes of their term hashes."""
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            hashes = term_hashes(pa.array([text], pa.string()))[0]
            n = min(WINDOW, len(hashes))
            if n:
                found = {hashes[k : k + n].tobytes() for k in range(len(hashes) - n + 1)}
                name = None if item is None else str(item)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(sorted(found), pa.binary())], ["item_id", "phrase"])


def test_phrases(benchmark: DataFrame) -> DataFrame:
    return plain(benchmark, "item_id", "text").mapInArrow(phrase_windows, "item_id string, phrase binary")


class Block:
    """Test phrases of a block, by number of words: distinct phrases, the terms they use, the items of each."""

    def __init__(self, items: list[str | None], phrases: list[bytes]):
        by_size: dict[int, dict[bytes, list[str | None]]] = {}
        for item, phrase in zip(items, phrases):
            by_size.setdefault(len(phrase) // 8, {}).setdefault(phrase, []).append(item)
        self.groups = [(n, np.frombuffer(b"".join(x), np.uint64).reshape(-1, n), list(x.values())) for n, x in sorted(by_size.items())]


def intersect(keys: np.ndarray, lengths: np.ndarray, first: np.ndarray, phrase_terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and start positions (of their first term) that match.

    keys: ``term << 32 | position``, ascending; lengths, first: size and place of each term's posting list;
    phrase_terms: a row of term numbers for each phrase.
    """
    sizes = lengths[phrase_terms]
    order = np.argsort(sizes, axis=1, kind="stable")  # from the rarest term on
    rows = np.arange(len(phrase_terms))
    offset = order[:, 0]
    term = phrase_terms[rows, offset]
    n = lengths[term]
    phrase = np.repeat(rows, n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = (keys[np.repeat(first[term], n) + within] & np.uint64(0xFFFFFFFF)).astype(np.int64) - np.repeat(offset, n)
    if slop:  # where the first term stands, if the rarest one has moved
        moved = np.where(np.repeat(offset, n) > 0, slop, 0)
        steps = 2 * moved + 1
        phrase, start = np.repeat(phrase, steps), np.repeat(start - moved, steps) + np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    keep = start >= 0
    phrase, start = phrase[keep], start[keep]
    for rank in range(0 if slop else 1, phrase_terms.shape[1]):
        offset = order[phrase, rank]
        play = np.where(offset > 0, slop, 0)
        term = phrase_terms[phrase, offset].astype(np.uint64) << _SHIFT
        low = np.maximum(start + offset - play, 0).astype(np.uint64)
        found = keys[np.minimum(np.searchsorted(keys, term | low), len(keys) - 1)]
        keep = (found >= (term | low)) & (found <= (term | (start + offset + play).astype(np.uint64)))
        phrase, start = phrase[keep], start[keep]
    if slop and len(phrase):
        phrase, start = np.unique(np.stack((phrase, start)), axis=1)
    return phrase, start


def intersect_in_parts(keys: np.ndarray, lengths: np.ndarray, first: np.ndarray, phrase_terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`intersect`, over groups of phrases whose rarest terms have ``CANDIDATES`` postings together."""
    group = np.cumsum(lengths[phrase_terms].min(axis=1), dtype=np.int64) // CANDIDATES
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
    found = [(low, *intersect(keys, lengths, first, phrase_terms[low:high], slop)) for low, high in zip(cuts, cuts[1:])]
    return np.concatenate([low + phrase for low, phrase, _ in found]), np.concatenate([start for _, _, start in found])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and out[-1][1] >= low:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def match_segments(held: Broadcast, slops: tuple[int, ...]):
    """Index rows -> maximal matched word ranges of each document row and item, for each slop."""

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                terms, lengths, steps = (np.frombuffer(batch.column(x)[k].as_py(), t) for x, t in (("terms", np.uint64), ("lengths", np.int32), ("steps", np.int32)))
                if not len(terms):
                    continue
                positions = np.cumsum(steps, dtype=np.int64).astype(np.uint64)
                keys = (np.repeat(np.arange(len(terms), dtype=np.uint64), lengths) << _SHIFT) | positions
                first = np.cumsum(lengths) - lengths
                n_words = np.fromiter((x["n_words"] for x in batch.column("rows")[k].as_py()), np.int64)
                base = np.cumsum(n_words) - n_words + GAP * np.arange(len(n_words))
                for slop in slops:
                    out: dict[tuple[int, str | None, int], list[tuple[int, int]]] = {}  # starts ascend for one phrase length only
                    for n, phrases, items in held.value.groups:
                        at = np.minimum(np.searchsorted(terms, phrases), len(terms) - 1)
                        known = np.flatnonzero((terms[at] == phrases).all(axis=1))
                        if not len(known):
                            continue
                        phrase, start = intersect_in_parts(keys, lengths, first, at[known], slop)
                        row = np.searchsorted(base, start, "right") - 1
                        for p, r, s in sorted(zip(known[phrase].tolist(), row.tolist(), (start - base[row]).tolist()), key=lambda x: x[2]):
                            for item in items[p]:
                                ranges = out.setdefault((r, item, n), [])
                                s0, s1 = max(0, s - slop * (n > 1)), s + n + slop * (n > 1)
                                if ranges and ranges[-1][1] >= s0:
                                    ranges[-1] = (ranges[-1][0], max(s1, ranges[-1][1]))
                                else:
                                    ranges.append((s0, s1))
                    joint: dict[tuple[int, str | None], list[tuple[int, int]]] = {}
                    for (r, item, _), ranges in out.items():
                        joint.setdefault((r, item), []).extend(ranges)
                    found = [(r, item, *x) for (r, item), ranges in joint.items() for x in merged(ranges)]
                    if found:
                        r, item, s0, s1 = zip(*found)
                        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                        columns = ([batch.column("segment")[k].as_py()] * len(r), [slop] * len(r), r, item, s0, s1)
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["segment", "slop", "row", "item_id", "start", "end"])

    return run


MATCHES = "segment long, slop int, row long, item_id string, start long, end long"


def search(index: DataFrame, phrases: DataFrame, *slops: int) -> DataFrame:
    """Matches of all ``phrases`` (item_id, phrase) in ``index`` for each slop (0 if none is given): segment, slop, row, item_id, start, end (word range).

    The phrases are dealt to blocks of about ``BLOCK_PHRASES``. One block at a time is broadcast, passes over all
    segments, and is dropped again; its matches are stored.
    """
    slops = slops or (0,)
    if max(slops) > MAX_SLOP:
        raise ValueError(f"slop is {MAX_SLOP} at most")
    spark, path = index.sparkSession, new_path(index.sparkSession, "matches")
    phrases = stored(phrases, "phrases")
    blocks = -(-phrases.count() // BLOCK_PHRASES)
    dealt = phrases.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(max(1, blocks))))
    spark.createDataFrame([], MATCHES).write.parquet(path)
    for k in range(blocks):
        rows = dealt.where(F.col("block") == k).select("item_id", "phrase").toArrow()
        held = spark.sparkContext.broadcast(Block(rows["item_id"].to_pylist(), rows["phrase"].to_pylist()))
        index.mapInArrow(match_segments(held, slops), MATCHES).write.mode("append").option("compression", "zstd").parquet(path)
        held.destroy()
    return spark.read.schema(MATCHES).parquet(path)


def _matched(docs: DataFrame, benchmark: DataFrame, *slops: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the index of ``docs`` (segment, row, doc_id, h, n_words), and the matches in them."""
    index = build_index(docs, new_path(docs.sparkSession, "postings"))
    rows = index.select("segment", F.posexplode("rows").alias("row", "doc")).select("segment", F.col("row").cast("long").alias("row"), "doc.doc_id", "doc.h", "doc.n_words")
    return rows, search(index, test_phrases(benchmark), *slops)


def _digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``; and of proximity matches (exact ones are also near) n_near_items, near_items_sha256."""
    rows, matches = _matched(docs, benchmark, 0, NEAR)
    # words of the union of each row's ranges: what every range adds beyond all before it
    before = Window.partitionBy("segment", "row").orderBy("start", "end", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("end").over(before), F.lit(0))
    exact = matches.where("slop = 0").withColumn("added", F.greatest(F.lit(0), F.col("end") - F.greatest("start", seen)))
    near = matches.where("slop > 0").withColumn("added", F.lit(0).cast("long"))
    hits = (
        exact.unionAll(near)
        .groupBy("segment", "row")
        .agg(F.sum("added").alias("n_hit"), *[F.array_sort(F.collect_set(F.when(F.col("slop") == k, F.col("item_id")))).alias(x) for k, x in ((0, "items"), (NEAR, "near_items"))])
    )
    items, near_items = (F.coalesce(x, F.array().cast("array<string>")) for x in ("items", "near_items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(hits, ["segment", "row"], "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        _digest(items).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.size(near_items).cast("long").alias("n_near_items"),
        _digest(near_items).alias("near_items_sha256"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has no window of a benchmark item; ids play no part."""
    rows, matches = _matched(docs, benchmark, 0)
    found = stored(rows.join(matches.select("segment", "row").distinct(), ["segment", "row"], "left_semi").select(F.col("h").alias("hit")).distinct(), "contaminated")
    column = "h_" + "_".join(docs.columns)  # a name that no column has
    held = docs.withColumn(column, F.xxhash64("text"))
    return join_checked(held, found, held[column] == found["hit"], "left_anti").select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM b WHERE len(ws) > 0)),
p AS (
  SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT doc_id, k, n, item_id FROM p JOIN i USING (n, w)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
f AS (SELECT w, count(*) AS n FROM t GROUP BY w),
v AS (SELECT *, row_number() OVER () AS phrase FROM (SELECT item_id, n, string_split(w, ' ') AS ws FROM i)),
x AS (SELECT phrase, item_id, n, ws[1] AS first_word, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS shift FROM v),
r AS (SELECT phrase, item_id, x.n, first_word, w, shift FROM x LEFT JOIN f USING (w) QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY coalesce(f.n, 0), shift) = 1),
z AS (
  SELECT DISTINCT doc_id, phrase, item_id, n, pos - shift + moved AS start, first_word
  FROM (SELECT t.doc_id, r.phrase, r.item_id, r.n, r.first_word, t.pos, r.shift, unnest(CASE WHEN r.shift = 0 THEN [0] ELSE range(-2, 3) END) AS moved FROM t JOIN r USING (w))),
y AS (SELECT z.* FROM z JOIN t ON t.doc_id = z.doc_id AND t.pos = z.start AND t.w = z.first_word),
q AS (
  SELECT y.doc_id, y.item_id, y.phrase, y.start FROM y JOIN x ON x.phrase = y.phrase JOIN t ON t.doc_id = y.doc_id AND t.w = x.w AND abs(t.pos - y.start - x.shift) <= CASE WHEN x.shift = 0 THEN 0 ELSE 2 END
  GROUP BY ALL HAVING count(DISTINCT x.shift) = any_value(y.n)),
e AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS near_items FROM q GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items, sha256(coalesce(near_items, '')) AS near_items_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN e USING (doc_id)
"""
