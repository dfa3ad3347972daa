"""Hard-negative mining by inner product, with a pivot table.

Every vector ``x`` gets one more component, ``sqrt(M^2 - |x|^2)`` with ``M`` the largest norm, and every anchor ``q`` a
zero; then ``|q - x|^2 = |q|^2 + M^2 - 2 q.x``, so that the largest inner products are the smallest Euclidean distances.
The pivot table stores each row's distances to ``PIVOTS`` pivots, in segments of at most ``SEGMENT`` rows that lie close
together (ordered by nearest pivot and distance to it). By the triangle inequality ``|d(q,p) - d(x,p)|`` and
``d(q,p) + d(x,p)`` bracket ``d(q,x)`` for every pivot ``p``, and so the score: first of whole segments, by their least
and largest distances, then of rows. Only rows whose bracket reaches what is wanted are scored, and then exactly.

The pivots, and the first bound of an anchor's positives, come from a sample of at most ``SAMPLE`` rows (those of least
hash). Every row is in the table and brackets never exclude a wanted one, so results are exact. Anchors are broadcast in
blocks of about ``ANCHORS``, one block after the other; a task keeps a few rows for each anchor of the block.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component (also one whose scaled
value is beyond doubles) take no part. Of rows with the same id the one of least label, then least vector, takes part,
so repeated rows are one. A shorter vector, an empty one too, counts as filled up with zeros. Ties go to the smaller id.
An anchor without another row of its label, or without fitting rows of other labels, gives no rows. An empty table gives
an empty result. Other columns are ignored; there are no texts. A score beyond 64 bits counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import textkit as K
from lodestrata.llm.storage import drop_path, new_path, plain, stored, table

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is between so many percent of its positive's.
LOWEST, HIGHEST = 80, 100
SCALE = 256
PIVOTS = 16
SAMPLE = 4096
#: Rows of a segment, and anchors that are compared with it at a time.
SEGMENT, CHUNK = 4096, 128
#: Anchors that are broadcast at a time, about.
ANCHORS = 50_000

_MOST = np.iinfo(np.int64).max  # the least long is its negative here, so that it can be negated
_INTEGERS = "vec_id long, label long, x binary, width int, norm double"
_PLACED = "near int, far double, vec_id long, label long, x binary"
_TABLE = "ids binary, labels binary, vectors binary, distances binary"
_FOUND = "owner long, id long, score long"


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, x: the rows that take part, one for each id, with array<double> vectors."""
    whole = f"vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and abs({SCALE} * cast(x as double)) < double('infinity'))"
    doubles = F.col("embedding").cast("array<double>").alias("x")
    rows = plain(rows, "vec_id", "label", "embedding").where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), doubles)
    again = stored(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    if again.isEmpty():  # the usual case: no vector is shuffled for it
        return rows
    once = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    return rows.join(again, "vec_id", "left_anti").unionAll(once)


@K.released
def to_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components ``floor(SCALE * x)`` as the bytes of doubles, their number and squared norm."""
    for batch in batches:
        x = batch.column("x")
        values, at = np.floor(SCALE * x.flatten().to_numpy(zero_copy_only=False)), x.offsets.to_numpy() - x.offsets[0].as_py()
        norms = K.sums_between(values * values, at[:-1], at[1:]) if len(values) else np.zeros(len(x))
        held = [values[low:high].tobytes() for low, high in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(held, pa.binary()), pa.array(np.diff(at), pa.int32()), pa.array(norms, pa.float64())], ["vec_id", "label", "x", "width", "norm"])


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in vectors), np.float64).reshape(len(vectors), width)


def scores(q: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of all rows of ``q`` with all of ``x``; ``bound``: the largest possible one."""
    if bound < 1 << 52:  # no partial sum leaves the integers that doubles hold
        return (q @ x.T).astype(np.int64)
    if bound < 1 << 61:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -_MOST, _MOST).astype(np.int64)


@dataclass
class Pivots:
    """Pivots with their added component, and the squared largest norm."""

    points: np.ndarray
    added: np.ndarray
    norm: float

    @staticmethod
    def spread(x: np.ndarray, norm: float) -> Pivots:
        """Of sampled rows: the first, and then always the one farthest from all chosen."""
        added = np.sqrt(np.maximum(norm - (x * x).sum(1), 0))
        chosen, nearest = [0], np.full(len(x), np.inf)
        while len(chosen) < min(PIVOTS, len(x)):
            k = chosen[-1]
            nearest = np.minimum(nearest, ((x - x[k]) ** 2).sum(1) + (added - added[k]) ** 2)
            if not nearest.max() > 0:
                break
            chosen.append(int(nearest.argmax()))
        return Pivots(x[chosen], added[chosen], norm)

    def from_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows of the table to the pivots. All rows have the norm M."""
        added = np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))
        return np.sqrt(np.maximum(2 * self.norm - 2 * (x @ self.points.T + added[:, None] * self.added), 0))

    def from_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.norm - 2 * q @ self.points.T, 0))

    @property
    def slack(self) -> float:
        """Rounding of distances can move a score's bracket by less than this."""
        return 1 + 2e-6 * self.norm


def first_of(owner: np.ndarray, id_: np.ndarray, score: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner's entries the first ``count``: higher scores first, ties by smaller id."""
    order = np.lexsort((id_, -score, owner))
    owner, id_, score = owner[order], id_[order], score[order]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    return owner[rank < count], id_[rank < count], score[rank < count]


@dataclass
class Block:
    """Anchors, and for each of its ``owners`` (an anchor, or an anchor's positive) the scores that are wanted."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    least: np.ndarray  # a row for each anchor, a column for each of its owners
    most: np.ndarray
    same: bool  # rows of the anchor's label are wanted, else all others
    count: int
    pivots: Pivots
    held: list[np.ndarray] = field(default_factory=list)

    def search(self, segments: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """owner, id, score: the first ``count`` rows of each owner among the segments (ids, labels, vectors, distances)."""
        found = np.zeros((3, 0), np.int64)
        least = self.least.copy()  # rises when an owner has enough rows
        to_pivots, total = self.pivots.from_anchors(self.q), (self.q * self.q).sum(1) + self.pivots.norm
        bracketed = self.pivots.norm < 1 << 61
        for ids, labels, x, far in segments:
            low, high = far.min(0), far.max(0)
            for start in range(0, len(self.ids), CHUNK):
                at = np.arange(start, min(start + CHUNK, len(self.ids)))
                kinds = np.unique(labels)
                at = at[np.isin(self.labels[at], kinds) if self.same else (self.labels[at] != kinds[0]) | (len(kinds) > 1)]
                if bracketed:
                    at = at[self._reached(total[at], *self._between(to_pivots[at], low, high), least[at], self.most[at])]
                if not len(at):
                    continue
                wanted = (self.labels[at][:, None] == labels) == self.same
                wanted &= self.ids[at][:, None] != ids
                if bracketed:
                    shortest, longest = np.zeros(wanted.shape), np.full(wanted.shape, np.inf)
                    for d, e in zip(to_pivots[at].T, far.T):
                        np.maximum(shortest, np.abs(d[:, None] - e), out=shortest)
                        np.minimum(longest, d[:, None] + e, out=longest)
                    wanted &= self._reached(total[at][:, None], shortest, longest, least[at].min(1)[:, None, None], self.most[at].max(1)[:, None, None])
                columns = np.flatnonzero(wanted.any(0))
                if not len(columns):
                    continue
                wanted = wanted[:, columns]
                exact = scores(self.q[at], x[columns], self.pivots.norm)
                for k in range(least.shape[1]):
                    fits = wanted & (exact >= least[at, k][:, None]) & (exact <= self.most[at, k][:, None])
                    if fits.sum() > 8 * self.count * len(at):  # what a row has beyond its first ones goes at once, ties stay
                        inside = np.where(fits, exact, -_MOST)
                        cut = max(0, len(columns) - self.count)
                        fits &= exact >= np.partition(inside, cut, axis=1)[:, cut : cut + 1]
                    a, i = np.nonzero(fits)
                    if len(a):
                        new = np.stack((at[a] * least.shape[1] + k, ids[columns[i]], exact[a, i]))
                        found = np.stack(first_of(*np.concatenate((found, new), 1), self.count))
                        owner, n = np.unique(found[0], return_counts=True)
                        full = n == self.count  # ties with the last one may still come in
                        last = found[2][np.cumsum(n)[full] - 1]
                        least[owner[full] // least.shape[1], owner[full] % least.shape[1]] = last
        return tuple(found)

    @staticmethod
    def _between(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest and longest distance that rows can have whose distances to the pivots are between low and high."""
        return np.maximum(np.maximum(d - high, low - d).max(1), 0), (d + high).min(1)

    def _reached(self, total: np.ndarray, shortest: np.ndarray, longest: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a score of which only the bracket of its distance is known may be one that an owner wants."""
        top, bottom = (total - shortest**2) / 2 + self.pivots.slack, (total - longest**2) / 2 - self.pivots.slack
        return ((top[..., None] >= least) & (bottom[..., None] <= most)).any(-1)


def place(pivots: Broadcast, width: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SEGMENT):
                rows = batch.slice(low, SEGMENT)
                far = pivots.value.from_rows(matrix(rows.column("x").to_pylist(), width))
                yield pa.RecordBatch.from_arrays([pa.array(far.argmin(1), pa.int32()), pa.array(far.min(1)), *[rows.column(x) for x in ("vec_id", "label", "x")]], ["near", "far", "vec_id", "label", "x"])

    return run


def build(pivots: Broadcast, width: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SEGMENT):
                rows = batch.slice(low, SEGMENT)
                x = matrix(rows.column("x").to_pylist(), width)
                parts = (rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), x, pivots.value.from_rows(x))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], ["ids", "labels", "vectors", "distances"])

    return run


def searched(block: Broadcast):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments():
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, labels = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in ("ids", "labels"))
                    x, far = (np.frombuffer(batch.column(c)[k].as_py(), np.float64).reshape(len(ids), -1) for c in ("vectors", "distances"))
                    yield ids, labels, x, far

        yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.value.search(segments())], ["owner", "id", "score"])

    return run


class PivotTable:
    """The stored pivot table of ``vectors`` (vec_id, label, x)."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        self.rows = stored(vectors.mapInArrow(to_integers, _INTEGERS), "integers")
        width, norm = self.rows.agg(F.max("width"), F.max("norm")).first()
        self.width = None if width is None else max(width, 1)
        if self.width is None:
            return  # no rows
        self.sample = self.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        self.pivots = Pivots.spread(matrix(self.sample["x"].to_pylist(), self.width), norm)
        held = self.spark.sparkContext.broadcast(self.pivots)
        placed = self.rows.mapInArrow(place(held, self.width), _PLACED).repartitionByRange("near", "far", "vec_id").sortWithinPartitions("near", "far", "vec_id")
        self.segments = stored(placed.mapInArrow(build(held, self.width), _TABLE), "pivots")

    def blocks(self, anchors: Column) -> Iterator[pa.Table]:
        """The anchors' rows, in blocks."""
        chosen = self.rows.where(anchors)
        count = -(-chosen.count() // ANCHORS)
        for k in range(count):
            yield chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == k).orderBy("vec_id").toArrow()

    def first(self, block: Block) -> DataFrame:
        """owner, id, score, rank: the first rows of each owner of the block, from all segments."""
        held = self.spark.sparkContext.broadcast(block)
        found = stored(self.segments.mapInArrow(searched(held), _FOUND), "found")
        held.destroy()
        order = Window.partitionBy("owner").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block.count)

    def positives(self, got: pa.Table, count: int) -> tuple[Block, pa.Table]:
        """The anchors' block, and owner, id, score of the first ``count`` other rows of the anchor's label."""
        ids, labels, q = got["vec_id"].to_numpy(), got["label"].to_numpy(), matrix(got["x"].to_pylist(), self.width)
        block = Block(ids, labels, q, np.full((len(ids), 1), -_MOST), np.full((len(ids), 1), _MOST), True, count, self.pivots)
        x = matrix(self.sample["x"].to_pylist(), self.width)
        known = (self.sample["vec_id"].to_numpy(), self.sample["label"].to_numpy(), x, self.pivots.from_rows(x))
        owner, _, score = block.search(iter([known]))
        owners, n = np.unique(owner, return_counts=True)
        block.least[owners[n == count], 0] = score[np.cumsum(n)[n == count] - 1]  # the sample's last one: no row below it is wanted
        return block, self.first(block).orderBy("owner", "rank").toArrow()


def hard_negatives(rows: DataFrame, anchors: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors``: condition on vec_id; ``label``: the label to use, by vec_id and label (theirs if none is given).
    """
    spark = rows.sparkSession
    found = PivotTable(usable(rows, F.col("label") if label is None else label))
    path, schema = new_path(spark, "negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    if found.width is not None:
        for got in found.blocks(anchors):
            block, near = found.positives(got, positives)
            owner, score = near["owner"].to_numpy(), near["score"].to_numpy()
            rank = near["rank"].to_numpy().astype(np.int64) - 1
            shape = (len(block.ids), positives)
            block.least, block.most = np.full(shape, _MOST), np.full(shape, -_MOST)  # nothing fits where there is no positive
            block.least[owner, rank] = [min(-(-lowest * int(s) // 100), _MOST) for s in score]
            block.most[owner, rank] = [min(highest * int(s) // 100, _MOST) for s in score]
            block.same, block.count = False, negatives
            pairs = spark.createDataFrame(pa.table({"owner": owner * positives + rank, "anchor_id": block.ids[owner], "positive_id": near["id"], "positive_score": near["score"]}))
            out = found.first(block).join(F.broadcast(pairs), "owner")  # a block's pairs: at most ``positives`` for each anchor
            out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
        drop_path(spark, found.segments._stored_at)
    drop_path(spark, found.rows._stored_at)
    return spark.read.schema(schema).parquet(path)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
