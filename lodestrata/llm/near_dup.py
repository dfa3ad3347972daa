"""SimHash near-duplicates: generalised pigeonhole search for fingerprints that differ in few bits.

Bits that correlate are grouped into partitions. By the generalised pigeonhole principle two fingerprints
within ``radius`` bits agree, in at least one partition, up to that partition's threshold, if the thresholds
sum to ``radius - partitions + 1`` (-1: the partition is not probed). The thresholds, and the number of
partitions, are chosen by dynamic programming over candidate counts estimated from the joint statistics of
all pairs of bits over all distinct fingerprints. Each fingerprint is then filed under its partition values
(with up to threshold bits masked), and those that meet in a bucket are compared.

A bucket of more than ``BUCKET`` fingerprints is not compared pair by pair. Its members go to an exact way
whose cost is linear: each is filed under itself and its 64 one-bit neighbours; two fingerprints meet there
if and only if they differ in at most two bits, and no such group has over 65 members. ``BUCKET`` is where
that begins to pay: a comparison takes a few nanoseconds, filing a row under 65 keys about 0.1 ms. In a search
within another number of bits the members of large buckets are compared in blocks that hold two parts of a bucket.

Defined cases: a null or empty text has fingerprint zero, which is linked like any other. Equal texts have equal
fingerprints, so ties and repeated rows fall in one component. A null ``doc_id`` links others but never
names a component; a component with none but null ids has a null id. The shingles of a very long text are hashed
100,000 at a time. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import textkit as K
from lodestrata.llm.components import components, least_places
from lodestrata.llm.storage import join_checked, plain, stored, table

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Largest bucket whose members are compared pair by pair.
BUCKET = 8192
#: Buckets up to this size are compared together, larger ones one by one.
SMALL = 32
MAX_PARTITIONS = 6
#: Cost of filing a fingerprint under one key, in comparisons.
KEY_COST = 8.0

_LOWER = bytes(K.LOWER)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over hashed word shingles, as a signed long."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    total, n = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for low in range(0, n, 100_000):
        size = min(100_000, n - low)
        hashes = np.fromiter((xxhash.xxh64_intdigest(next(shingles), SEED) for _ in range(size)), np.uint64, size)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


@K.released
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp for each row."""
    source = plain(docs, "doc_id", "text")
    return source.mapInArrow(_fingerprints, T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType())]))


@K.released
def _bit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for low in range(0, len(fps), 50_000):
            bits = np.unpackbits(fps[low : low + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    i, j = np.indices((64, 64)).reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and of those with bits i and j both set: 64 x 64 sums over all of them."""
    rows = distinct.select("fp").mapInArrow(_bit_pairs, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((64, 64))
    for r in rows:
        both[r["i"], r["j"]] = r["n"]
    return distinct.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of almost equal size, each grown by the bit that correlates most with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = set(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(left, key=lambda i: (sum(tie[i, j] for j in left if j != i), -i))
        group = [first]
        while len(group) < size:
            group.append(max(left - set(group), key=lambda i: (sum(tie[i, j] for j in group), -i)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def candidate_share(n: int, both: np.ndarray, bits: list[int], radius: int) -> np.ndarray:
    """Estimated share of all pairs that differ in at most 0, 1, .. ``radius`` of ``bits``.

    Two random fingerprints agree in bit j with a chance that depends on whether they agree in the bit
    before it that is tied to it most (a tree of dependences).
    """
    n = max(n, 1)
    p1 = both.diagonal() / n
    agree = p1**2 + (1 - p1) ** 2

    def joint(i: int, j: int) -> float:
        p11 = both[i, j] / n
        return sum(x * x for x in (p11, p1[i] - p11, p1[j] - p11, 1 - p1[i] - p1[j] + p11))

    chances = [agree[bits[0]]]
    for k, j in enumerate(bits[1:], 1):
        chances.append(max(joint(i, j) / agree[i] for i in bits[:k]))
    spread = np.zeros(radius + 1)
    spread[0] = 1.0
    for c in chances:
        spread = spread * c + np.concatenate(([0.0], spread[:-1])) * (1 - c)
    return np.cumsum(spread)


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The groups of bits to probe and their thresholds, of least estimated cost."""
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, MAX_PARTITIONS + 1):
        groups = group_bits(n, both, parts)
        plans: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of thresholds so far
        for group in groups:
            share = candidate_share(n, both, group, radius)
            grown: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, taken) in plans.items():
                for t in range(-1, radius + 1):
                    extra = 0.0 if t < 0 else n * comb(len(group), t) * KEY_COST + n * n / 2 * share[t]
                    if total + t not in grown or cost + extra < grown[total + t][0]:
                        grown[total + t] = (cost + extra, [*taken, t])
            plans = grown
        cost, taken = plans.get(radius - parts + 1, (float("inf"), []))
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, taken) if t >= 0])
    return best[1]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bit masks to file fingerprints under: each group less every choice of threshold bits."""
    out = []
    for bits, t in plan:
        for dropped in combinations(bits, t):
            mask = sum(1 << b for b in bits if b not in dropped)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= radius


def _links(run: np.ndarray, fp: np.ndarray, size: np.ndarray, radius: int) -> np.ndarray:
    """Places (low, high) that connect all within ``radius`` bits in the same bucket; ``run``: ascending bucket numbers."""
    found = [np.zeros((2, 0), np.int64)]
    small = np.flatnonzero(size <= SMALL)
    r, f = run[small], fp[small]
    for d in range(1, min(int(size[small].max(initial=0)), len(small))):
        at = np.flatnonzero((r[d:] == r[:-d]) & _near(f[d:], f[:-d], radius))
        found.append(np.stack((small[at], small[at + d])))
    for bucket in np.unique(run[size > SMALL]):
        first, last = np.searchsorted(run, (bucket, bucket + 1))
        root = np.arange(last - first)
        for low in range(0, last - first, 256):  # 256 rows against all from them on, less what is connected already
            own, high = fp[first + low : last], min(256, last - first - low)
            i, j = np.nonzero(_near(own[:high, None], own[None, :], radius) & (root[low : low + high, None] != root[None, low:]))
            if len(i):
                root = least_places(len(root), *np.sort((root[low + i], root[low + j]), axis=0))[root]
        moved = np.flatnonzero(root != np.arange(len(root)))
        found.append(np.stack((first + root[moved], first + moved)))
    return np.concatenate(found, axis=1)


def verify_buckets(radius: int, most: float):
    """Rows (k, v, fp) sorted by bucket (k, v) -> (a, b) that connect what is linked, and (fp, null) for members of buckets of more than ``most``.

    Works on a stream: it holds one batch, and no more than ``most`` rows of the bucket that a batch ends in.
    """

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "v", "fp"]
        held = [np.zeros(0, np.int64)] * 3
        large: tuple[int, int] | None = None  # the large bucket that the stream is in

        def emit(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], ["a", "b"])

        def settle(k: np.ndarray, v: np.ndarray, fp: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, large
            if large is not None and len(k):
                inside = int(np.argmax(np.append((k != large[0]) | (v != large[1]), True)))
                if inside:
                    yield emit(fp[:inside], None)
                    k, v, fp = k[inside:], v[inside:], fp[inside:]
                if len(k):
                    large = None
            if not len(k):
                held = [k, v, fp]
                return
            bucket = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]) | (v[1:] != v[:-1]))))
            size = np.bincount(bucket)
            open_run = -1 if last else bucket[-1]
            big = size[bucket] > most
            if big.any():
                yield emit(fp[big], None)
            if open_run >= 0 and size[open_run] > most:
                large = (int(k[-1]), int(v[-1]))
            keep = ~big & (bucket == open_run)
            held = [x[keep] for x in (k, v, fp)]
            todo = ~big & (bucket != open_run) & (size[bucket] > 1)
            fp = fp[todo]
            root = least_places(len(fp), *_links(bucket[todo], fp, size[bucket[todo]], radius))
            moved = np.flatnonzero(root != np.arange(len(fp)))
            if len(moved):
                yield emit(fp[root[moved]], fp[moved])

        for batch in batches:
            yield from settle(*(np.concatenate((h, batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64))) for h, x in zip(held, names)), last=False)
        yield from settle(*held, last=True)

    return run


def _filed(distinct: DataFrame, keys: list[int]) -> DataFrame:
    """k, v, fp: the fingerprints under the buckets of all masks."""
    filed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(keys)])).alias("key"))
    return filed.select(F.col("key.k").cast("long").alias("k"), "key.v", "fp")


def _verified(filed: DataFrame, radius: int, most: float) -> DataFrame:
    buckets = filed.repartition("k", "v").sortWithinPartitions("k", "v")
    return stored(buckets.mapInArrow(verify_buckets(radius, most), "a long, b long"), "buckets")


def _around(dense: DataFrame) -> DataFrame:
    """Links that connect all of ``dense`` (a) within two bits: a fingerprint and the least one that shares a one-bit neighbour with it."""
    around = F.array(F.col("a"), *[F.col("a").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])
    dense = dense.select("a", F.explode(around).alias("key"))
    first = dense.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    return dense.join(first, "key").where("a != b").select("a", "b")


def _in_blocks(dense: DataFrame, keys: list[int], radius: int) -> DataFrame:
    """Links that connect all members of one large bucket within ``radius`` bits; each two of its parts meet in one block. ``dense``: a, all such members."""
    filed = _filed(dense.select(F.col("a").alias("fp")), keys)
    parts = filed.groupBy("k", "v").agg(F.ceil(4 * F.count("*") / BUCKET).cast("int").alias("parts")).where("parts > 4")
    dealt = join_checked(filed, parts, ["k", "v"]).select("*", F.pmod(F.xxhash64("fp"), "parts").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = dealt.select("k", F.xxhash64("v", F.least("own", F.col("other").cast("long")), F.greatest("own", F.col("other").cast("long"))).alias("v"), "fp")
    return _verified(blocks, radius, float("inf"))


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b that connect all distinct fingerprints (column fp) within ``radius`` bits of each other."""
    keys = masks(allocate(*bit_statistics(distinct), radius))
    found = _verified(_filed(distinct, keys), radius, BUCKET)
    dense, links = found.where("b is null").select("a").distinct(), found.where("b is not null")
    if radius == RADIUS:
        return links.unionAll(_around(dense))
    return links if dense.isEmpty() else links.unionAll(_in_blocks(stored(dense, "dense"), keys, radius))


def _rooted(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id, and root (a fingerprint that stands for the component) for each row of ``docs``."""
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links) for each row of ``docs``."""
    return _rooted(docs).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: that of its least doc_id, with all columns.

    Of repeated rows with that doc_id the one of the least fingerprint in the component stays, so a doc_id with
    texts in several components stays once for each that it names. A row without a doc_id stays only if its
    component has no id at all, and then one row of each text does.
    """
    found = _rooted(docs)
    chosen = found.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("x")).select(F.col("x.doc_id").alias("chosen_id"), F.col("x.fp").alias("chosen_fp"))
    column = "fp_" + "_".join(docs.columns)  # a name that no column has
    held = docs.where("doc_id is not null").mapInArrow(_with_fingerprint, T.StructType([*docs.schema, T.StructField(column, T.LongType())]))
    kept = held.join(chosen, (held["doc_id"] == chosen["chosen_id"]) & (held[column] == chosen["chosen_fp"]), "left_semi").dropDuplicates(["doc_id", column])
    return kept.select(*docs.columns).unionAll(_nameless(docs, found))


def _nameless(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows without a doc_id in components without one: one row of each text."""
    lone = found.where("doc_id is null and component_id is null").select("fp").distinct()
    bare = docs.where("doc_id is null").dropDuplicates(["text"])
    if bare.isEmpty():
        return bare
    column = "fp_" + "_".join(docs.columns)  # a name that no column has
    held = bare.mapInArrow(_with_fingerprint, T.StructType([*docs.schema, T.StructField(column, T.LongType())]))
    return held.join(lone, held[column] == lone["fp"], "left_semi").select(*docs.columns)


@K.released
def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(x.as_py()) for x in batch.column("text")]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*names, "fp_" + "_".join(names)])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
