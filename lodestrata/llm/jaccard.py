"""Near-duplicate groups by the Jaccard similarity of word shingles.

Texts are sets of hashed shingles of ``size`` words (lower case A-Z, split at white space; a shorter text is one
shingle). Two texts are linked if their sets have a similarity of at least ``NUMERATOR / DENOMINATOR``. Candidates come from
the fingerprint search of :mod:`lodestrata.llm.near_dup` within ``RADIUS`` bits: what it connects is a bucket. Similar texts
whose fingerprints are further apart share one of ``BANDS`` bands of ``ROWS`` minimum hashes, which are buckets too. Every
candidate pair is then compared exactly, on the whole sets. A pair at 0.8 meets in no band with a chance of
(1 - 0.8^4)^24 = 3e-6, closer pairs with less.

Equal sets are one node, so copies cost nothing. Each bucket has a hub, the member whose buckets are largest: of a
group of edited copies that is the text they come from. All members are compared with their hubs first, in parts of
about ``MEMBERS`` members that each hold the hub's set once, and what sets a member apart from its hub, the symmetric
difference, is stored. Sets travel as bytes. That is enough to compare two members of a
hub exactly: they differ in the symmetric difference of their differences. So members that are not linked to their
hub are compared with all others of it on these short lists, in blocks of bounded size (``MEMBERS``, ``TOKENS``)
that hold a part of each side, and a block hands on no more than connects its components. No pair is dropped.

Defined cases: null and empty texts have the empty set and are linked to each other only. A group is named by its
least doc_id (null only if it has no other) and least text hash; of rows with that id and text the one stays whose JSON
is least. Very long texts are worked on in slices of
shingles; their sets are held whole. An empty table gives an empty result. Other columns are ignored, or passed on
unchanged by :func:`keep_one_similar`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import near_dup as N
from lodestrata.llm import textkit as K
from lodestrata.llm.components import components, least_places
from lodestrata.llm.storage import join_checked, plain, stored

SIZE = 5
NUMERATOR, DENOMINATOR = 4, 5
#: Bits in which fingerprints of candidates differ at most.
RADIUS = 6
BANDS, ROWS = 24, 4
#: Shingles whose minimum hashes are taken at once.
CHUNK = 20_000
#: Members of a hub, and shingles in their differences, that one side of a block has, about.
MEMBERS, TOKENS = 1024, 2_000_000
#: Shingles that are compared at once in a block.
COLUMNS = 2048
#: Rows with sets that are handed to Python at once.
BATCH_ROWS = 500

_DRAW = np.random.default_rng(20260728)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_ROW_FACTORS = _DRAW.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    for low, high in K.slices(texts):
        data, starts, ends = K.joined(texts.slice(low, high - low), b" ")
        first, last = K.word_spans(data, K.NOT_SPACE)
        words = K.span_hashes(K.LOWER[data], first, last)
        for a, b in zip(np.searchsorted(first, starts), np.searchsorted(first, ends)):
            own = words[a:b]
            k = min(size, len(own))
            total = np.full(len(own) - k + 1 if k else 0, k, np.uint64)
            for j in range(k):
                total = total * _PLACE + own[j : len(own) - k + 1 + j]
            yield np.unique(K.mixed(total))


def bands(found: np.ndarray) -> np.ndarray:
    """The bucket of each band of a set; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[low : low + CHUNK, None] * _FACTORS + _OFFSETS).min(axis=0))
    mixed = (K.mixed(least).reshape(BANDS, ROWS) * _ROW_FACTORS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE
    return K.mixed(mixed).view(np.int64)


def _keys(found: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of the whole set: its name, and what tells sets of one name apart."""
    whole = found.tobytes()
    return tuple(np.array([xxhash.xxh64_intdigest(whole, seed) for seed in (1, 2)], np.uint64).view(np.int64).tolist())


def _sketches(size: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, buckets, prints = [], [], [], [N.fingerprint(x.as_py()) for x in batch.column("text")]
            for found in shingle_sets(batch.column("text"), size):
                keys.append(_keys(found))
                sizes.append(len(found))
                buckets.append(bands(found))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, buckets)]), pa.int32()), pa.array(np.concatenate(buckets) if buckets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *[pa.array([x[k] for x in keys], pa.int64()) for k in (0, 1)], pa.array(sizes, pa.int64()), lists, pa.array(prints, pa.int64())], ["doc_id", "h", "key", "check", "n", "buckets", "fp"])

    return run


def _sets(size: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 200):
                part = batch.slice(row, 200)
                found = [x.tobytes() for x in shingle_sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.binary())], ["key", "shingles"])

    return run


def _parts(count: Column, tokens: Column) -> Column:
    """Blocks that a side of so many members and shingles is dealt to."""
    return F.greatest(F.ceil(count / MEMBERS), F.ceil(tokens / TOKENS), F.lit(1)).cast("int")


def _sizes(sets: pa.BinaryArray) -> np.ndarray:
    return pc.binary_length(sets).to_numpy(zero_copy_only=False).astype(np.int64) // 8


def shared_counts(left: pa.BinaryArray, right: pa.BinaryArray) -> np.ndarray:
    """Number of shingles that each set of ``left`` shares with each of ``right``."""
    sides = []
    for side in (left, right):
        sides.append((np.frombuffer(b"".join(side.to_pylist()), np.uint64), np.repeat(np.arange(len(side)), _sizes(side))))
    both = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, owner in sides:
        at = np.searchsorted(both, values)
        known = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == values) if len(both) else np.zeros(0, np.int64)
        order = known[np.argsort(at[known], kind="stable")]
        placed.append((at[order], owner[order]))
    out = np.zeros((len(left), len(right)), np.float32)  # exact: a set has fewer than 2^24 shingles in common with another
    for low in range(0, len(both), COLUMNS):
        width, grids = min(COLUMNS, len(both) - low), []
        for (at, owner), side in zip(placed, (left, right)):
            first, last = np.searchsorted(at, (low, low + width))
            grids.append(np.zeros((len(side), width), np.float32))
            grids[-1][owner[first:last], at[first:last] - low] = 1
        out += grids[0] @ grids[1].T
    return out


def _block_links(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of a block: pairs of roots that connect what is linked."""
    is_left = rows.column("is_left").to_numpy(zero_copy_only=False)
    n, root = (rows.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("n", "root"))
    i, j = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    edits = rows.column("edits")
    sizes = _sizes(edits)
    apart = root[i][:, None] != root[j][None, :]
    if not apart.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    differing = sizes[i][:, None] + sizes[j][None, :] - 2 * shared_counts(edits.take(pa.array(i)), edits.take(pa.array(j)))
    x, y = np.nonzero(apart & ((n[i][:, None] + n[j][None, :]) * (DENOMINATOR - NUMERATOR) >= differing * (DENOMINATOR + NUMERATOR)))
    names, places = np.unique(np.concatenate((root[i[x]], root[j[y]])), return_inverse=True)
    low, high = np.sort(places.reshape(2, -1), axis=0)
    least = least_places(len(names), low, high)
    moved = np.flatnonzero(least != np.arange(len(names)))
    return names[least[moved]], names[moved]


@K.released
def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, left, right) -> (a, b): roots that are linked. It holds the rows of one block."""
    held: list[pa.RecordBatch] = []
    block = None

    def settle() -> Iterator[pa.RecordBatch]:
        if held:
            a, b = _block_links(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("hub", "left", "right")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if block != tuple(keys[low]):
                yield from settle()
                block = tuple(keys[low])
            held.append(batch.slice(low, high - low))
    yield from settle()


@contextmanager
def _short_batches(spark: SparkSession):
    """While sets are handed to Python: batches of few rows, as a row can be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _whole_sets(source: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """key, shingles of the ``wanted`` (key, h) nodes; ``source``: h, text."""
    texts = join_checked(source, wanted, "h").select("key", "text").dropDuplicates(["key"])
    with _short_batches(source.sparkSession):
        return stored(texts.mapInArrow(_sets(size), "key long, shingles binary"), "sets")


@K.released
def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, part), a hub's own row first in each -> hub, key, hub_n, n, edits. It holds the set of one hub."""
    own = np.zeros(0, np.uint64)
    for batch in batches:
        hubs, keys, numbers = (batch.column(x).to_pylist() for x in ("hub", "key", "n"))
        out = []
        for k, (hub, key) in enumerate(zip(hubs, keys)):
            found = np.frombuffer(batch.column("shingles")[k].as_py(), np.uint64)
            if hub == key:
                own = found
            else:
                out.append((hub, key, len(own), numbers[k], np.setxor1d(own, found, assume_unique=True).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["hub", "key", "hub_n", "n", "edits"])


def _hub_differences(shared: DataFrame, nodes: DataFrame, source: DataFrame, size: int) -> DataFrame:
    """hub, key, hub_n, n, edits: what sets each member of a bucket apart from the bucket's hub. ``shared``: bucket, size, key, n."""
    weights = shared.groupBy("key").agg(F.sum("size").alias("weight"))
    hubs = stored(shared.join(weights, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("hub")), "hubs")
    pairs = join_checked(shared, hubs, "bucket").where("key != hub.key").select(F.col("hub.key").alias("hub"), "key", "n")
    pairs = stored(pairs.distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("hub", "key")).alias("key")).distinct()
    sets = _whole_sets(source, stored(nodes.select("key", "h").join(ends, "key", "left_semi"), "wanted"), size)
    parts = stored(pairs.groupBy("hub").agg(_parts(F.count("*"), F.sum("n")).alias("parts")), "parts")
    members = join_checked(pairs, parts, "hub").select("hub", F.pmod("key", "parts").cast("int").alias("part"), "key", "n").join(sets, "key")
    heads = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("key"), F.lit(0).cast("long").alias("n")).join(sets, "key")
    row = ["hub", "part", "key", "n", "shingles"]
    dealt = members.select(*row).unionAll(heads.select(*row)).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("key") != F.col("hub"))
    with _short_batches(source.sparkSession):
        return stored(dealt.mapInArrow(differences, "hub long, key long, hub_n long, n long, edits binary"), "edits", replaces=sets)


def _links_beside_hubs(edits: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: linked roots of members of one hub. ``roots``: node, root by the links to hubs."""
    of = lambda column: roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
    members = edits.join(of("key"), "key", "left").join(of("hub"), "hub", "left")
    members = members.select("hub", "key", "n", "edits", F.coalesce("key_root", "key").alias("root"), (F.coalesce("key_root", "key") != F.coalesce("hub_root", "hub")).alias("apart"))
    tokens = F.octet_length("edits") / 8
    groups = members.groupBy("hub").agg(F.count("*").alias("n_all"), F.sum(tokens).alias("t_all"), F.count_if("apart").alias("n_apart"), F.sum(F.when(F.col("apart"), tokens)).alias("t_apart")).where("n_apart > 0 and n_all > 1")
    dealt = members.join(groups.select("hub", _parts(F.col("n_apart"), F.col("t_apart")).alias("lefts"), _parts(F.col("n_all"), F.col("t_all")).alias("rights")), "hub")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ["key", "n", "root", "edits"]
    right = dealt.select("hub", every("lefts").alias("left"), F.pmod("key", "rights").cast("int").alias("right"), F.lit(False).alias("is_left"), *row)
    left = dealt.where("apart").select("hub", F.pmod("key", "lefts").cast("int").alias("left"), every("rights").alias("right"), F.lit(True).alias("is_left"), *row)
    blocks = left.unionAll(right).repartition("hub", "left", "right").sortWithinPartitions("hub", "left", "right")
    with _short_batches(edits.sparkSession):
        return stored(blocks.mapInArrow(compare_blocks, "a long, b long"), "beside")


def _nodes(rows: DataFrame) -> DataFrame:
    """key, h, n, buckets, and the least and largest check of the rows with each key."""
    return rows.groupBy("key").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.min("check").alias("check"), F.max("check").alias("other"))


def fingerprint_buckets(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """key, n, bucket: sets whose texts' fingerprints are connected within ``radius`` bits share a bucket. ``rows``: key, n, fp."""
    prints = stored(rows.where("n > 0").select("key", "n", "fp").distinct(), "prints")
    roots = components(N.near_links(stored(prints.select("fp").distinct(), "distinct"), radius)).withColumnRenamed("node", "fp")
    return join_checked(prints, roots, "fp", "left").select("key", "n", F.xxhash64(F.coalesce("root", "fp")).alias("bucket")).distinct()


def jaccard_groups(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, h (xxhash64 of the text), root of each row of ``docs``; rows of one group have the same root."""
    source = plain(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    kinds = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("h long, key long, check long, n long, buckets array<long>, fp long")])
    rows = stored(source.mapInArrow(_sketches(size), kinds), "sketches")
    nodes = stored(_nodes(rows), "nodes")
    if not nodes.where("other != check").isEmpty():  # two sets with one name, of 2^64
        rows = stored(rows.withColumn("key", F.xxhash64("key", "check")), "sketches")
        nodes = stored(_nodes(rows), "nodes")
    filed = nodes.select("key", "n", F.explode("buckets").alias("bucket")).unionAll(fingerprint_buckets(rows))
    sizes = stored(filed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = stored(join_checked(filed, sizes, "bucket"), "shared")
    edits = _hub_differences(shared, nodes, source.select("h", "text"), size)
    linked = (F.col("hub_n") + F.col("n")) * (DENOMINATOR - NUMERATOR) >= F.octet_length("edits") / 8 * (DENOMINATOR + NUMERATOR)
    links = edits.where(linked).select(F.col("hub").alias("a"), F.col("key").alias("b"))
    final = components(links.unionAll(_links_beside_hubs(edits, components(links))))
    return rows.join(final.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "h", F.coalesce("root", "key").alias("root"))


def keep_one_similar(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row of each group of ``docs``, with all columns: that of its least doc_id (a null one last), and of its least text hash there.

    The rows to drop are joined, not those to keep: they are fewer, and rarely more than can be broadcast.
    """
    found = stored(jaccard_groups(docs, size), "groups")
    several = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h")).alias("x"), F.count("*").alias("rows")).where("rows > 1")
    chosen = stored(several.select("root", F.col("x.doc_id").alias("chosen_id"), F.col("x.h").alias("chosen_h")), "chosen")
    is_chosen = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("h") == F.col("chosen_h"))
    judged = join_checked(found, chosen, "root").groupBy("doc_id", "h").agg(F.count("*").alias("times"), F.first(is_chosen).alias("stays"))
    judged = stored(judged.where("not stays or times > 1").select(F.col("doc_id").alias("judged_id"), F.col("h").alias("judged_h"), "stays"), "judged")
    column = "h_" + "_".join(docs.columns)  # a name that no column has
    held = docs.withColumn(column, F.xxhash64("text"))
    same = held["doc_id"].eqNullSafe(judged["judged_id"]) & (held[column] == judged["judged_h"])
    kept = join_checked(held, judged, same, "left_anti")
    again = judged.where("stays")
    if not again.isEmpty():  # repeated rows
        row = F.struct(*[F.col(f"`{x}`") for x in docs.columns])
        one = join_checked(held, again, same, "left_semi").groupBy("doc_id", column).agg(F.min_by(row, F.to_json(row)).alias("row"))
        kept = kept.select(*docs.columns).unionAll(one.select("row.*"))
    return kept.select(*docs.columns)
