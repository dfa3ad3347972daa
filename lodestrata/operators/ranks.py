"""Running sums and ranks whose windows hold a part of the rows each: rows are dealt to ranges of the order first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a window sorts, about, and sampled rows for each range.
ROWS_A_RANGE, SAMPLED = 500_000, 16
MOST_RANGES = 1 << 14
#: Ranges that are told apart by one comparison tree; beyond that there is one below each of them.
TREE = 64
#: Ranges of a draw of 64 bits.
DRAW_BINS = 4096


def edges_of(df: DataFrame, column: str, rows: int) -> list:
    """Where the ranges of a column of any kind that can be sorted end: quantiles of a sample, drawn by hash; none for few rows."""
    ranges = min(MOST_RANGES, -(-df.count() // rows))
    if ranges < 2:
        return []
    drawn = df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(ranges * SAMPLED).collect()  # of bounded size
    values = sorted(r[0] for r in drawn)
    return sorted({values[k * len(values) // ranges] for k in range(1, ranges)}) if values else []


def _tree(column: Column, edges: list, low: int = 0) -> Column:
    """How many of the sorted edges are below a value, by comparisons that halve them."""
    if not edges:
        return F.lit(low)
    half = len(edges) // 2
    return F.when(column <= edges[half], _tree(column, edges[:half], low)).otherwise(_tree(column, edges[half + 1 :], low + half + 1))


def bin_of(df: DataFrame, column: str, rows: int | None = None) -> Column:
    """The range of a column that a row falls in: ranges of about ``rows`` rows each, in the column's order; nulls are in the first."""
    edges = edges_of(df, column, rows or ROWS_A_RANGE)
    value = F.col(column)
    if len(edges) <= TREE:
        return F.coalesce(F.when(value.isNotNull(), _tree(value, edges)), F.lit(0))
    step = -(-len(edges) // TREE)
    parts = [edges[k : k + step] for k in range(0, len(edges), step)]
    top = _tree(value, [x[-1] for x in parts[:-1]])
    inner = F.filter(F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in parts]), top + 1), lambda e: e < value)
    return F.coalesce(F.when(value.isNotNull(), top * step + F.size(inner)), F.lit(0))


def running_sums(df: DataFrame, order: str, sums: list[str], within: list[str] | None = None, descending: bool = False, ties: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Adds ``<name>_before`` for each of ``sums``: its sum over the rows before this one, by ``order`` and then ``ties``, inside each value of ``within``."""
    within = within or []
    way = [F.col(c).desc() if descending else F.col(c).asc() for c in [order, *(ties or [])]]
    binned = df.withColumn("_bin", bin_of(df, order, rows))
    before = Window.partitionBy(*within).orderBy(F.desc("_bin") if descending else F.asc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range (of each class)
    offsets = binned.groupBy(*within, "_bin").agg(*[F.sum(x).alias(x) for x in sums]).select(*within, "_bin", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_{x}") for x in sums])
    inside = Window.partitionBy(*within, "_bin").orderBy(*way).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(F.col("_bin").alias("_b"), *[F.col(x).alias(f"_c{k}") for k, x in enumerate(within)], *[f"_{x}" for x in sums])
    same = F.col("_bin") == F.col("_b")
    for k, x in enumerate(within):
        same = same & F.col(x).eqNullSafe(F.col(f"_c{k}"))
    out = binned.join(offsets, same)
    return out.select(*df.columns, *[(F.col(f"_{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(f"{x}_before") for x in sums])


def draw_rank(df: DataFrame, within: str, draw: Column, key: str, name: str) -> DataFrame:
    """Adds the 1-based rank of each row of its class by a 64-bit draw, then by key; a class of a third of all rows spreads over all tasks."""
    drawn = df.withColumn("_u", draw).withColumn("_bin", (F.col("_u") / F.lit(2**64 // DRAW_BINS)).cast("int"))
    before = Window.partitionBy(within).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy(within, "_bin").agg(F.count("*").alias("_c")).select(within, "_bin", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(within, "_bin").orderBy("_u", key)
    return drawn.join(offsets, [within, "_bin"]).withColumn(name, F.col("_base") + F.row_number().over(inside)).drop("_u", "_bin", "_base")


def key_rank(df: DataFrame, within: str | list[str], key: str, name: str, ties: list[str] | None = None) -> DataFrame:
    """Adds the 1-based rank of each row of its class by a key, and then by ``ties``; together they are unique in the class."""
    classes = [within] if isinstance(within, str) else within
    return running_sums(df.withColumn("_one", F.lit(1)), key, ["_one"], classes, ties=ties).withColumn(name, F.col("_one_before") + 1).drop("_one", "_one_before")
