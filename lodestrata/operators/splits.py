"""Splits of records by group, ratio, stratum or time, and checks that they keep apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.hashing import derived_seed


def isolation_violations(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in over one split."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def ratio_split(df: DataFrame, key: str, seed: int, train: float, validation: float) -> DataFrame:
    """Adds ``split`` by rank of the seeded hash; counts are truncated; three rows or more leave one for test.

    Ranks are found without one global sort task: rows are counted by hash bucket first.
    """
    if not 0 < train + validation <= 1.001:
        raise ValueError("ratios sum to more than 1")
    drawn = df.withColumn("_u", derived_seed(seed, F.col(key))).withColumn("_b", (F.col("_u") / F.lit(2**52)).cast("long"))
    counts = drawn.groupBy("_b").agg(F.count("*").alias("_c"))
    base = counts.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    total = counts.agg(F.sum("_c").alias("_n"))
    ranked = drawn.join(base, "_b").withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy("_u", key))).crossJoin(F.broadcast(total))
    n_train, n_validation = F.floor(F.col("_n") * train), F.floor(F.col("_n") * validation)
    spare = F.when((F.col("_n") >= 3) & (n_train + n_validation >= F.col("_n")), 1).otherwise(0)
    split = F.when(F.col("_rank") <= n_train - spare, "train").when(F.col("_rank") <= n_train - spare + n_validation, "validation").otherwise("test")
    return ranked.withColumn("split", split).select(*df.columns, "split")


def ranged_split(value: Column, ranges: dict[str, tuple]) -> Column:
    """The name of the range (both ends included) that holds ``value``; null outside all."""
    out = F.lit(None).cast("string")
    for name, (low, high) in ranges.items():
        out = F.when(value.between(low, high), name).otherwise(out)
    return out


def shared_members(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def overlap_counts(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """n_keys by the set of splits that a key occurs in."""
    sets = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), "+").alias("splits"))
    return sets.groupBy("splits").agg(F.count("*").alias("n_keys"))
