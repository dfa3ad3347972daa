"""Duplicates, label conflicts, and what becomes of each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, hash_column: str, ordinal: str, name: str, label: str | None = None) -> DataFrame:
    """Adds ``name``_first (ordinal of the hash's first record) and, with a label, ``name``_conflict (over one label).

    The per-hash facts are aggregated before they are joined back, so a hash shared by many rows is reduced
    map-side and its rows are split by the join, which a window would not do.
    """
    facts = [F.min(ordinal).alias(f"{name}_first")]
    if label:
        facts.append((F.min(label) != F.max(label)).alias(f"{name}_conflict"))
    per_hash = df.groupBy(F.col(hash_column).alias("_hash")).agg(*facts)
    return df.join(per_hash, df[hash_column].eqNullSafe(per_hash["_hash"])).drop("_hash")


def duplicate_pointers(df: DataFrame, hash_column: str, ordinal: str) -> DataFrame:
    """Adds ``duplicate_of``: the ordinal of the first record with the same hash; null for that record itself."""
    found = first_of(df, hash_column, ordinal, "same")
    return found.withColumn("duplicate_of", F.when(F.col("same_first") < F.col(ordinal), F.col("same_first"))).drop("same_first")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def disposition(exact_conflict: Column, near_conflict: Column, payload: Column, exact_dup: Column, near_dup: Column, has_code: Column, scoped: Column, eligible: Column) -> Column:
    """struct(disposition, reason) by the first rule that applies."""
    rules = [
        (exact_conflict, "quarantine", "conflicting_exact_duplicate_labels"),
        (near_conflict, "quarantine", "conflicting_near_duplicate_labels"),
        (payload, "reject", "executable_payload_forbidden"),
        (exact_dup, "reject", "exact_duplicate"),
        (near_dup, "reject", "near_duplicate"),
        (~has_code, "reject", "source_code_missing"),
        (~scoped, "quarantine", "scoped_cwe_missing"),
        (eligible, "eligible", "requires_prompt_and_target_sanitization"),
    ]
    out = F.struct(F.lit("quarantine").alias("disposition"), F.lit("outside_source_profile").alias("reason"))
    for when, what, why in reversed(rules):
        out = F.when(when, F.struct(F.lit(what).alias("disposition"), F.lit(why).alias("reason"))).otherwise(out)
    return out


def duplicate_mass(df: DataFrame, key: str) -> DataFrame:
    """One row: n, duplicate_mass (rows beyond the first of each key), max_share (of the most frequent key)."""
    return df.groupBy(key).count().agg(
        F.sum("count").alias("n"), F.sum(F.col("count") - 1).alias("duplicate_mass"), F.round(F.coalesce(F.try_divide(F.max("count").cast("double"), F.sum("count").cast("double")), F.lit(0.0)), 6).alias("max_share")
    )


def union_checked(frames: list[DataFrame], key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """The frames' rows by key, one each; and the keys that have over one payload."""
    every = frames[0]
    for x in frames[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    conflicts = every.groupBy(key).agg(F.countDistinct(payload).alias("n_payloads")).where("n_payloads > 1")
    return every.dropDuplicates([key]), conflicts
