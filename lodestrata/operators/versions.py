"""Versions of the same records held against each other: three-way round trips, and reviews carried to a new queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _told(tests: dict[str, Column]) -> Column:
    """Sorted names of the tests that hold; a null test doesn't."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()])))


def _digest(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def _side(rows: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """key, and as ``name``: number of rows, and of the columns the digest of the value (of repeated rows the least) and whether it differs among them.

    Values are shuffled once, to find the least; what is joined is their digests.
    """
    values = [F.min(F.col(c).cast("string")).alias(c) for c in columns]
    told = {c: F.coalesce(_digest(F.col(c)), F.lit("")) for c in columns}
    differs = [(F.min(x) != F.max(x)).alias(f"{c}_differs") for c, x in told.items()]
    counted = rows.groupBy(key).agg(F.count("*").alias("rows"), *values, *differs)
    kept = [_digest(F.col(c)).alias(c) if c in columns else F.col(c) for c in counted.columns if c != key]
    return counted.select(F.col(key).alias("key"), F.struct(*kept).alias(name))


def round_trip(versions: dict[str, DataFrame], key: str, columns: dict[str, list[str]]) -> DataFrame:
    """key, problems: one full outer join of several versions of the same records by ``key``.

    ``columns``: for each version the columns that it has of the first one. Problems are ``missing:<version>``,
    ``repeated:<version>``, ``differs:<version>:<column>`` (against the first version that has the key, null equals null),
    ``unclear:<version>:<column>`` (its repeated rows differ). A null key is one key. Each version is aggregated first, so a key that
    repeats often costs no more than once.
    """
    first = next(iter(versions))
    joined = None
    for name, rows in versions.items():
        side = _side(rows, key, columns[name], name)
        if joined is None:
            joined = side
        else:
            side = side.withColumnRenamed("key", "other")
            joined = joined.join(side, joined["key"].eqNullSafe(side["other"]), "full").withColumn("key", F.coalesce("key", "other")).drop("other")
    tests: dict[str, Column] = {}
    for name in versions:
        there = F.col(name).isNotNull()
        tests[f"missing:{name}"] = ~there
        tests[f"repeated:{name}"] = F.col(f"{name}.rows") > 1
        for c in columns[name]:
            tests[f"unclear:{name}:{c}"] = F.col(f"{name}.{c}_differs")
            if name != first and c in columns[first]:
                tests[f"differs:{name}:{c}"] = there & F.col(first).isNotNull() & ~F.col(f"{name}.{c}").eqNullSafe(F.col(f"{first}.{c}"))
    return joined.select(F.col("key").alias(key), _told(tests).alias("problems"))


def fingerprint(columns: list[str]) -> Column:
    """A hash of columns as text; null differs from every text."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def carried_reviews(reviews: DataFrame, queue: DataFrame, key: str, semantic: list[str], decision: str, reusable: Column, compact: Column) -> DataFrame:
    """The queue with ``outcome`` and, where it is ``carried``, the old decision.

    An old review is reused if its content (``semantic`` columns, by fingerprint) is that of the queue's row, all reviews of that
    content agree, and it is ``reusable`` (a condition on the review), if the new row is ``compact`` (a condition on the
    queue). Outcomes, the first that holds: ``new`` (no review of the key), ``stale`` (reviews of other content
    only), ``ambiguous`` (their decisions differ), ``not_reusable``, ``not_compact``, ``carried``.
    """
    known = reviews.select(key, fingerprint(semantic).alias("_print"), F.col(decision).alias("_decision"), F.coalesce(reusable, F.lit(False)).alias("_reusable"))
    exact = known.groupBy(key, "_print").agg(F.min("_decision").alias("_decision"), F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("_decision").cast("string")), F.lit(""))).alias("_kinds"), F.min("_reusable").alias("_reusable"))
    seen = known.groupBy(key).agg(F.lit(True).alias("_seen"))
    joined = queue.withColumn("_print", fingerprint(semantic)).join(exact, [key, "_print"], "left").join(seen, key, "left")
    outcome = (
        F.when(F.col("_seen").isNull(), "new")
        .when(F.col("_kinds").isNull(), "stale")
        .when(F.col("_kinds") > 1, "ambiguous")
        .when(~F.col("_reusable"), "not_reusable")
        .when(~F.coalesce(compact, F.lit(False)), "not_compact")
        .otherwise("carried")
    )
    return joined.select(*[F.col(f"`{c}`") for c in queue.columns], outcome.alias("outcome"), F.when(outcome == "carried", F.col("_decision")).alias("carried_decision"))
