"""Overlap between training and held-out records, and exclusion of what was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.hashing import derived_seed
from lodestrata.operators.ranks import key_rank


def shared_ids(train: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """Evaluation rows whose id was trained on."""
    return evaluation.join(train.select(key).distinct(), key, "left_semi")


def shared_marks(train: DataFrame, evaluation: DataFrame, key: str, marks: str) -> DataFrame:
    """key, mark: marks (an array column, compared in upper case) of evaluation rows that training rows carry too."""
    seen = train.select(F.explode(marks).alias("mark")).select(F.upper("mark").alias("mark")).distinct()
    asked = evaluation.select(key, F.explode(marks).alias("mark")).select(key, F.upper("mark").alias("mark")).distinct()
    return asked.join(seen, "mark", "left_semi")


def untrained(challenge: DataFrame, train: DataFrame, challenge_hash: str, train_hashes: list[str]) -> DataFrame:
    """Challenge rows whose fingerprint is none of the training rows' fingerprints."""
    seen = train.select(F.explode(F.array(*train_hashes)).alias(challenge_hash)).where(F.col(challenge_hash).isNotNull()).distinct()
    return challenge.join(seen, challenge_hash, "left_anti")


def untouched(challenge: DataFrame, exposed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Challenge rows that were not exposed; and exposed keys that are not of the challenge (an error if any)."""
    return challenge.join(exposed.select(key).distinct(), key, "left_anti"), exposed.select(key).join(challenge.select(key), key, "left_anti")


def balanced_blind_sample(challenge: DataFrame, train: DataFrame, key: str, fingerprint: str, label: str, per_label: int, seed: int) -> DataFrame:
    """``per_label`` rows of each label by hash rank, none of them trained on."""
    fresh = untrained(challenge, train, fingerprint, [fingerprint])
    rank = F.row_number().over(Window.partitionBy(label).orderBy(derived_seed(seed, F.col(key)), key))
    return fresh.withColumn("_n", rank).where(F.col("_n") <= per_label).drop("_n")


def open_queue(queue: DataFrame, reviewed: list[DataFrame], key: str, order: str, k: int) -> DataFrame:
    """The first ``k`` queue rows that no review list has."""
    done = reviewed[0].select(key)
    for x in reviewed[1:]:
        done = done.unionAll(x.select(key))
    return queue.join(done.distinct(), key, "left_anti").orderBy(order).limit(k)


def replacements(failed: DataFrame, reserve: DataFrame, key: str, order: str, by: str) -> DataFrame:
    """key, replacement: the k-th failed row of each class with the k-th reserve row."""
    left = key_rank(failed.select(by, key, order), by, order, "k", [key]).select(by, key, F.col("k").cast("int").alias("k"))
    right = key_rank(reserve.select(by, key, order), by, order, "k", [key]).select(by, F.col(key).alias("replacement"), F.col("k").cast("int").alias("k"))
    return left.join(right, [by, "k"], "left").select(by, "k", key, "replacement")


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one side only. Empty if both id sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionAll(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field: fields that differ (null-safe) between two versions of the same record."""
    l, r = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields]), right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields])
    joined = l.join(r, key)
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields]))
    return joined.select(key, F.explode(wrong).alias("field"))
