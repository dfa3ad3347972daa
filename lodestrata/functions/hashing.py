"""Hashes and deterministic draws. Everything random in this library derives from these, by seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(text: Column, length: int = 64) -> Column:
    """The first ``length`` hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, length)


def derived_seed(seed: int | Column, value: Column) -> Column:
    """Unsigned 64-bit number from the SHA-256 of ``seed:value``, as decimal(20,0)."""
    first = F.concat(seed.cast("string"), F.lit(":")) if isinstance(seed, Column) else F.lit(f"{seed}:")
    return F.conv(sha(F.concat(first, value.cast("string")), 16), 16, 10).cast("decimal(20,0)")


def hash_split(seed: int, group: Column) -> Column:
    """80 % train, 10 % validation, 10 % test, by group."""
    bucket = derived_seed(seed, group) % 10000
    return F.when(bucket < 8000, "train").when(bucket < 9000, "validation").otherwise("test")


def exponential_priority(seed: int | Column, value: Column, weight: Column) -> Column:
    """Key of weighted sampling without replacement: the lowest keys are the sample."""
    return -F.log((derived_seed(seed, value).cast("double") + 1) / F.lit(float(2**64 + 1))) / weight


def pair_key(pair_id: Column, label: Column) -> Column:
    """Opaque key of one side of a pair."""
    return F.concat(F.lit("binary-group-"), sha(F.concat(pair_id, F.lit(":"), label), 16))


def canonical_json_hash(struct: Column) -> Column:
    """Hash of a struct's JSON; give its fields in alphabetical order."""
    return F.sha2(F.to_json(struct), 256)
