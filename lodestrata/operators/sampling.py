"""Deterministic samples: by hash rank, weight, quota, stratum and cap.

Every choice is ordered by a seeded hash with the id as tie-break, so reruns and other partitionings agree.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.hashing import derived_seed, exponential_priority
from lodestrata.operators.ranks import draw_rank, key_rank

PROJECT_FRACTION = 0.10
CWE_EXPONENT = 0.25
PROJECT_EXPONENT = 0.15


def top_by_hash(df: DataFrame, key: str, seed: int, k: int, per: list[str] | None = None) -> DataFrame:
    """The ``k`` rows (of each class, if given) whose SHA-256 of ``seed``, a zero byte, key is lowest."""
    rank = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)
    if not per:
        return df.orderBy(rank, key).limit(k)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(rank, key))).where(F.col("_n") <= k).drop("_n")


def tempered_priority(df: DataFrame, stratum: str, project: str, key: str, seed: int | Column, by: list[str] | None = None) -> DataFrame:
    """Adds ``priority``: exponential key with weights that temper strata and projects that are frequent (in their class, if classes are given)."""
    counted, by = df, by or []
    for column, name in ((stratum, "_ns"), (project, "_np")):
        known = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
        counted = counted.withColumn("_k", known).join(df.groupBy(*by, known.alias("_k")).agg(F.count("*").alias(name)), [*by, "_k"]).drop("_k")
    weight = F.pow(F.col("_ns"), F.lit(-CWE_EXPONENT)) * F.pow(F.col("_np"), F.lit(-PROJECT_EXPONENT))
    return counted.withColumn("priority", exponential_priority(seed, F.col(key), weight)).drop("_ns", "_np")


def weighted_sample(df: DataFrame, stratum: str, project: str, key: str, seed: int, quota: int, fraction: float | None = PROJECT_FRACTION) -> DataFrame:
    """``quota`` rows by priority; a project's rows beyond its cap come only after all others."""
    ranked = tempered_priority(df, stratum, project, key, seed)
    if fraction is None:
        return ranked.orderBy("priority", key).limit(quota)
    cap = max(1, -int(-quota * fraction // 1))
    k = F.row_number().over(Window.partitionBy(project).orderBy("priority", key))
    # a project's rows beyond the quota are never needed: dropped before they are shuffled
    return ranked.withColumn("_k", k).where(F.col("_k") <= quota).orderBy(F.col("_k") > cap, "priority", key).limit(quota).drop("_k")


def round_robin(df: DataFrame, bucket: str, key: str, seed: int, k: int | None = None) -> DataFrame:
    """Adds ``turn``: the rank of a row in its bucket; in order of (turn, bucket's hash) every bucket's k-th row comes before any's next.

    With ``k``, the first ``k`` in that order.
    """
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(derived_seed(seed, F.col(key)), key))
    ranked = df.withColumn("turn", turn).withColumn("bucket_rank", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(bucket).cast("string")), 256))
    return ranked if k is None else ranked.where(F.col("turn") <= k).orderBy("turn", "bucket_rank", key).limit(k)


def largest_remainder(counts: DataFrame, stratum: str, n: str, target: int, seed: int) -> DataFrame:
    """stratum, n, quota: ``target`` shared in proportion to ``n``, remainders to the largest fractions (ties by hash)."""
    total = counts.agg(F.sum(n).alias("_total"))
    exact = counts.crossJoin(F.broadcast(total)).withColumn("_exact", F.lit(target) * F.col(n) / F.col("_total"))  # one row of total
    floored = exact.withColumn("_floor", F.floor("_exact")).withColumn("_left", F.lit(target) - F.sum(F.floor("_exact")).over(Window.partitionBy()))
    order = Window.orderBy((F.col("_floor") - F.col("_exact")), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(stratum).cast("string")), 256))
    return floored.withColumn("quota", (F.col("_floor") + (F.row_number().over(order) <= F.col("_left")).cast("int")).cast("long")).select(stratum, n, "quota")


def proportional_sample(df: DataFrame, stratum: str, key: str, target: int, seed: int) -> DataFrame:
    quotas = largest_remainder(df.groupBy(stratum).agg(F.count("*").alias("n")), stratum, "n", target, seed).select(stratum, "quota")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(derived_seed(seed, F.col(key)), key))
    # no quota is above the target: what is beyond it is dropped before it is shuffled
    return df.withColumn("_n", rank).where(F.col("_n") <= target).join(quotas, stratum).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def stratified_split(df: DataFrame, stratum: str, key: str, train: int, validation: int, seed: int) -> DataFrame:
    """Adds ``split``: proportional quotas for train, then for validation of what is left; the rest is test."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    first = largest_remainder(counts, stratum, "n", train, seed).select(stratum, "n", F.col("quota").alias("n_train"))
    left = first.select(stratum, "n_train", (F.col("n") - F.col("n_train")).alias("left"))
    second = largest_remainder(left.select(stratum, "left"), stratum, "left", validation, seed + 1).select(stratum, F.col("quota").alias("n_validation"))
    joined = draw_rank(df, stratum, derived_seed(seed, F.col(key)), key, "_n").join(left.join(second, stratum), stratum)
    split = F.when(F.col("_n") <= F.col("n_train"), "train").when(F.col("_n") <= F.col("n_train") + F.col("n_validation"), "validation").otherwise("test")
    return joined.withColumn("split", split).select(*df.columns, "split")


def coverage_first(df: DataFrame, group: str, stratum: str, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows of each group: first one of each stratum, in the strata's order, then by hash."""
    draw = derived_seed(seed, F.col(key))
    first = df.withColumn("_cw", F.row_number().over(Window.partitionBy(group, stratum).orderBy(draw, key)))
    order = Window.partitionBy(group).orderBy(F.col("_cw") > 1, F.when(F.col("_cw") == 1, F.col(stratum)), draw, key)
    return first.withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= n).drop("_cw")


def quotas_met(df: DataFrame, by: list[str], quota: int) -> DataFrame:
    """Of each class: supply, taken (by ``quota``), short. A class is never filled from another."""
    supply = df.groupBy(*by).agg(F.count("*").alias("supply"))
    return supply.select(*by, "supply", F.least("supply", F.lit(quota).cast("long")).alias("taken"), F.greatest(F.lit(0).cast("long"), F.lit(quota) - F.col("supply")).alias("short"))


def required_quotas(df: DataFrame, by: list[str], quota: int) -> DataFrame:
    """As :func:`quotas_met`; a class that falls short fails the job, with its name and what it has."""
    name = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])
    short = F.raise_error(F.concat(F.lit("too few of "), name, F.lit(": "), F.col("supply").cast("string"), F.lit(f" of {quota}")))
    return quotas_met(df, by, quota).withColumn("taken", F.when(F.col("short") == 0, F.col("taken")).otherwise(short.cast("long")))


def contiguous_split(rank: Column, quotas: list[tuple[str, int]]) -> Column:
    """The name of the quota that a 1-based rank falls in; null beyond all."""
    out, edge, whens = F.lit(None).cast("string"), 0, []
    for name, n in quotas:
        edge += n
        whens.append((edge, name))
    for edge, name in reversed(whens):
        out = F.when(rank <= edge, name).otherwise(out)
    return out


def ranked(df: DataFrame, key: str, rank: str) -> DataFrame:
    """Adds the 1-based ``rank`` of each row by a ``key`` that is unique, however its values are spread."""
    return key_rank(df, [], key, rank)


def whole_pairs(df: DataFrame, group: str, label: str, key: str, seed: int, n: int) -> DataFrame:
    """Both sides (label 1 and 0) of the ``n`` groups with the lowest hash among those that have both."""
    sides = df.groupBy(group).agg(F.min(F.when(F.col(label) == 1, F.col(key))).alias("one"), F.min(F.when(F.col(label) == 0, F.col(key))).alias("zero")).where("one is not null and zero is not null")
    chosen = sides.orderBy(derived_seed(seed, F.col(group)), group).limit(n)
    return chosen.select(group, F.explode(F.array(F.struct(F.lit(1).alias(label), F.col("one").alias(key)), F.struct(F.lit(0).alias(label), F.col("zero").alias(key)))).alias("x")).select(group, f"x.{label}", f"x.{key}")


def top_values(df: DataFrame, value: str, ordinal: str, k: int) -> DataFrame:
    """The most frequent values, ties in first-seen order."""
    return df.groupBy(value).agg(F.count("*").alias("n"), F.min(ordinal).alias("_first")).orderBy(F.col("n").desc(), "_first").limit(k).drop("_first")


def limited(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first ``n`` rows; all of them if ``n`` is negative."""
    return df if n < 0 else df.orderBy(*order).limit(n)


# Greedy choices that depend on what was chosen before.


def category_round_robin(df: DataFrame, by: list[str], cell: str, stratum: str, project: str, key: str, seed: int, quota: int) -> DataFrame:
    """``quota`` rows of each class, cell by cell in turn, with a cap per project that a refill may exceed; none of a class with fewer rows.

    Frequencies are those inside the class, and each class has a seed of its own. Only rows that can be chosen
    reach the class's task: those of a cell and project up to the cap, and the first two quotas by priority.
    """
    own = derived_seed(seed, F.concat_ws(":", *[F.col(c).cast("string") for c in by]))
    ranked = tempered_priority(df, stratum, project, key, own, by).withColumn("cell_rank", derived_seed(own, F.col(cell)))
    narrow = ranked.select(*by, F.col(cell).alias("cell"), F.col(project).alias("project"), key, "priority", F.col("cell_rank").cast("string").alias("cell_rank"))
    cap = max(1, -int(-quota * PROJECT_FRACTION // 1))
    upto = lambda n, *keys: narrow.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", key))).where(F.col("_n") <= n).drop("_n")
    enough = narrow.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= quota).select(*by)
    narrow = upto(cap, *by, "cell", "project").union(upto(2 * quota, *by)).distinct().join(enough, by)

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["priority", key], kind="stable").reset_index(drop=True)
        order = sorted(pool.groupby("cell")["cell_rank"].first().items(), key=lambda x: (int(x[1]), x[0]))
        waiting: dict = {name: iter(pool.index[pool["cell"] == name]) for name, _ in order}
        per_project: dict = {}
        taken, put_off = [], []
        while waiting and len(taken) < quota:
            for name, _ in order:
                if name not in waiting or len(taken) == quota:
                    continue
                for row in waiting[name]:
                    owner = pool.at[row, "project"]
                    if per_project.get(owner, 0) < cap:
                        per_project[owner] = per_project.get(owner, 0) + 1
                        taken.append(row)
                        break
                    put_off.append(row)
                else:
                    del waiting[name]
        chosen = set(taken)
        rest = [row for row in pool.index if row not in chosen]
        return pool.loc[taken + rest[: quota - len(taken)]]

    return narrow.groupBy(*by).applyInPandas(choose, narrow.schema)


def capped_greedy(df: DataFrame, by: list[str], group: str, capped: str, key: str, seed: int, quota: int, per_capped: int) -> DataFrame:
    """``quota`` rows of each class in hash order: one of a group, ``per_capped`` of a capped value at most.

    Of a group and capped value only the first row can be chosen, so no other reaches the class's task.
    """
    first = F.row_number().over(Window.partitionBy(*by, group, capped).orderBy("draw", key))
    drawn = df.select(*by, group, capped, key, derived_seed(seed, F.col(key)).alias("draw")).withColumn("_n", first).where("_n = 1")
    narrow = drawn.drop("_n").withColumn("draw", F.col("draw").cast("string"))

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        groups, uses, taken = set(), {}, []
        for row in sorted(pool.index, key=lambda i: (int(pool.at[i, "draw"]), pool.at[i, key])):
            g, c = pool.at[row, group], pool.at[row, capped]
            if len(taken) < quota and g not in groups and uses.get(c, 0) < per_capped:
                groups.add(g)
                uses[c] = uses.get(c, 0) + 1
                taken.append(row)
        return pool.loc[taken]

    return narrow.groupBy(*by).applyInPandas(choose, narrow.schema)


def balanced_variants(df: DataFrame, key: str, variants: list[str], seed: int) -> DataFrame:
    """key, variant: in order of a whole-number key each gets the least used variant so far, ties by hash of (seed, key, variant).

    Least-used-first is a sequence of rounds that use every variant once: the place in the round follows from
    the key's rank alone, and inside a round each key takes what its hash likes best of what is left.
    """
    rounds = ranked(df.select(key).distinct(), key, "_r").groupBy(F.floor((F.col("_r") - 1) / len(variants)).alias("_round")).agg(F.array_sort(F.collect_list(key)).alias("_keys"))

    def deal(a: Column, k: Column) -> Column:
        liking = lambda v: F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), k.cast("string"), F.lit(":"), v), 256).alias("h"), v.alias("v"))
        best = F.array_min(F.transform(a["left"], liking))["v"]
        return F.struct(F.array_remove(a["left"], best).alias("left"), F.concat(a["out"], F.array(F.struct(k.alias("key"), best.alias("variant")))).alias("out"))

    kind = df.schema[key].dataType.simpleString()
    start = F.struct(F.array(*map(F.lit, variants)).alias("left"), F.array().cast(f"array<struct<key: {kind}, variant: string>>").alias("out"))
    dealt = rounds.select(F.explode(F.aggregate("_keys", start, deal, lambda a: a["out"])).alias("x"))
    return dealt.select(F.col("x.key").alias(key), "x.variant")


def _cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder; one of its own only where none is named, on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="shared-"))
    return df.checkpoint()


def unique_content_groups(df: DataFrame, group: str, content: str, order: str, pass_rows: int = 100_000) -> DataFrame:
    """Groups in order, each kept unless a kept group already has one of its contents; a null content clashes with none.

    ``df``: group, content, order (the same in all rows of a group). Groups that clash are decided in rounds over
    all of them: a group that comes first at each of its contents is kept, and those that share a content with it
    are out. The last ``pass_rows`` rows at most are decided by one pass in order. Each round decides at least the first group of
    everything that hangs together; a long chain, in which each group clashes with the next one only, takes a round for
    every other of its groups until that pass, which is the worst case.
    """
    narrow = df.select(group, content, order).distinct()

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = pd.concat([pd.DataFrame(columns=[group, content, order]), *batches])
        taken, out = set(), []
        for (_, g), rows in pool.groupby([order, group], sort=True):
            contents = set(rows[content])
            if not contents & taken:
                taken |= contents
                out.append(g)
        yield pd.DataFrame({group: out})

    # contents of one group only can't clash: such groups are kept at once, and only the others are decided
    shared = narrow.join(narrow.groupBy(content).agg(F.countDistinct(group).alias("_n")).where("_n > 1"), content).select(group).distinct()
    found = narrow.select(group).distinct().join(shared, group, "left_anti")
    left = narrow.where(F.col(content).isNotNull()).join(shared, group)
    place = F.struct(order, group)
    while left.limit(pass_rows + 1).count() > pass_rows:
        left = _cut(left)
        first = left.groupBy(content).agg(F.min(place).alias("_first"))
        winners = _cut(left.join(first, content).groupBy(group).agg(F.bool_and(place == F.col("_first")).alias("_wins")).where("_wins").select(group))
        taken = left.join(winners, group).select(content).distinct()
        found = found.unionAll(winners)
        left = left.join(left.join(taken, content).select(group).distinct(), group, "left_anti")
    kind = df.schema[group].dataType.simpleString()
    return found.unionAll(left.repartition(1).mapInPandas(keep, f"{group} {kind}"))
