"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Sources get weights in turn and share a budget of words; no target exceeds ``max_epochs`` times its source's
size, and what a capped source leaves is shared again by weight. A source's target is then taken as whole
repetitions of all its documents, and one more of the documents whose seeded hash is lowest, up to the
document at whose middle the target is reached.

The cut between taken and left documents is found without a global order: words are summed by source and
hash bin (``BINS`` of them), and only inside a bin are documents ranked, so a source with a third of all rows
spreads over all tasks.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source, the last in order;
rows with equal doc_id (or none) get equal hashes and are taken alike. A budget beyond what the caps allow
takes all caps. A very long text is one document, taken whole or not. An empty table gives an empty result. Other columns are ignored, or passed on unchanged by
:func:`mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.storage import join_checked, plain, stored, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 17
BINS = 4096

_WS = r"\x20\x09-\x0D"


def n_words(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: every word, with the white space around it, becomes one character."""
    c = F.col(text)
    return F.when(c.rlike(f"[^{_WS}]"), F.length(F.regexp_replace(c, f"[{_WS}]*+[^{_WS}]++[{_WS}]*+", "x"))).otherwise(0).cast("long")


def draw(seed: int = SEED) -> Column:
    """A 60-bit number that depends on the seed and doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key() -> Column:
    """Equal for equal sources, null ones too."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("source")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """key, source_size, target of each source; ``sizes``: key, source, size of each document.

    In ascending order of cap per weight, a source is capped if the level that the words left would reach
    in it and all after it is above its own cap; the rest share at the level of the first that isn't.
    """
    one = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = one.select("key", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).alias("weight"), (max_epochs * F.col("source_size")).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    everything = Window.partitionBy()
    left = F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", level).withColumn("open", F.col("level") < F.col("cap") / F.col("weight"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    return leveled.select("key", "source_size", F.when(F.col("open"), final * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix_plan(sizes: DataFrame, **rule) -> DataFrame:
    """key, source_size, target, whole, cut of each source: a document with draw u is taken whole + (u <= cut) times.

    ``sizes``: key, source, size, u of each document.
    """
    aims = targets(sizes, **rule).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    aims = stored(aims.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    filed = sizes.select("key", "u", "size", F.shiftright("u", 48).alias("bin"))
    bins = filed.groupBy("key", "bin").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = stored(bins.select("key", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bins")
    inside = Window.partitionBy("key", "bin").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = join_checked(filed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))), bins, ["key", "bin"])
    reached = F.col("base") + F.col("within") + F.col("size") / 2 <= F.col("extra")
    cuts = join_checked(ranked, aims.select("key", "extra"), "key").where(reached).groupBy("key").agg(F.max("u").alias("cut"))
    return aims.join(cuts, "key", "left").select("key", "source_size", "target", F.col("whole").cast("int").alias("whole"), F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"))


def repetitions() -> Column:
    return F.col("whole") + (F.col("u") <= F.col("cut")).cast("int")


def mix(docs: DataFrame, **rule) -> DataFrame:
    """doc_id, size, source_size, target, taken, repetitions of each row of ``docs``."""
    sizes = stored(plain(docs, "doc_id", "text", "source").select("doc_id", "source", source_key().alias("key"), n_words("text").alias("size"), draw().alias("u")), "sizes")
    planned = join_checked(sizes, stored(mix_plan(sizes, **rule), "plan"), "key")
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * repetitions()).alias("taken"), repetitions().alias("repetitions"))


def mixed_rows(docs: DataFrame, **rule) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it."""
    names = {x: x + "_" + "_".join(docs.columns) for x in ("key", "u", "times")}  # names that no column has
    keyed = docs.withColumn(names["key"], source_key()).withColumn(names["u"], draw())
    sizes = stored(keyed.select(F.col(names["key"]).alias("key"), "source", n_words("text").alias("size"), F.col(names["u"]).alias("u")), "sizes")
    plan = stored(mix_plan(sizes, **rule), "plan").select(F.col("key").alias(names["key"]), F.struct("whole", "cut").alias(names["times"]))
    joined = join_checked(keyed, plan, names["key"])
    times = F.col(names["times"])["whole"] + (F.col(names["u"]) <= F.col(names["times"])["cut"]).cast("int")
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(names["times"])).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::UBIGINT AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 2 * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS FIRST)),
t AS (
  SELECT *, CASE WHEN level < cap / weight::DOUBLE THEN (max(CASE WHEN level < cap / weight::DOUBLE THEN level END) OVER ()) * weight ELSE cap::DOUBLE END AS target FROM l),
a AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INTEGER ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, a.source_size, a.target, a.whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0
         <= a.target - a.whole * a.source_size AS reached
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
c AS (SELECT *, u <= max(CASE WHEN reached THEN u END) OVER (PARTITION BY source) AS more FROM r)
SELECT doc_id, size, source_size, target, (size * (whole + coalesce(more, false)::INTEGER))::BIGINT AS taken,
       (whole + coalesce(more, false)::INTEGER)::INTEGER AS repetitions
FROM c
"""
