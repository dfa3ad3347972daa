"""Gold and predictions made of the supplied tables by hash, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.hashing import derived_seed
from lodestrata.functions.structures import completeness, decision, is_json_object
from lodestrata.plans.registry import table


def draw(seed: int, key: str = "doc_id", modulus: int = 100):
    return (derived_seed(seed, F.col(key)) % modulus).cast("int")


def sql_draw(seed: int, key: str = "doc_id", modulus: int = 100) -> str:
    return f"((('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::UBIGINT % {modulus})::INTEGER)"


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_positive"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, raw_output, latency_ms, model_id of 95 % of the labelled documents and some others."""
    base = table(spark, d, "documents").select("doc_id", draw(7).alias("u"), draw(8).alias("v")).where("u >= 5")
    risk = F.when(F.col("v") < 20, "high").when(F.col("v") < 90, "low").otherwise("medium")
    full = F.concat(F.lit('{"risk_level":"'), risk, F.lit('","summary":"s","limitations":["l"],"attack_mapping":[]}'))
    raw = F.when(F.col("u") < 8, "not json").when(F.col("u") < 11, '{"summary":"x"} tail').when(F.col("u") < 14, '{"summary":"x"}').otherwise(full)
    return base.select("doc_id", raw.alias("raw_output"), F.when(F.col("u") % 10 != 0, (F.col("v") * 7 % 50 + 100).cast("double")).alias("latency_ms"), F.lit("m1").alias("model_id"))


SQL = f"""
g AS (SELECT doc_id, toxic = 1 AS is_positive FROM labels),
p0 AS (SELECT doc_id, {sql_draw(7)} AS u, {sql_draw(8)} AS v FROM documents),
p AS (SELECT doc_id, CASE WHEN u < 8 THEN 'not json' WHEN u < 11 THEN '{{"summary":"x"}} tail' WHEN u < 14 THEN '{{"summary":"x"}}'
        ELSE '{{"risk_level":"' || CASE WHEN v < 20 THEN 'high' WHEN v < 90 THEN 'low' ELSE 'medium' END || '","summary":"s","limitations":["l"],"attack_mapping":[]}}' END AS raw_output,
        CASE WHEN u % 10 != 0 THEN (v * 7 % 50 + 100)::DOUBLE END AS latency_ms, 'm1' AS model_id FROM p0 WHERE u >= 5),
j AS (SELECT g.*, p.raw_output, p.latency_ms, p.doc_id IS NULL AS missing, coalesce(json_valid(p.raw_output), false) AS parsed FROM g LEFT JOIN p USING (doc_id)),
c AS (SELECT *, CASE WHEN parsed THEN len(list_intersect(json_keys(raw_output), ['summary','behavior_explanation','risk_level','malware_like_behaviors','attack_mapping','recommendations','limitations'])) / 7.0 ELSE 0.0 END::DOUBLE AS completeness,
        CASE WHEN parsed THEN json_extract_string(raw_output, '$.risk_level') END AS risk FROM j),
k AS (SELECT *, CASE WHEN risk IN ('high', 'critical') THEN true WHEN risk = 'low' THEN false END AS decision FROM c)
"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Gold joined with predictions: missing, parsed, completeness, risk, decision."""
    from lodestrata.operators.evaluation import join_predictions

    joined = join_predictions(gold(spark, d), predictions(spark, d), "doc_id")
    parsed = is_json_object(F.col("raw_output"))
    judged = joined.withColumn("parsed", parsed).withColumn("completeness", completeness(F.col("raw_output")))
    judged = judged.withColumn("risk", F.when(F.col("parsed"), F.get_json_object("raw_output", "$.risk_level")))
    return judged.withColumn("decision", decision(F.col("risk"), F.col("parsed")))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """event_id, day, score, label: observations with a score and a day as their partition."""
    e = table(spark, d, "events")
    score = ((derived_seed(9, F.col("event_id")) % 1000).cast("int") + F.when(F.col("event_type") == "error", 600).otherwise(0)) / 2000
    return e.select("event_id", F.dayofmonth("ts").cast("int").alias("day"), score.alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), "user_id")


SCORED = """
s AS (SELECT event_id, dayofmonth(ts)::INTEGER AS day, user_id, (event_type = 'error')::INTEGER AS label,
        ((('0x' || substr(sha256('9:' || event_id), 1, 16))::UBIGINT % 1000)::INTEGER + CASE WHEN event_type = 'error' THEN 600 ELSE 0 END) / 2000.0::DOUBLE AS score FROM events)
"""
