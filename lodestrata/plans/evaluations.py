"""Queries: joins of gold and predictions, metrics and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import rates as R
from lodestrata.functions.structures import composite_score, overlap_scores
from lodestrata.functions.text import abnormal_length, repeats_lines, repeats_tokens
from lodestrata.operators import evaluation as E
from lodestrata.plans import cases as C
from lodestrata.plans.registry import SPACE, query, table

_RATES = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END, 6) AS precision,
 round(CASE WHEN positives > 0 THEN tp::DOUBLE / positives ELSE 0.0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + positives - tp > 0 THEN 2 * (tp / greatest(tp + fp, 1)::DOUBLE) * (tp / greatest(positives, 1)::DOUBLE) / nullif(tp / greatest(tp + fp, 1)::DOUBLE + tp / greatest(positives, 1)::DOUBLE, 0) ELSE 0.0 END, 6) AS f1,
 round(CASE WHEN negatives > 0 THEN fp::DOUBLE / negatives ELSE 0.0 END, 6) AS false_positive_rate,
 round(CASE WHEN n > 0 THEN abstained::DOUBLE / n ELSE 0.0 END, 4) AS abstention_rate"""
_COUNTS = """count(*) AS n, count(*) FILTER (is_positive) AS positives, count(*) FILTER (NOT is_positive) AS negatives,
 count(*) FILTER (is_positive AND decision) AS tp, count(*) FILTER (NOT is_positive AND decision) AS fp, count(*) FILTER (NOT is_positive AND NOT decision) AS tn,
 count(*) FILTER (is_positive) - count(*) FILTER (is_positive AND decision) AS fn, count(*) FILTER (decision IS NULL) AS abstained"""


@query(f"WITH {C.SQL}, m AS (SELECT {_COUNTS} FROM k) SELECT *, {_RATES} FROM m")
def confusion_matrix(spark, d):
    return E.confusion(C.cases(spark, d))


@query(f"WITH {C.SQL} SELECT doc_id, is_positive, missing, parsed, round(completeness, 4) AS completeness, risk, decision FROM k")
def prediction_cases(spark, d):
    return C.cases(spark, d).select("doc_id", "is_positive", "missing", "parsed", F.round("completeness", 4).alias("completeness"), "risk", "decision")


@query(
    f"""WITH {C.SQL}, x AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN g.doc_id IS NULL THEN 'extra' END AS side FROM g FULL JOIN p ON g.doc_id = p.doc_id)
SELECT count(*) FILTER (side = 'missing') AS n_missing, count(*) FILTER (side = 'extra') AS n_extra,
 array_to_string((list_sort(list(doc_id) FILTER (side = 'missing')))[1:20], ',') AS first_missing, array_to_string((list_sort(list(doc_id) FILTER (side = 'extra')))[1:20], ',') AS first_extra FROM x"""
)
def prediction_completeness(spark, d):
    return E.completeness_report(C.gold(spark, d), C.predictions(spark, d), "doc_id")


@query(
    f"""WITH {C.SQL} SELECT p.doc_id, g.doc_id IS NOT NULL AS known, CASE WHEN g.doc_id IS NULL THEN 0.0 ELSE
 round((CASE WHEN json_valid(raw_output) THEN 10.0 + 10.0 * (len(list_intersect(json_keys(raw_output), ['summary','behavior_explanation','risk_level','malware_like_behaviors','attack_mapping','recommendations','limitations'])) / 7.0)::DOUBLE ELSE 0.0 END)
 + CASE WHEN json_valid(raw_output) AND json_extract_string(raw_output, '$.risk_level') IS NOT NULL THEN 15.0 ELSE 0.0 END + 20.0
 + CASE WHEN json_valid(raw_output) AND coalesce(json_extract_string(raw_output, '$.risk_level') = CASE WHEN is_positive THEN 'high' ELSE 'low' END, false) THEN 15.0 ELSE 0.0 END, 4) END AS score
FROM p LEFT JOIN g USING (doc_id)"""
)
def composite_scores(spark, d):
    from lodestrata.functions.structures import completeness, is_json_object

    joined = C.predictions(spark, d).join(C.gold(spark, d), "doc_id", "left")
    parsed = is_json_object(F.col("raw_output"))
    risk = F.when(parsed, F.get_json_object("raw_output", "$.risk_level"))
    match = F.coalesce(risk == F.when(F.col("is_positive"), "high").otherwise("low"), F.lit(False))
    score = composite_score(parsed, risk.isNotNull(), completeness(F.col("raw_output")), F.lit(True), match, F.lit(0.0), F.lit(False))
    known = F.col("is_positive").isNotNull()
    return joined.select("doc_id", known.alias("known"), F.when(known, score).otherwise(0.0).alias("score"))


@query(f"WITH {C.SQL} SELECT count(*) AS n, round(avg(latency_ms), 4) AS mean_latency_ms, round(avg(parsed::INTEGER), 4) AS parse_rate, CASE WHEN min(m) = max(m) THEN min(m) ELSE 'mixed' END AS model_id FROM (SELECT k.*, 'm1' AS m FROM k)")
def rates_and_latency(spark, d):
    return C.cases(spark, d).withColumn("m", F.lit("m1")).agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"), R.rate(F.col("parsed")).alias("parse_rate"), E.one_or_mixed("m").alias("model_id"))


@query(
    f"""WITH {C.SQL}, o AS (SELECT latency_ms AS x, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM p WHERE latency_ms IS NOT NULL)
SELECT max(n) AS n, max(x) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50_nearest, max(x) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95_nearest, max(x) FILTER (i = floor((n - 1) * 0.95)) AS p95_floor,
 max(x) FILTER (i = least(n - 1, floor(n * 0.95))) AS p95_capped FROM o"""
)
def latency_percentiles(spark, d):
    return E.percentiles(C.predictions(spark, d), "latency_ms", {"p50_nearest": (0.5, "nearest"), "p95_nearest": (0.95, "nearest"), "p95_floor": (0.95, "floor"), "p95_capped": (0.95, "capped")})


@query("SELECT count(*) AS n, median(n_chars)::DOUBLE AS median_chars FROM documents")
def true_median(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.median("n_chars").alias("median_chars"))


@query(f"WITH {C.SCORED}, r AS (SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS mr FROM s) SELECT count(*) AS n, sum(label)::BIGINT AS positives, round((sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))::DOUBLE, 6) AS roc_auc FROM r")
def roc_auc(spark, d):
    return E.roc_auc(C.scored(spark, d), "score", "label")


@query(f"WITH {C.SCORED}, r AS (SELECT label, row_number() OVER o AS k, sum(label) OVER (o ROWS UNBOUNDED PRECEDING) AS h FROM s WINDOW o AS (ORDER BY score DESC, event_id)) SELECT round(sum(h::DOUBLE / k) FILTER (label = 1) / count(*) FILTER (label = 1), 6) AS average_precision FROM r")
def average_precision(spark, d):
    return E.average_precision(C.scored(spark, d), "score", "label", "event_id")


@query(
    f"""WITH {C.SCORED}, b AS (SELECT score, count(*) AS n, sum(label) AS pos FROM s GROUP BY score), t AS (SELECT sum(pos) AS p, sum(n) - sum(pos) AS q FROM b),
u AS (SELECT score, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp FROM b WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) UNION ALL SELECT max(score) + 1e-12, 0, 0 FROM b),
v AS (SELECT score, tp / p::DOUBLE AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, fp / q::DOUBLE AS fpr FROM u, t)
SELECT round(score, 6) AS threshold, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fpr, 6) AS false_positive_rate FROM v WHERE fpr <= 0.05 ORDER BY v.recall DESC, v.precision DESC, fpr, score DESC LIMIT 1"""
)
def threshold_at_fpr(spark, d):
    return E.threshold_at_fpr(C.scored(spark, d), "score", "label", 0.05)


@query(f"WITH {C.SCORED}, k AS (SELECT label = 1 AS is_positive, score >= 0.4 AS decision FROM s), m AS (SELECT {_COUNTS} FROM k) SELECT *, {_RATES} FROM m")
def threshold_metrics(spark, d):
    return E.threshold_metrics(C.scored(spark, d), "score", "label", 0.4)


@query(
    f"""WITH {C.SCORED}, k AS (SELECT day, label = 1 AS is_positive, score >= 0.4 AS decision FROM s), m AS (SELECT day, {_COUNTS} FROM k GROUP BY day), r AS (SELECT *, {_RATES} FROM m)
SELECT count(*) AS n_days, min(recall) AS min_recall, max(false_positive_rate) AS max_fpr FROM r"""
)
def temporal_stability(spark, d):
    return E.threshold_metrics(C.scored(spark, d), "score", "label", 0.4, ["day"]).agg(F.count("*").alias("n_days"), F.min("recall").alias("min_recall"), F.max("false_positive_rate").alias("max_fpr"))


_SETS = """x AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS ws, role FROM conversations),
y AS (SELECT conv_id, list_distinct(flatten(list(ws) FILTER (role = 'user'))) AS e, list_distinct(flatten(list(ws) FILTER (role = 'assistant'))) AS a FROM x GROUP BY conv_id),
z AS (SELECT conv_id, coalesce(e, []) AS e, coalesce(a, []) AS a FROM y)"""


def _word_sets(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))
    return table(spark, d, "conversations").select("conv_id", "role", words.alias("ws")).groupBy("conv_id").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == "user", F.col("ws"))))).alias("e"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == "assistant", F.col("ws"))))).alias("a")
    )


@query(
    f"""WITH {_SETS}, t AS (SELECT sum(len(list_intersect(e, a))) AS b, sum(len(e)) AS ne, sum(len(a)) AS na FROM z), q AS (SELECT b / na::DOUBLE AS p, b / ne::DOUBLE AS r FROM t)
SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM q"""
)
def evidence_micro_scores(spark, d):
    return E.set_scores(_word_sets(spark, d), F.col("e"), F.col("a"))


@query(
    f"""WITH {_SETS}, q AS (SELECT *, CASE WHEN len(e) = 0 AND len(a) = 0 THEN 1.0 WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(e, a)) / len(a)::DOUBLE END::DOUBLE AS p,
 CASE WHEN len(e) = 0 AND len(a) = 0 THEN 1.0 WHEN len(a) = 0 OR len(e) = 0 THEN 0.0 ELSE len(list_intersect(e, a)) / len(e)::DOUBLE END::DOUBLE AS r, CASE WHEN len(a) = 0 THEN 0 ELSE len(a) - len(list_intersect(e, a)) END AS h FROM z)
SELECT round(avg(round(p, 4)), 4) AS precision, round(avg(round(r, 4)), 4) AS recall, round(avg(round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 4)), 4) AS f1, sum(h)::BIGINT AS hallucinated FROM q"""
)
def attack_macro_scores(spark, d):
    s = overlap_scores(F.col("e"), F.col("a"))
    return _word_sets(spark, d).select(*[v.alias(k) for k, v in s.items()]).agg(*[F.round(F.avg(F.round(k, 4)), 4).alias(k) for k in ("precision", "recall", "f1")], F.sum("hallucinated").alias("hallucinated"))


@query(
    f"""WITH {C.SCORED}, a AS (SELECT user_id, count(*) AS n, min((score >= 0.4)::INTEGER) AS lo, max((score >= 0.4)::INTEGER) AS hi FROM s WHERE score < 0.45 GROUP BY user_id HAVING count(*) >= 2)
SELECT count(*) AS n_groups, count(*) FILTER (lo = hi) AS n_consistent, round(avg((lo = hi)::INTEGER), 4) AS consistency_rate FROM a"""
)
def group_consistency(spark, d):
    return E.consistency(C.scored(spark, d).where("score < 0.45").select("user_id", (F.col("score") >= 0.4).cast("int").alias("answer")), "user_id", "answer")


@query(
    f"""WITH {C.SQL} SELECT a.doc_id, a.latency_ms + b.latency_ms AS total_latency_ms FROM p a JOIN p b ON a.doc_id + 1 = b.doc_id WHERE a.latency_ms IS NOT NULL AND b.latency_ms IS NOT NULL"""
)
def two_stage_latency(spark, d):
    p = C.predictions(spark, d)
    second = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("latency_ms").alias("second_ms"))
    return p.join(second, "doc_id").where("latency_ms is not null and second_ms is not null").select("doc_id", (F.col("latency_ms") + F.col("second_ms")).alias("total_latency_ms"))


#: Line ends, as SQL has them.
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_ODD = ["\n\n", "\t", "\xa0\u2028", "words that are repeated,\xa0 all\r" * 4, "words\tthat are repeated, all\u2028words that are repeated, all\r\n" * 2, "words that are repeated, al\x1f" * 4, "w" * 32768 + "\u3000", "w" * 32769]


@query(
    rf"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - n_nationkey, [{", ".join("'" + x.replace("w" * 32768, f"' || repeat('w', 32768) || '") + "'" for x in _ODD)}][1 + n_nationkey % {len(_ODD)}] FROM nation),
l AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '{_ENDS}')), '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS line FROM t),
r AS (SELECT DISTINCT doc_id FROM l WHERE length(line) >= 24 GROUP BY doc_id, line HAVING count(*) >= 4), s AS (SELECT doc_id, length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) AS n FROM t)
SELECT s.doc_id, r.doc_id IS NOT NULL AS repeats_lines, n = 0 OR n > 32768 AS abnormal_length FROM s LEFT JOIN r USING (doc_id)"""
)
def output_discipline(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    k = F.col("n_nationkey").cast("long")  # beside all documents, some rows for each stated case
    odd = table(spark, d, "nation").select((-1 - k).alias("doc_id"), F.element_at(F.array(*map(F.lit, _ODD)), (k % len(_ODD) + 1).cast("int")).alias("text"))
    return docs.unionAll(odd).select("doc_id", repeats_lines(F.col("text")).alias("repeats_lines"), abnormal_length(F.col("text")).alias("abnormal_length"))



@query(
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s]+'), lambda x: x != '') AS t FROM documents),
e AS (SELECT doc_id, array_to_string(list_transform(range(1, len(t) - 7), lambda i: CASE WHEN t[i] = t[i + 8] THEN '1' ELSE '0' END), '') AS s8,
 array_to_string(list_transform(range(1, len(t) - 15), lambda i: CASE WHEN t[i] = t[i + 16] THEN '1' ELSE '0' END), '') AS s16,
 array_to_string(list_transform(range(1, len(t) - 31), lambda i: CASE WHEN t[i] = t[i + 32] THEN '1' ELSE '0' END), '') AS s32 FROM t)
SELECT doc_id, contains(s8, repeat('1', 24)) OR contains(s16, repeat('1', 48)) OR contains(s32, repeat('1', 96)) AS repeats_tokens FROM e"""
)
def token_window_repetition(spark, d):
    return table(spark, d, "documents").select("doc_id", repeats_tokens(F.col("text")).alias("repeats_tokens"))
