"""Queries: the pass or fail contracts. Each SQL twin states its contract's limits itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestrata.functions import rates as R
from lodestrata.functions import text as T
from lodestrata.operators import evaluation as E
from lodestrata.plans import cases as C
from lodestrata.plans.evaluations import _COUNTS, _RATES
from lodestrata.plans.registry import query, table


def _checked(limits: str) -> str:
    """SQL columns passed and failed_checks of ``name<=x``, ``name>=x`` and ``name`` (must hold), blank-separated."""
    checks = []
    for x in limits.split():
        name = x.split("<=")[0].split(">=")[0]
        checks.append(f"CASE WHEN NOT coalesce({x}, false) THEN '{name}' END")
    failed = f"list_sort(list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL))"
    return f"len({failed}) = 0 AS passed, array_to_string({failed}, ',') AS failed_checks"


# Assessments of labelled documents, made by hash: a twentieth unusable in each of several ways, the rest right in nine of ten cases.
_FULL = """'{"assessment":"' || a || '","basis":"' || CASE WHEN u BETWEEN 6 AND 7 THEN 'a step-by-step guide' WHEN u BETWEEN 8 AND 9 THEN chr(160) ELSE 'what the lines show' END || '","evidence":[' || (k + v % 3) || ',' || (k + 1) || ']' || CASE WHEN u BETWEEN 10 AND 11 THEN ',"notes":[' || repeat(chr(10) || '"the same words over and over again",' || chr(13), 4) || '""]' ELSE '' END || '}'"""
_ASSESSED = f"""ga AS (SELECT doc_id, toxic = 1 AS is_positive, [(doc_id % 7 + 1)::INTEGER, (doc_id % 7 + 2)::INTEGER] AS gold_lines FROM labels),
pa AS (SELECT doc_id, CASE WHEN u < 4 THEN 'not json' WHEN u < 6 THEN '{{"assessment":"maybe","basis":"b","evidence":[1]}}' ELSE {_FULL} END AS raw_output, a, u, v, k FROM (
 SELECT d.doc_id, {C.sql_draw(61, 'd.doc_id')} AS u, {C.sql_draw(62, 'd.doc_id')} AS v, (d.doc_id % 7 + 1)::INTEGER AS k,
  CASE WHEN {C.sql_draw(61, 'd.doc_id')} BETWEEN 12 AND 13 THEN 'uncertain' WHEN (coalesce(l.toxic, 0) = 1) = ({C.sql_draw(62, 'd.doc_id')} < 90) THEN 'present' ELSE 'not_observed' END AS a
 FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE u >= 2 AND (u >= 3 OR v >= 50)),
ka AS (SELECT g.*, p.doc_id IS NULL AS missing, coalesce(p.u >= 4, false) AS parsed, coalesce(p.u >= 6 AND p.u NOT IN (8, 9), false) AS schema_ok, coalesce(p.u >= 4 AND p.u NOT IN (6, 7), false) AS safe,
  coalesce(p.u IN (10, 11), false) AS repeats, false AS abnormal, CASE WHEN p.u >= 6 AND p.u NOT IN (8, 9) THEN p.a END AS assessment, list_distinct([p.k + p.v % 3, p.k + 1]) AS lines, p.k, p.v
 FROM ga g LEFT JOIN pa p USING (doc_id)),
kb AS (SELECT *, CASE assessment WHEN 'present' THEN true WHEN 'not_observed' THEN false END AS decision, schema_ok AND k + v % 3 BETWEEN 1 AND 9 AND k + 1 <= 9 AS renders,
  CASE WHEN schema_ok THEN len(lines) ELSE 0 END AS n_predicted, 2 AS n_gold, CASE WHEN schema_ok THEN len(list_intersect(lines, gold_lines)) ELSE 0 END AS n_shared FROM ka),
kc AS (SELECT {_COUNTS}, round(avg(parsed::INTEGER), 4) AS parse_rate, round(avg(schema_ok::INTEGER), 4) AS schema_rate, round(avg(safe::INTEGER), 4) AS safety_rate, round(avg(schema_ok::INTEGER), 4) AS evidence_rate,
  round(avg(repeats::INTEGER), 4) AS repetition_rate, round(avg(abnormal::INTEGER), 4) AS abnormal_length_rate, round(avg(renders::INTEGER), 4) AS renderer_rate, count(*) FILTER (missing) AS n_missing,
  round(sum(n_shared) / sum(n_predicted)::DOUBLE, 4) AS evidence_precision, round(sum(n_shared) / sum(n_gold)::DOUBLE, 4) AS evidence_recall,
  (SELECT count(*) FROM pa WHERE doc_id NOT IN (SELECT doc_id FROM ga)) AS n_extra FROM kb),
kd AS (SELECT *, {_RATES}, n_missing = 0 AND n_extra = 0 AS complete, tp + fp > 0 AND tn + fn > 0 AS both_answered, positives > 0 AND negatives > 0 AS both_labels FROM kc)"""


def _gold(spark, d):
    k = (F.col("doc_id") % 7 + 1).cast("int")
    return table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_positive"), F.array(k, k + 1).alias("gold_lines"))


def _predictions(spark, d):
    rows = table(spark, d, "documents").select("doc_id", C.draw(61).alias("u"), C.draw(62).alias("v")).join(table(spark, d, "labels").select("doc_id", F.col("toxic").alias("t")), "doc_id", "left")
    u, v, k = F.col("u"), F.col("v"), (F.col("doc_id") % 7 + 1).cast("int")
    rows = rows.where((u >= 2) & ((u >= 3) | (v >= 50)))
    told = F.when(u.between(12, 13), "uncertain").when((F.coalesce("t", F.lit(0)) == 1) == (v < 90), "present").otherwise("not_observed")
    basis = F.when(u.between(6, 7), "a step-by-step guide").when(u.between(8, 9), "\xa0").otherwise("what the lines show")
    notes = F.when(u.between(10, 11), ',"notes":[' + '\n"the same words over and over again",\r' * 4 + '""]').otherwise("")
    full = F.concat(F.lit('{"assessment":"'), told, F.lit('","basis":"'), basis, F.lit('","evidence":['), (k + v % 3).cast("string"), F.lit(","), (k + 1).cast("string"), F.lit("]"), notes, F.lit("}"))
    return rows.select("doc_id", F.when(u < 4, "not json").when(u < 6, '{"assessment":"maybe","basis":"b","evidence":[1]}').otherwise(full).alias("raw_output"))


def _judged(spark, d):
    return E.judged(E.join_predictions(_gold(spark, d), _predictions(spark, d), "doc_id").withColumn("n_lines", F.lit(9)))


def _metrics(spark, d, group=False):
    cases = _judged(spark, d)
    if group:
        cases = cases.withColumn("g", F.concat(F.floor(F.col("doc_id") / 20).cast("string"), F.when(F.col("is_positive"), "+").otherwise("-")))
    return E.contract_metrics(cases, E.extra_predictions(_gold(spark, d), _predictions(spark, d), "doc_id"), "g" if group else None)


@query(f"WITH {_ASSESSED} SELECT doc_id, is_positive, missing, parsed, schema_ok, safe, schema_ok AS has_evidence, repeats, abnormal, assessment, decision, renders, n_predicted::INTEGER AS n_predicted, n_gold, n_shared::INTEGER AS n_shared FROM kb")
def judged_cases(spark, d):
    return _judged(spark, d).drop("raw_output", "gold_lines", "n_lines")


@query(f"WITH {_ASSESSED} SELECT *, {_checked('n>=200 complete both_answered precision>=0.9 recall>=0.95 false_positive_rate<=0.05 abstention_rate<=0.05 parse_rate>=0.99 schema_rate>=0.99 safety_rate>=1.0 evidence_rate>=0.9 repetition_rate<=0.01 abnormal_length_rate<=0.01')} FROM kd")
def source_gate(spark, d):
    return E.gate(_metrics(spark, d), "source")


@query(f"WITH {_ASSESSED} SELECT *, {_checked('n>=20 complete both_answered precision>=0.75 recall>=0.75 false_positive_rate<=0.2 abstention_rate<=0.1 parse_rate>=0.99 schema_rate>=0.99 safety_rate>=1.0 evidence_rate>=0.0 repetition_rate<=0.01 abnormal_length_rate<=0.01')} FROM kd")
def source_diagnostic_gate(spark, d):
    return E.gate(_metrics(spark, d), "source_diagnostic")


@query(
    f"""WITH {_ASSESSED}, kg AS (SELECT doc_id // 20 AS g, is_positive, min(assessment) AS lo, max(assessment) AS hi FROM kb WHERE assessment IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
ke AS (SELECT kd.*, (SELECT round(coalesce(avg((lo = hi)::INTEGER), 0.0), 4) FROM kg) AS consistency_rate FROM kd)
SELECT *, {_checked('n>=200 complete precision>=0.9 recall>=0.95 false_positive_rate<=0.05 abstention_rate<=0.05 parse_rate>=0.99 schema_rate>=0.99 evidence_rate>=0.9 consistency_rate>=0.95')} FROM ke"""
)
def binary_gate(spark, d):
    return E.gate(_metrics(spark, d, group=True), "binary")


@query(f"WITH {_ASSESSED} SELECT *, {_checked('n>=20 complete both_answered precision>=0.75 recall>=0.75 false_positive_rate<=0.2 abstention_rate<=0.1 parse_rate>=0.99 schema_rate>=0.99')} FROM kd")
def decision_gate(spark, d):
    return E.gate(_metrics(spark, d), "decision")


@query(f"WITH {_ASSESSED} SELECT *, {_checked('n>=100 complete both_labels precision>=0.75 recall>=0.75 false_positive_rate<=0.2 abstention_rate<=0.1 parse_rate>=0.99 schema_rate>=0.99 evidence_precision>=0.5 evidence_recall>=0.5 renderer_rate>=1.0')} FROM kd")
def compact_gate(spark, d):
    return E.gate(_metrics(spark, d), "compact")


_LINES = "n>=100 complete parse_rate>=0.99 schema_rate>=0.99 evidence_precision>=0.5 evidence_recall>=0.5 renderer_rate>=1.0"


@query(f"WITH {_ASSESSED} SELECT *, {_checked(_LINES)} FROM kd")
def evidence_lines_gate(spark, d):
    return E.gate(_metrics(spark, d), "evidence_lines")


_DECIDES = "n>=100 complete both_answered precision>=0.9 recall>=0.95 false_positive_rate<=0.05 abstention_rate<=0.05 parse_rate>=0.99 schema_rate>=0.99"


@query(
    f"""WITH {_ASSESSED}, d1 AS (SELECT {_checked(_DECIDES)} FROM kd), d2 AS (SELECT {_checked(_LINES)} FROM kd)
SELECT d1.passed AS decision_passed, d1.failed_checks AS decision_failed, d2.passed AS evidence_passed, d2.failed_checks AS evidence_failed, d1.passed AND d2.passed AS passed FROM d1, d2"""
)
def two_stage_gate(spark, d):
    m = _metrics(spark, d)
    sides = [E.gate(m, f"two_stage_{x}").select(F.col("passed").alias(f"{x}_passed"), F.col("failed_checks").alias(f"{x}_failed")) for x in ("decision", "evidence")]
    return sides[0].crossJoin(sides[1]).withColumn("passed", F.col("decision_passed") & F.col("evidence_passed"))  # one row each


@query(
    f"""WITH {C.SQL}, m AS (SELECT {_COUNTS}, coalesce(round(avg(parsed::INTEGER), 4), 0.0) AS parse_rate, coalesce(round(avg((risk IS NOT NULL)::INTEGER), 4), 0.0) AS schema_rate, round(avg(parsed::INTEGER), 4) AS safety_rate,
 round(avg((parsed AND coalesce(TRY(json_array_length(raw_output, '$.limitations')), 0) > 0)::INTEGER), 4) AS evidence_rate, count(*) FILTER (missing) AS n_missing, (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM g)) AS n_extra FROM k),
r AS (SELECT *, {_RATES}, n_missing = 0 AND n_extra = 0 AS complete FROM m)
SELECT *, {_checked('n>=200 complete precision>=0.9 recall>=0.95 false_positive_rate<=0.05 abstention_rate<=0.05 parse_rate>=0.99 schema_rate>=0.99 safety_rate>=1.0 evidence_rate>=0.9')} FROM r"""
)
def absolute_gate(spark, d):
    cases = C.cases(spark, d)
    safe = F.col("parsed") & ~F.coalesce(T.any_match(F.col("raw_output"), T.UNSAFE_GUIDANCE), F.lit(False))
    evidence = F.col("parsed") & F.coalesce(F.json_array_length(F.get_json_object("raw_output", "$.limitations")) > 0, F.lit(False))
    rates = {"parse_rate": F.col("parsed"), "schema_rate": F.col("risk").isNotNull(), "safety_rate": safe, "evidence_rate": evidence}
    extra = cases.agg(*[R.rate(x).alias(k) for k, x in rates.items()], F.count_if("missing").alias("n_missing"))
    metrics = E.confusion(cases).crossJoin(extra).crossJoin(E.extra_predictions(C.gold(spark, d), C.predictions(spark, d), "doc_id"))  # one row each
    return E.gate(metrics.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_extra") == 0)), "absolute")


@query(
    f"""WITH {C.SCORED}, q AS (SELECT event_id, score FROM s WHERE event_id % 97 != 0 UNION ALL SELECT -1, 0.5), x AS (SELECT s.* FROM s JOIN q USING (event_id)), k AS (SELECT day, label = 1 AS is_positive, score >= 0.4 AS decision FROM x),
m AS (SELECT {_COUNTS} FROM k), a AS (SELECT *, {_RATES} FROM m), wk AS (SELECT day, {_COUNTS} FROM k GROUP BY day), w AS (SELECT *, {_RATES} FROM wk),
r AS (SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS mr FROM x), o AS (SELECT label, row_number() OVER z AS i, sum(label) OVER (z ROWS UNBOUNDED PRECEDING) AS h FROM x WINDOW z AS (ORDER BY score DESC, event_id)),
f AS (SELECT a.*, (SELECT round((sum(mr) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))::DOUBLE, 6) FROM r) AS roc_auc,
 (SELECT round(sum(h::DOUBLE / i) FILTER (label = 1) / count(*) FILTER (label = 1), 6) FROM o) AS average_precision, (SELECT min(recall) FROM w) AS min_recall, (SELECT max(false_positive_rate) FROM w) AS max_fpr,
 (SELECT count(*) FROM s WHERE event_id NOT IN (SELECT event_id FROM q)) AS n_missing, (SELECT count(*) FROM q WHERE event_id NOT IN (SELECT event_id FROM s)) AS n_extra FROM a)
SELECT *, {_checked('complete precision>=0.3 recall>=0.9 false_positive_rate<=0.05 roc_auc>=0.9 average_precision>=0.9 min_recall>=0.5 max_fpr<=0.4')} FROM (SELECT *, n_missing = 0 AND n_extra = 0 AS complete FROM f)"""
)
def classifier_gate(spark, d):
    gold = C.scored(spark, d)
    given = gold.where("event_id % 97 != 0").select("event_id", "score").unionAll(spark.createDataFrame([(-1, 0.5)], "event_id long, score double"))
    limits = {"precision": 0.3, "recall": 0.9, "false_positive_rate": 0.05, "roc_auc": 0.9, "average_precision": 0.9, "min_recall": 0.5, "max_fpr": 0.4}
    return E.classifier_gate(gold.drop("score"), given, "event_id", "score", "label", "day", 0.4, "calibration", limits)


@query(
    f"""WITH t AS (SELECT sha256(text) AS target, CASE WHEN toxic = 1 THEN 'present' ELSE 'not_observed' END AS label, length(text) > 0 AS schema_ok, regexp_matches(text, '\\b(?:train|validation|test)\\s+split\\b', 'i') AS leaked, len(string_split(text, chr(10))) > 1 AS linked,
 length(text) < 40 AS generic, regexp_matches(text, '{'|'.join(T.GLOBAL_SAFETY_CLAIMS)}', 'i') AS claim, length(text) // 4 > 4096 AS over_cutoff, length(text) // 4 > 2048 AS over_budget FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) AS c FROM t GROUP BY target),
m AS (SELECT count(*) AS n, round(avg(schema_ok::INTEGER), 4) AS schema_rate, round(avg(linked::INTEGER) FILTER (label = 'present'), 4) AS link_rate, count(*) FILTER (leaked) AS n_leaks, count(*) FILTER (generic) AS n_generic, count(*) FILTER (claim) AS n_safety_claims,
 count(*) FILTER (over_cutoff) AS n_over_cutoff, count(*) FILTER (over_budget) AS n_over_budget, count(*) FILTER (label = 'present') AS n_present, count(*) FILTER (label = 'not_observed') AS n_not_observed FROM t),
a AS (SELECT m.*, (SELECT round(sum(c - 1)::DOUBLE / sum(c), 6) FROM c) AS exact_duplicate_rate, (SELECT round(max(c)::DOUBLE / sum(c), 6) FROM c) AS single_target_rate FROM m),
f AS (SELECT *, {_checked('n>=1 schema_rate>=1.0 n_leaks<=0 link_rate>=0.95 n_generic<=0 exact_duplicate_rate<=0.05 single_target_rate<=0.02 n_safety_claims<=0 n_over_cutoff<=0 n_over_budget<=0')} FROM a)
SELECT * EXCLUDE (passed), passed AND n_present >= 20 AND n_not_observed >= 100 AS automated_pass, CASE WHEN n_present < 20 OR n_not_observed < 100 THEN 'evidence_supply_blocked' WHEN passed THEN 'manual_review_required' ELSE 'automated_quality_gate_failed' END AS status, false AS overall_pass FROM f"""
)
def target_audit_gate(spark, d):
    text = F.col("text")
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    tokens = F.floor(F.length(text) / 4)
    targets = rows.select(
        F.sha2(text, 256).alias("target"), F.when(F.col("toxic") == 1, "present").otherwise("not_observed").alias("label"), (F.length(text) > 0).alias("schema_ok"), text.rlike(T.LEAKAGE["split"]).alias("leaked"),
        (F.size(F.split(text, "\n")) > 1).alias("linked"), (F.length(text) < 40).alias("generic"), T.any_match(text, T.GLOBAL_SAFETY_CLAIMS).alias("claim"), (tokens > 4096).alias("over_cutoff"), (tokens > 2048).alias("over_budget"),
    )
    return E.target_audit(targets, {"present": 20, "not_observed": 100})


_VARIED = f"""v AS (SELECT doc_id, toxic = 1 AS is_positive, {C.sql_draw(65, 'doc_id')} AS u, t.name FROM labels, (VALUES ('clean'), ('varied')) t(name)),
r AS (SELECT name, count(*) AS n, round(avg(CASE WHEN name = 'varied' AND is_positive THEN 0.0 ELSE 1.0 END), 4) AS evidence_rate, round(avg(CASE WHEN name = 'varied' AND u < 3 THEN 1.0 ELSE 0.0 END), 4) AS abnormal_length_rate,
  round(avg(CASE WHEN name = 'varied' AND is_positive THEN 0.0 ELSE 1.0 END), 4) AS evidence_recall, count(*) FILTER (is_positive) > 0 AND count(*) FILTER (NOT is_positive) > 0 AS has_both FROM v GROUP BY name),
k(contract, least, evidence, abnormal, recall, needs_both) AS (VALUES ('source', 200, 0.9, 0.01, 0.0, true), ('source_diagnostic', 20, 0.0, 0.01, 0.0, true), ('binary', 200, 0.9, 1.0, 0.0, false), ('decision', 20, 0.0, 1.0, 0.0, true), ('compact', 100, 0.0, 1.0, 0.5, true), ('evidence_lines', 100, 0.0, 1.0, 0.5, false)),
f AS (SELECT name, contract, evidence_rate, abnormal_length_rate, list_filter([CASE WHEN abnormal_length_rate > abnormal THEN 'abnormal_length_rate' END, CASE WHEN needs_both AND NOT has_both THEN CASE contract WHEN 'compact' THEN 'both_labels' ELSE 'both_answered' END END,
  CASE WHEN evidence_rate < evidence THEN 'evidence_rate' END, CASE WHEN evidence_recall < recall THEN 'evidence_recall' END, CASE WHEN n < least THEN 'n' END], lambda x: x IS NOT NULL) AS failed FROM r, k)"""


@query(f"WITH {_VARIED} SELECT name, contract, evidence_rate, abnormal_length_rate, len(failed) = 0 AS passed, array_to_string(failed, ',') AS failed_checks FROM f")
def varied_gates(spark, d):
    """Each contract on outputs that are all right, which pass, and on outputs without evidence on positives and some that are too long."""
    gold = _gold(spark, d)
    k = (F.col("doc_id") % 7 + 1).cast("int")
    out = []
    for name in ("clean", "varied"):
        varied = F.lit(name == "varied")
        lines = F.when(varied & F.col("is_positive"), "").otherwise(F.concat(k.cast("string"), F.lit(","), (k + 1).cast("string")))
        basis = F.when(varied & (C.draw(65) < 3), F.lit(" ".join(map(str, range(9000))))).otherwise("what the lines show")
        told = F.when(F.col("is_positive"), "present").otherwise("not_observed")
        given = gold.select("doc_id", F.concat(F.lit('{"assessment":"'), told, F.lit('","basis":"'), basis, F.lit('","evidence":['), lines, F.lit("]}")).alias("raw_output"))
        cases = E.judged(E.join_predictions(gold, given, "doc_id").withColumn("n_lines", F.lit(9)))
        grouped = cases.withColumn("g", F.concat(F.floor(F.col("doc_id") / 20).cast("string"), F.when(F.col("is_positive"), "+").otherwise("-")))
        metrics = E.contract_metrics(grouped, E.extra_predictions(gold, given, "doc_id"), "g")
        # all contracts are checked on one row of figures, which is worked out once
        contracts = ("source", "source_diagnostic", "binary", "decision", "compact", "evidence_lines")
        for contract in contracts:
            metrics = E.gate(metrics, contract).withColumn(contract, F.struct(F.lit(contract).alias("contract"), "passed", "failed_checks")).drop("passed", "failed_checks")
        out.append(metrics.select(F.lit(name).alias("name"), "evidence_rate", "abnormal_length_rate", F.explode(F.array(*contracts)).alias("x")))
    return reduce(lambda a, b: a.unionAll(b), out).select("name", "x.contract", "evidence_rate", "abnormal_length_rate", "x.passed", "x.failed_checks")
