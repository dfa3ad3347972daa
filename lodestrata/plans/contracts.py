"""Queries: errors of JSON contracts, on outputs and records made of the supplied texts so that every rule is broken by some."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import contracts as K
from lodestrata.functions import text as T
from lodestrata.functions.json_schema import errors_of
from lodestrata.functions.structures import once
from lodestrata.plans import cases as C
from lodestrata.plans.registry import query, table


def _told(errors: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(errors, lambda e: F.concat_ws(":", e["path"], e["rule"], e["detail"]))), ";").alias("errors")


_UNSAFE = " UNION ALL ".join(f"SELECT doc_id, '<root>:unsafe:{p}' AS e FROM {{0}} WHERE regexp_matches({{1}}, '{p}', 'i')" for p in T.UNSAFE_GUIDANCE)
_MEMBERS = "['summary','behavior_explanation','risk_level','malware_like_behaviors','attack_mapping','recommendations','limitations']"
_SUMMARY = {2: '""', 3: "7"}
_BEHAVIORS = {5: '[{"behavior":"","evidence":1,"confidence":"none"},{"behavior":"b"},"c"]', 6: "{}", 7: '[{"behavior":"b","evidence":"e","confidence":"low","x":1,"more":2}]'}
_MAPPING = {8: "null", 9: '[{"tactic":"t","technique_id":"T1","technique_name":"","evidence":[]}]'}
_LIMITATIONS = {10: '["",null,"l"]', 11: '["A Step-by-Step plan: \\"bypass EDR\\""]', 12: "[]"}


def _json_text(text: Column) -> Column:
    """A text as JSON."""
    return once(F.to_json(F.struct(text.alias("t"))), lambda x: F.substr(x, F.lit(6), F.length(x) - 6))


def _chosen(by: dict[int, str], otherwise: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for u, text in by.items():
        out = F.coalesce(F.when(F.col("u") == u, F.lit(text)), out)
    return F.coalesce(out, F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def _sql_chosen(by: dict[int, str], otherwise: str) -> str:
    return f"CASE u {' '.join(f'WHEN {u} THEN {_quoted(text)}' for u, text in by.items())} ELSE {otherwise} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_OUTPUT_SQL = f"""
o AS (SELECT doc_id, u, CASE u WHEN 0 THEN 'no json' WHEN 1 THEN '{{}}' WHEN 13 THEN '[1]' ELSE '{{"summary":' || {_sql_chosen(_SUMMARY, "to_json(text)::VARCHAR")} || ',"behavior_explanation":"b","risk_level":' || {_sql_chosen({4: '"severe"'}, "'" + '"low"' + "'")}
  || ',"malware_like_behaviors":' || {_sql_chosen(_BEHAVIORS, "'[]'")} || ',"attack_mapping":' || {_sql_chosen(_MAPPING, "'[]'")} || ',"recommendations":["r"],"limitations":' || {_sql_chosen(_LIMITATIONS, "'[" + '"l"' + "]'")} || CASE u WHEN 14 THEN ',"note":1,"also":2' ELSE '' END || '}}' END AS raw
  FROM (SELECT doc_id, text, {C.sql_draw(71, modulus=20)} AS u FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, raw::JSON AS j FROM o WHERE u NOT IN (0, 13)),
m AS (SELECT doc_id, name, json_extract(j, '$.' || name) AS v FROM p, unnest({_MEMBERS}) AS t(name)),
i AS (SELECT doc_id, name, k - 1 AS k, name || '.' || (k - 1) AS path, v->(k - 1)::INTEGER AS v FROM (SELECT *, unnest(range(1, json_array_length(v)::BIGINT + 1)) AS k FROM m WHERE json_type(v) = 'ARRAY')),
f AS (SELECT doc_id, i.name, path, path || '.' || t.key AS below, t.key, json_extract(v, '$.' || t.key) AS w FROM i JOIN (VALUES ('malware_like_behaviors','behavior'),('malware_like_behaviors','evidence'),('malware_like_behaviors','confidence'),('attack_mapping','tactic'),('attack_mapping','technique_id'),('attack_mapping','technique_name'),('attack_mapping','evidence')) AS t(name, key) ON t.name = i.name WHERE json_type(v) = 'OBJECT'),
e AS (
  SELECT doc_id, '<root>:parse:' AS e FROM o WHERE u IN (0, 13)
  UNION ALL SELECT doc_id, '<root>:required:' || name FROM m WHERE v IS NULL
  UNION ALL SELECT doc_id, '<root>:additionalProperties:' || array_to_string(list_sort(list_filter(json_keys(j), lambda x: NOT list_contains({_MEMBERS}, x))), ',') FROM p WHERE len(list_filter(json_keys(j), lambda x: NOT list_contains({_MEMBERS}, x))) > 0
  UNION ALL SELECT doc_id, name || ':type:' FROM m WHERE v IS NOT NULL AND json_type(v) <> CASE WHEN name IN ('summary', 'behavior_explanation', 'risk_level') THEN 'VARCHAR' ELSE 'ARRAY' END
  UNION ALL SELECT doc_id, name || ':minLength:' FROM m WHERE name IN ('summary', 'behavior_explanation') AND v::VARCHAR = '""'
  UNION ALL SELECT doc_id, name || ':enum:' FROM m WHERE name = 'risk_level' AND v IS NOT NULL AND v::VARCHAR NOT IN ('"low"', '"medium"', '"high"', '"critical"', '"unknown"')
  UNION ALL SELECT doc_id, path || ':type:' FROM i WHERE json_type(v) <> CASE WHEN name IN ('recommendations', 'limitations') THEN 'VARCHAR' ELSE 'OBJECT' END
  UNION ALL SELECT doc_id, path || ':minLength:' FROM i WHERE name IN ('recommendations', 'limitations') AND v::VARCHAR = '""'
  UNION ALL SELECT doc_id, path || ':additionalProperties:more,x' FROM i WHERE json_type(v) = 'OBJECT' AND list_contains(json_keys(v), 'more')
  UNION ALL SELECT doc_id, path || ':required:' || key FROM f WHERE w IS NULL
  UNION ALL SELECT doc_id, below || ':type:' FROM f WHERE w IS NOT NULL AND json_type(w) <> 'VARCHAR'
  UNION ALL SELECT doc_id, below || ':minLength:' FROM f WHERE key <> 'confidence' AND w::VARCHAR = '""'
  UNION ALL SELECT doc_id, below || ':enum:' FROM f WHERE key = 'confidence' AND w::VARCHAR NOT IN ('"low"', '"medium"', '"high"')
  UNION ALL {_UNSAFE.format("o", "CASE WHEN u IN (0, 1, 13) THEN '' ELSE raw END")})"""


@query(f"WITH {_OUTPUT_SQL} SELECT o.doc_id, coalesce((SELECT string_agg(e, ';' ORDER BY e) FROM e WHERE e.doc_id = o.doc_id), '') AS errors FROM o")
def output_contract_errors(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", C.draw(71, modulus=20).alias("u"))
    parts = [F.lit('{"summary":'), _chosen(_SUMMARY, _json_text(F.col("text"))), F.lit(',"behavior_explanation":"b","risk_level":'), _chosen({4: '"severe"'}, '"low"'), F.lit(',"malware_like_behaviors":'), _chosen(_BEHAVIORS, "[]")]
    parts += [F.lit(',"attack_mapping":'), _chosen(_MAPPING, "[]"), F.lit(',"recommendations":["r"],"limitations":'), _chosen(_LIMITATIONS, '["l"]'), _chosen({14: ',"note":1,"also":2'}, ""), F.lit("}")]
    raw = F.when(F.col("u") == 0, "no json").when(F.col("u") == 1, "{}").when(F.col("u") == 13, "[1]").otherwise(F.concat(*parts))
    return rows.select("doc_id", _told(K.output_errors(raw)))


_SPANS_SQL = f"""
s AS (SELECT doc_id, CASE WHEN u = 1 THEN [text] ELSE string_split(text, ' ')[1:doc_id % 11] END AS spans, CASE WHEN u % 4 = 2 THEN 'uncertain' WHEN u = 3 THEN 'maybe' ELSE 'present' END AS a, u = 5 AS old, u = 7 AS unsure
  FROM (SELECT doc_id, text, {C.sql_draw(72, modulus=20)} AS u FROM documents WHERE text IS NOT NULL)),
e AS (
  SELECT doc_id, 'schema_version:const:' AS e FROM s WHERE old
  UNION ALL SELECT doc_id, 'assessment:enum:' FROM s WHERE a = 'maybe'
  UNION ALL SELECT doc_id, 'confidence:type:' FROM s WHERE unsure UNION ALL SELECT doc_id, 'confidence:enum:' FROM s WHERE unsure
  UNION ALL SELECT doc_id, 'evidence_spans:maxItems:' FROM s WHERE len(spans) > 8 OR (a = 'uncertain' AND len(spans) > 0)
  UNION ALL SELECT doc_id, 'evidence_spans:minItems:' FROM s WHERE a = 'present' AND len(spans) = 0
  UNION ALL SELECT doc_id, 'evidence_spans:uniqueItems:' FROM s WHERE len(list_distinct(spans)) < len(spans)
  UNION ALL SELECT doc_id, 'evidence_spans.' || (k - 1) || CASE WHEN spans[k] = '' THEN ':minLength:' ELSE ':maxLength:' END FROM (SELECT *, unnest(range(1, len(spans) + 1)) AS k FROM s) WHERE spans[k] = '' OR length(spans[k]) > 1000)"""


@query(f"WITH {_SPANS_SQL} SELECT s.doc_id, coalesce((SELECT string_agg(e, ';' ORDER BY e) FROM e WHERE e.doc_id = s.doc_id), '') AS errors FROM s")
def evidence_contract_errors(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", C.draw(72, modulus=20).alias("u"))
    spans = F.when(F.col("u") == 1, F.array("text")).otherwise(F.slice(F.split("text", " ", -1), 1, (F.col("doc_id") % 11).cast("int")))
    told = F.when(F.col("u") % 4 == 2, "uncertain").when(F.col("u") == 3, "maybe").otherwise("present")
    raw = F.to_json(F.struct(F.when(F.col("u") == 5, "v0").otherwise("v1").alias("schema_version"), told.alias("assessment"), spans.alias("evidence_spans"), F.lit("low").alias("confidence")))
    raw = F.when(F.col("u") == 7, F.replace(raw, F.lit('"confidence":"low"'), F.lit('"confidence":null'))).otherwise(raw)
    return rows.select("doc_id", _told(errors_of(raw, K.evidence_spans("v1"))))


_TYPES = ["alpha", "beta", "gamma"]


@query(
    f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, {C.sql_draw(73, modulus=10)} AS u FROM documents),
e AS (
  SELECT doc_id, 'source.type:enum:' AS e FROM r WHERE u = 1
  UNION ALL SELECT doc_id, 'source:required:license_or_terms' FROM r WHERE u = 2
  UNION ALL SELECT doc_id, 'source.retrieved_at:pattern:' FROM r WHERE u = 3
  UNION ALL SELECT doc_id, 'input.context:minLength:' FROM r WHERE text = ''
  UNION ALL SELECT doc_id, 'input.signals:type:' FROM r WHERE u = 4
  UNION ALL SELECT doc_id, 'expected_output.limitations.0:minLength:' FROM r WHERE u = 5
  UNION ALL SELECT doc_id, 'expected_output:required:recommendations' FROM r WHERE u = 6
  UNION ALL SELECT doc_id, 'metadata.contains_executable_payload:payload:' FROM r WHERE u = 7
  UNION ALL SELECT doc_id, 'metadata.notes.1:type:' FROM r WHERE u = 8
  UNION ALL SELECT doc_id, 'metadata.split:enum:' FROM r WHERE lang = 'es'
  UNION ALL {_UNSAFE.format("r", "text")})
SELECT r.doc_id, coalesce((SELECT string_agg(e, ';' ORDER BY e) FROM e WHERE e.doc_id = r.doc_id), '') AS errors FROM r"""
)
def record_contract_errors(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", C.draw(73, modulus=10).alias("u"))
    u, text = F.col("u"), _json_text(F.col("text"))
    parts = [
        '{"id":"r","source":{"type":', F.when(u == 1, '"other"').otherwise('"alpha"'), ',"name":"n","url":null', F.when(u == 2, "").otherwise(',"license_or_terms":null'), ',"retrieved_at":', F.when(u == 3, '"2026-1-05"').otherwise('"2026-01-05"'),
        '},"input":{"task":"t","context":', text, ',"signals":', F.when(u == 4, "[]").otherwise('{"deep":{"x":[1,null]}}'), '},"expected_output":{"summary":"s","behavior_explanation":', F.when(F.col("text") == "", '"b"').otherwise(text),
        ',"risk_level":"low","malware_like_behaviors":[],"attack_mapping":[]', F.when(u == 6, "").otherwise(',"recommendations":[]'), ',"limitations":[', F.when(u == 5, '""').otherwise('"l"'), ']},"metadata":{"split":', F.when(F.col("lang") == "es", '"dev"').otherwise('"train"'),
        ',"safety_level":"synthetic","contains_executable_payload":', F.when(u == 7, "true").otherwise("false"), ',"notes":["",', F.when(u == 8, "1").otherwise('"n"'), "]}}",
    ]
    raw = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return rows.select("doc_id", _told(K.record_errors(raw, K.record(_TYPES))))
