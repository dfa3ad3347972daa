"""Queries: catalog rows, dispositions, record builders, text and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import structures as S
from lodestrata.functions import text as T
from lodestrata.functions.hashing import canonical_json_hash, derived_seed, sha
from lodestrata.operators import dedup as D
from lodestrata.operators import records as B
from lodestrata.plans import cases as C
from lodestrata.plans.registry import SPACE, query, table
from lodestrata.plans.supply import NEAR_SQL

_CATALOG = f"""c0 AS (SELECT d.doc_id, d.text, d.lang, d.source, coalesce(l.toxic::VARCHAR, 'unknown') AS label, sha256(text) AS content, {NEAR_SQL} AS near FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY content) AS e1, min(doc_id) OVER (PARTITION BY near) AS n1,
 min(label) OVER (PARTITION BY content) != max(label) OVER (PARTITION BY content) AS ec, min(label) OVER (PARTITION BY near) != max(label) OVER (PARTITION BY near) AS nc FROM c0),
r AS (SELECT *, CASE WHEN ec THEN 'conflicting_exact_duplicate_labels' WHEN nc THEN 'conflicting_near_duplicate_labels' WHEN regexp_matches(text, '\\b(eval|exec)\\s*\\(') THEN 'executable_payload_forbidden'
 WHEN e1 < doc_id THEN 'exact_duplicate' WHEN n1 < doc_id THEN 'near_duplicate' WHEN length(trim(text)) = 0 THEN 'source_code_missing' WHEN lang IS NULL THEN 'scoped_cwe_missing'
 WHEN label != 'unknown' THEN 'requires_prompt_and_target_sanitization' ELSE 'outside_source_profile' END AS reason FROM c),
q AS (SELECT *, CASE WHEN reason IN ('conflicting_exact_duplicate_labels', 'conflicting_near_duplicate_labels', 'scoped_cwe_missing', 'outside_source_profile') THEN 'quarantine'
 WHEN reason = 'requires_prompt_and_target_sanitization' THEN 'eligible' ELSE 'reject' END AS disposition FROM r)"""


def catalog(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("string").alias("label"))
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", F.coalesce("label", F.lit("unknown")).alias("label"), F.sha2("text", 256).alias("content"), F.sha2(T.near_normal(F.col("text"), T.ASCII_SPACE), 256).alias("near"),
        T.has_hit(F.col("text"), "dynamic_execution").alias("payload"), (F.length(F.trim("text")) > 0).alias("has_code"),
    )
    rows = rows.persist()  # narrow rows that three plans below read; without it every text is hashed three times
    found = D.first_of(D.first_of(rows, "content", "doc_id", "exact", "label"), "near", "doc_id", "near", "label")
    what = D.disposition(
        F.col("exact_conflict"), F.col("near_conflict"), F.col("payload"), F.col("exact_first") < F.col("doc_id"), F.col("near_first") < F.col("doc_id"), F.col("has_code"), F.col("lang").isNotNull(), F.col("label") != "unknown"
    )
    return found.withColumn("what", what).select("doc_id", "lang", "source", "label", "content", "near", "exact_first", "near_first", "what.disposition", "what.reason")


@query(f"WITH {_CATALOG} SELECT disposition, reason, count(*) AS n FROM q GROUP BY ALL")
def dedup_disposition(spark, d):
    return catalog(spark, d).groupBy("disposition", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {_CATALOG} SELECT doc_id, CASE WHEN e1 < doc_id THEN e1 END AS exact_duplicate_of, CASE WHEN n1 < doc_id THEN n1 END AS near_duplicate_of, disposition, reason FROM q")
def disposition_rows(spark, d):
    c = F.col
    return catalog(spark, d).select("doc_id", F.when(c("exact_first") < c("doc_id"), c("exact_first")).alias("exact_duplicate_of"), F.when(c("near_first") < c("doc_id"), c("near_first")).alias("near_duplicate_of"), "disposition", "reason")


@query(f"WITH {_CATALOG} SELECT doc_id, content, sha256(CASE WHEN source != 'src0' THEN source || '|patch:' || (doc_id // 10) ELSE near END) AS group_id FROM q WHERE disposition = 'eligible'")
def eligible_manifest(spark, d):
    c = catalog(spark, d).where("disposition = 'eligible'")
    seed = F.when(F.col("source") != "src0", F.concat(F.col("source"), F.lit("|patch:"), F.floor(F.col("doc_id") / 10).cast("string"))).otherwise(F.col("near"))
    return c.select("doc_id", "content", F.sha2(seed, 256).alias("group_id"))


@query("SELECT day, user_id, event_id, event_type FROM (SELECT dayofmonth(ts)::INTEGER AS day, user_id, event_id, event_type, row_number() OVER (PARTITION BY dayofmonth(ts), user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def keep_first_observation(spark, d):
    e = table(spark, d, "events").select(F.dayofmonth("ts").cast("int").alias("day"), "user_id", "event_id", "event_type")
    return D.keep_first(e, ["day", "user_id"], ["event_id"])


@query(
    """SELECT doc_id, sha256(text) AS content_sha256, substr(sha256(text), 1, 12) AS short_hash, CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END::BIGINT AS tokens,
 CASE WHEN length(text) // 4 <= 512 THEN 'up_to_512' WHEN length(text) // 4 <= 1024 THEN '513_to_1024' WHEN length(text) // 4 <= 2048 THEN '1025_to_2048' ELSE 'over_2048' END AS length_bucket FROM documents"""
)
def catalog_row_features(spark, d):
    tokens = T.estimated_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", sha(F.col("text")).alias("content_sha256"), sha(F.col("text"), 12).alias("short_hash"), tokens.alias("tokens"), T.length_bucket(tokens).alias("length_bucket"))


_SECRET = r"""(\b[A-Za-z0-9_]*(?:password|api_key|client_secret)[A-Za-z0-9_]*\b)\s*=\s*([^\s,;)}\]]+)"""
_LITERAL = "WITH x AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' my_password = hunter2; api_key=abc' WHEN 1 THEN ' PASSWORD=x,y' ELSE '' END AS t FROM documents)"


def _with_secrets(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, " my_password = hunter2; api_key=abc").when(F.col("doc_id") % 3 == 1, " PASSWORD=x,y").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("t"))


@query(f"{_LITERAL} SELECT doc_id, sha256(regexp_replace(t, '{_SECRET}', '\\1 = [REDACTED_SECRET]', 'gi')) AS redacted_sha256, len(regexp_extract_all(t, '{_SECRET}', 0, 'i')) AS n_redactions FROM x")
def secret_redaction(spark, d):
    return _with_secrets(spark, d).select("doc_id", F.sha2(T.redacted(F.col("t")), 256).alias("redacted_sha256"), T.redactions(F.col("t")).alias("n_redactions"))


@query(f"{_LITERAL} SELECT doc_id, contains(lower(t), 'password=') OR contains(lower(t), 'api_key=') OR contains(lower(t), 'client_secret=') AS has_credentials FROM x")
def credential_policy(spark, d):
    return _with_secrets(spark, d).select("doc_id", T.has_credentials(F.col("t")).alias("has_credentials"))


def _sql_hits(column: str, patterns: dict[str, str]) -> str:
    return "list_filter([" + ", ".join("CASE WHEN regexp_matches({c}, '{p}'{f}) THEN '{k}' END".format(c=column, p=p.removeprefix("(?i)"), f=", 'i'" if p.startswith("(?i)") else "", k=k) for k, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


_CODE = "x AS (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN ' x = eval(y); subprocess.run(z)' WHEN 1 THEN ' import base64; requests.get(u); this program is safe' WHEN 2 THEN ' step-by-step: bypass EDR, train split' ELSE '' END AS t FROM pages)"


def _code(spark, d):
    n = F.col("page_id") % 4
    tail = F.when(n == 0, " x = eval(y); subprocess.run(z)").when(n == 1, " import base64; requests.get(u); this program is safe").when(n == 2, " step-by-step: bypass EDR, train split").otherwise("")
    return table(spark, d, "pages").select("page_id", F.concat("html", tail).alias("t"))


@query(f"WITH {_CODE} SELECT page_id, array_to_string({_sql_hits('t', T.SUSPICIOUS)}, ',') AS signals FROM x")
def suspicious_signals(spark, d):
    return _code(spark, d).select("page_id", F.array_join(T.named_hits(F.col("t"), T.SUSPICIOUS), ",").alias("signals"))


@query(f"WITH {_CODE} SELECT page_id, regexp_matches(t, '{'|'.join(T.UNSAFE_GUIDANCE)}', 'i') AS unsafe_guidance, regexp_matches(t, '{'|'.join(T.GLOBAL_SAFETY_CLAIMS)}', 'i') AS safety_claim FROM x")
def guidance_and_claims(spark, d):
    return _code(spark, d).select("page_id", T.any_match(F.col("t"), T.UNSAFE_GUIDANCE).alias("unsafe_guidance"), T.any_match(F.col("t"), T.GLOBAL_SAFETY_CLAIMS).alias("safety_claim"))


@query(f"WITH {_CODE} SELECT page_id, array_to_string(list_sort({_sql_hits('t', T.LEAKAGE)}), ',') AS leakage FROM x")
def leakage_flags(spark, d):
    return _code(spark, d).select("page_id", F.array_join(T.leakage_flags(F.col("t")), ",").alias("leakage"))


@query(
    f"""WITH {_CODE} SELECT page_id, CASE WHEN contains(lower(t), '취약') OR contains(lower(t), 'vulnerable') OR contains(lower(t), 'malicious') OR contains(lower(t), 'exploit') THEN 'high'
 WHEN contains(lower(t), 'safe') OR contains(lower(t), '안전') OR contains(lower(t), 'benign') THEN 'low' ELSE 'unknown' END AS risk FROM x"""
)
def keyword_risk(spark, d):
    return _code(spark, d).select("page_id", T.risk_of(F.col("t")).alias("risk"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 600 THEN regexp_replace(substr(text, 1, 600), '[\\s]+$', '') || chr(10) || '[TRUNCATED]' ELSE text END) AS cut_sha256 FROM documents")
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.truncated(F.col("text"), 600), 256).alias("cut_sha256"))


_MARKED = "x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Code excerpt:' || chr(10) || chr(9) || text WHEN 1 THEN text || chr(10) || 'Vulnerable excerpt:' || chr(10) || 'a Source-code excerpt:' || chr(10) || chr(160) || 'b ' || chr(13) ELSE text END AS t FROM documents)"


@query(
    rf"""WITH {_MARKED}, y AS (SELECT doc_id, CASE WHEN contains(t, 'Source-code excerpt:' || chr(10)) THEN substr(t, instr(t, 'Source-code excerpt:' || chr(10)) + 21)
 WHEN contains(t, 'Code excerpt:' || chr(10)) THEN substr(t, instr(t, 'Code excerpt:' || chr(10)) + 14) WHEN contains(t, 'Vulnerable excerpt:' || chr(10)) THEN substr(t, instr(t, 'Vulnerable excerpt:' || chr(10)) + 20) END AS c FROM x)
SELECT doc_id, regexp_replace(c, '^{SPACE}+|{SPACE}+$', '', 'g') AS code FROM y"""
)
def marked_code(spark, d):
    n = F.col("doc_id") % 3
    t = F.when(n == 0, F.concat(F.lit("Code excerpt:\n\t"), "text")).when(n == 1, F.concat("text", F.lit("\nVulnerable excerpt:\na Source-code excerpt:\n\xa0b \r"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.code_of(t).alias("code"))


@query("SELECT doc_id, 'CWE-' || (doc_id % 900) AS cwe, CASE " + " ".join(f"WHEN doc_id % 900 IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in T.WEAKNESS_FAMILIES.items()) + " ELSE 'other' END AS family FROM documents")
def weakness_families(spark, d):
    number = (F.col("doc_id") % 900).cast("int")
    return table(spark, d, "documents").select("doc_id", T.cwe_list(F.array(F.concat(F.lit("cwe_0"), number.cast("string"))))[0].alias("cwe"), T.weakness_family(number).alias("family"))


@query(
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(l, lambda x, i: lpad(i::VARCHAR, greatest(4, length(len(l)::VARCHAR))::INTEGER, '0') || '|' || x), chr(10))) AS numbered_sha256, len(l) AS n_lines FROM l"""
)
def line_numbering(spark, d):
    lines = T.numbered_lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(lines, "\n"), 256).alias("numbered_sha256"), F.size(lines).cast("long").alias("n_lines"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g'), '\b([A-Za-z_][A-Za-z0-9_]*)\b', 1)), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for'))), ',') AS identifiers FROM documents")
def identifier_extraction(spark, d):
    found = T.identifiers(F.regexp_replace("text", r"[^\x00-\x7f]", " "), ["the", "and", "for"])  # word ends beyond ASCII differ between engines
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(found), ",").alias("identifiers"))


@query(rf"SELECT page_id, len(list_distinct(list_filter(list_transform(string_split_regex(html, '[;{{}}\n]'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x != ''))) AS n_statements FROM pages")
def statement_split(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(T.statements(F.col("html"))).cast("long").alias("n_statements"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]+)', 2) AS host, NOT regexp_matches(url, '(^|/)\\.\\.(/|$)') AS safe_path FROM pages")
def url_checks(spark, d):
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"), (~F.col("url").rlike(r"(^|/)\.\.(/|$)")).alias("safe_path"))


@query("SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AS is_object, (json_valid(props) AND json_type(props) = 'OBJECT' AND list_contains(json_keys(props), 'k')) AS has_key FROM events")
def json_objects(spark, d):
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", S.is_json_object(F.col("props")).alias("is_object"), (S.is_json_object(F.col("props")) & F.array_contains(keys, "k")).alias("has_key"))


_RANGES = "r AS (SELECT doc_id, (doc_id % 7 + 1)::INTEGER AS a, (doc_id % 7 + 3)::INTEGER AS b, (doc_id % 5 + 4)::INTEGER AS c, (doc_id % 5 + 6)::INTEGER AS e FROM documents)"


@query(
    f"""WITH {_RANGES}, o AS (SELECT doc_id, CASE WHEN (a, b) <= (c, e) THEN [a, b, c, e] ELSE [c, e, a, b] END AS x FROM r)
SELECT doc_id, CASE WHEN x[3] <= x[2] + 1 THEN x[1] || '-' || greatest(x[2], x[4]) ELSE x[1] || '-' || x[2] || ',' || x[3] || '-' || x[4] END AS merged FROM o"""
)
def merged_line_ranges(spark, d):
    c = F.col("doc_id")
    pair = lambda n, low: F.struct((c % n + low).cast("int").alias("a"), (c % n + low + 2).cast("int").alias("b"))
    merged = S.merged_ranges(F.array(pair(7, 1), pair(5, 4)))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(merged, lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ",").alias("merged"))


@query(
    f"""WITH {_RANGES}, t AS (SELECT r.*, string_split(text, chr(10)) AS l FROM r JOIN documents USING (doc_id)), u AS (SELECT doc_id, [array_to_string(l[a:b], chr(10)), array_to_string(l[c:e], chr(10))] AS x FROM t)
SELECT doc_id, sha256(array_to_string(list_filter(CASE WHEN x[1] = x[2] THEN x[1:1] ELSE x END, lambda y: trim(y) != ''), chr(0))) AS spans_sha256 FROM u"""
)
def evidence_spans(spark, d):
    c = F.col("doc_id")
    pair = lambda n, low: F.struct((c % n + low).cast("int").alias("a"), (c % n + low + 2).cast("int").alias("b"))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(S.range_texts(F.col("text"), F.array(pair(7, 1), pair(5, 4))), "\0"), 256).alias("spans_sha256"))


@query(
    """WITH x AS (SELECT doc_id, text, substr(text, 1 + doc_id * 37 % greatest(length(text), 1), 30) || CASE WHEN doc_id % 4 = 0 THEN '~zz' ELSE '' END AS s FROM documents)
SELECT doc_id, contains(text, s) AS grounded, CASE WHEN instr(text, s) > 0 THEN length(substr(text, 1, instr(text, s) - 1)) - length(replace(substr(text, 1, instr(text, s) - 1), chr(10), '')) + 1 END::INTEGER AS first_line,
 CASE WHEN instr(text, s) > 0 THEN length(substr(text, 1, instr(text, s) - 1)) - length(replace(substr(text, 1, instr(text, s) - 1), chr(10), '')) + 1 + length(s) - length(replace(s, chr(10), '')) END::INTEGER AS last_line FROM x"""
)
def span_grounding(spark, d):
    """Spans of each text from a place that its id gives, of which every fourth is not there."""
    at = (F.col("doc_id") * 37 % F.greatest(F.length("text"), F.lit(1)) + 1).cast("int")
    x = table(spark, d, "documents").select("doc_id", "text", F.concat(F.substr("text", at, F.lit(30)), F.when(F.col("doc_id") % 4 == 0, "~zz").otherwise("")).alias("s"))
    lines = S.span_lines(F.col("text"), F.col("s"))
    return x.select("doc_id", S.grounded(F.col("text"), F.array("s")).alias("grounded"), lines["a"].alias("first_line"), lines["b"].alias("last_line"))


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AS valid FROM embeddings")
def fixed_length_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.fixed_length(F.col("embedding"), 64).alias("valid"))


@query(
    """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, list_reduce(list_prepend(0.0::DOUBLE, v), lambda p, q: p + q) AS t FROM a)
SELECT vec_id, round(v[1] / t, 6) AS first_share, round(v[64] / t, 6) AS last_share, 256::BIGINT AS dims FROM s"""
)
def feature_vectors(spark, d):
    v = S.padded(S.shares(F.transform("embedding", lambda x: F.abs(x).cast("double"))), 256)
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.col("v")[0], 6).alias("first_share"), F.round(F.col("v")[63], 6).alias("last_share"), F.size("v").cast("long").alias("dims"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'low' WHEN o_orderkey % 4 = 1 THEN 'medium' WHEN o_orderkey % 4 = 2 THEN 'high' ELSE 'low' END AS least FROM orders")
def least_confidence(spark, d):
    n = F.col("o_orderkey") % 4
    levels = F.when(n == 0, F.array(F.lit("high"), F.lit("low"))).when(n == 1, F.array(F.lit("medium"), F.lit("high"))).when(n == 2, F.array(F.lit("high"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select("o_orderkey", S.least_confidence(levels).alias("least"))


@query(
    """SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') = 0 THEN 'missing_user' WHEN count(*) FILTER (role = 'assistant') = 0 THEN 'missing_assistant' WHEN count(*) > 6 THEN 'too_long' ELSE 'eligible' END AS reason FROM conversations GROUP BY 1"""
)
def sft_eligibility(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return g.select("conv_id", B.first_failure([("missing_user", F.col("u") == 0), ("missing_assistant", F.col("a") == 0), ("too_long", F.col("n") > 6)]).alias("reason"))


@query(
    """WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
SELECT conv_id, coalesce(max(text) FILTER (role = 'system' AND n = 1), '') AS system, max(text) FILTER (role = 'user' AND n = 1) AS instruction, '' AS input, max(text) FILTER (role = 'assistant' AND n = 1) AS output
FROM m GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0"""
)
def instruction_export(spark, d):
    return B.instruction_rows(table(spark, d, "conversations"))


@query("SELECT conv_id, turn FROM conversations WHERE role != 'assistant'")
def challenge_projection(spark, d):
    return B.challenge(table(spark, d, "conversations"), "role", "assistant", ["conv_id", "turn"])


@query("SELECT conv_id, turn, sha256(text) AS expected_sha256 FROM conversations WHERE role = 'assistant'")
def gold_projection(spark, d):
    return B.gold(table(spark, d, "conversations"), "role", "assistant", ["conv_id", "turn"], "text", "expected_sha256")


@query(
    f"""SELECT doc_id, replace(CASE {C.sql_draw(3)} % 4 WHEN 0 THEN 'Assess whether {{scope}} is present in the supplied source-code excerpt.' WHEN 1 THEN 'Review the supplied function for {{scope}} and report only code-visible evidence.'
 WHEN 2 THEN 'Determine whether the supplied code exhibits {{scope}} without relying on provenance.' ELSE 'Perform an evidence-grounded defensive review of the excerpt scoped to {{scope}}.' END, '{{scope}}', lang) AS prompt FROM documents"""
)
def prompt_variants(spark, d):
    return table(spark, d, "documents").select("doc_id", B.prompt(F.col("lang"), derived_seed(3, F.col("doc_id")) % 100).alias("prompt"))


@query(
    rf"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(9) || '```' || chr(10) || 'hidden' || chr(10) || '  ```' || chr(10) ELSE '' END || text || chr(10) || '```c' || chr(10) || 'int main;' || chr(10) || '```' || chr(10) || 'end' AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM t),
f AS (SELECT *, regexp_matches(line, '^{SPACE}*```') AS fence FROM l), c AS (SELECT *, count(*) FILTER (fence) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept FROM c WHERE NOT fence AND n % 2 = 0 GROUP BY 1"""
)
def fenced_code_removal(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, "\t```\nhidden\n  ```\n").otherwise("")
    t = F.concat(head, "text", F.lit("\n```c\nint main;\n```\nend"))
    return table(spark, d, "documents").select("doc_id", T.without_fences(t).alias("kept"))


# Findings that break one rule each, and two that break none: assessment, nodes (id, role, span), edges, the errors they have.
_SOURCE, _SINK = ("a", "source", "the"), ("z", "sink", "e")
_FINDINGS = [
    ("present", [_SOURCE, _SINK], [("a", "z", "flows_to")], ""),
    ("not_observed", [("b", "bound", "e"), _SINK], [("b", "z", "bounds")], ""),
    ("uncertain", [], [], ""),
    ("present", [], [], "no_evidence"),
    ("present", [_SOURCE, ("a", "sink", "e")], [("a", "a", "flows_to")], "duplicate_node_id,verb_does_not_fit_role,no_required_role_linked"),
    ("present", [("a", "source", "~absent~"), _SINK], [("a", "z", "flows_to")], "span_not_grounded"),
    ("present", [_SOURCE, _SINK], [("a", "z", "flows_to"), ("a", "x", "flows_to")], "unresolved_edge"),
    ("present", [_SOURCE, ("b", "bound", "e"), _SINK], [("a", "z", "flows_to"), ("a", "b", "flows_to")], "edge_ends_at_no_sink"),
    ("present", [_SOURCE, _SINK], [("a", "z", "bounds")], "verb_does_not_fit_role,no_required_role_linked"),
    ("present", [_SOURCE, ("b", "bound", "e")], [], "no_sink,no_required_role_linked"),
    ("not_observed", [_SOURCE, _SINK], [("a", "z", "flows_to")], "no_required_role_linked"),
]


@query(f"SELECT doc_id, [{', '.join(repr(x[3]) for x in _FINDINGS)}][1 + doc_id % {len(_FINDINGS)}] AS errors FROM documents")
def role_graphs(spark, d):
    """Stated findings, in each document's text with the spans that hold put before it."""
    kind = "struct<assessment: string, nodes: array<struct<id: string, role: string, span: string>>, edges: array<struct<source: string, target: string, verb: string>>>"
    cases = spark.createDataFrame([(k, (a, n, e)) for k, (a, n, e, _) in enumerate(_FINDINGS)], f"k long, f {kind}")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("the "), "text").alias("text"), (F.col("doc_id") % len(_FINDINGS)).alias("k")).join(F.broadcast(cases), "k")  # a row a finding
    return docs.select("doc_id", F.array_join(S.role_graph_errors(F.col("f.assessment"), F.col("f.nodes"), F.col("f.edges"), F.col("text")), ",").alias("errors"))


_GOOD = ([_SOURCE, _SINK], [("a", "z", "flows_to")])
#: Outputs on a document's function f1: weakness and architecture of the scope, assessment, findings (function, representation, nodes, edges), errors.
_OUTPUTS = [
    ("W1", "x86", "present", [("f1", "pseudo_c", *_GOOD)], ""),
    ("W1", "x86", "present", [("f1", "pseudo_c", *_GOOD), ("f1", "assembly", [("a", "source", "the"), ("z", "sink", "the")], [("a", "z", "flows_to")])], ""),
    ("W2", "arm", "uncertain", [], "scope.architecture,scope.weakness"),
    ("W1", "x86", "not_observed", [], "findings:missing"),
    ("W1", "x86", "present", [("f2", "pseudo_c", *_GOOD)], "findings.0:unknown_function"),
    ("W1", "x86", "present", [("f1", "pseudo_c", *_GOOD), ("f1", "assembly", [("a", "source", "the "), ("z", "sink", "the")], [("a", "z", "flows_to")])], "findings.1:span_not_grounded"),
    ("W1", "x86", "present", [("f1", "static_feature", [("a", "source", "malloc"), ("z", "sink", "free")], [("a", "z", "bounds")])], "findings.0:no_required_role_linked,findings.0:verb_does_not_fit_role"),
    ("W1", None, "present", [("f1", "hex", *_GOOD)], "findings.0:unknown_representation,scope.architecture"),
]


@query(f"SELECT doc_id, [{', '.join(repr(x[4]) for x in _OUTPUTS)}][1 + doc_id % {len(_OUTPUTS)}] AS errors FROM documents")
def role_outputs(spark, d):
    """Stated outputs about each document's function: scope, function, representation, and several findings."""
    finding = "struct<function_id: string, representation: string, nodes: array<struct<id: string, role: string, span: string>>, edges: array<struct<source: string, target: string, verb: string>>>"
    cases = spark.createDataFrame([(k, ((w, a), t, f)) for k, (w, a, t, f, _) in enumerate(_OUTPUTS)], f"k long, o struct<scope: struct<weakness: string, architecture: string>, assessment: string, findings: array<{finding}>>")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("the "), "text").alias("text"), (F.col("doc_id") % len(_OUTPUTS)).alias("k")).join(F.broadcast(cases), "k")  # a row an output
    scope = F.struct(F.lit("W1").alias("weakness"), F.lit("x86").alias("architecture"))
    function = F.struct(F.lit("f1").alias("function_id"), F.col("text").alias("pseudo_c"), F.split("text", " ").alias("assembly"), F.array(F.lit("malloc"), F.lit("free")).alias("static_feature"))
    return docs.select("doc_id", F.array_join(F.array_sort(S.role_output_errors(F.col("o"), scope, F.array(function))), ",").alias("errors"))


@query("SELECT o_custkey, CASE min(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS least FROM orders GROUP BY 1")
def least_priority(spark, d):
    """The least confidence of real groups: the priorities of a customer's orders."""
    level = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(level).alias("levels")).select("o_custkey", S.least_confidence(F.col("levels")).alias("least"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS record_sha256 FROM orders""")
def canonical_hashes(spark, d):
    """Whole numbers and plain words, which all engines write alike as JSON."""
    return table(spark, d, "orders").select("o_orderkey", canonical_json_hash(F.struct("o_custkey", "o_orderkey", "o_orderstatus")).alias("record_sha256"))


@query(
    """WITH m AS (SELECT doc_id, ('0x' || substr(sha256('20260728:' || doc_id), 1, 16))::UBIGINT AS u FROM documents) SELECT doc_id, u::VARCHAR AS seed, CASE WHEN u % 10000 < 8000 THEN 'train' WHEN u % 10000 < 9000 THEN 'validation' ELSE 'test' END AS split FROM m"""
)
def derived_seeds(spark, d):
    from lodestrata.functions.hashing import hash_split

    return table(spark, d, "documents").select("doc_id", derived_seed(20260728, F.col("doc_id")).cast("string").alias("seed"), hash_split(20260728, F.col("doc_id")).alias("split"))
