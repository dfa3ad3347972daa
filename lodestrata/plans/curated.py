"""Queries: candidate pools, pairs, evidence, review and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import curation as K
from lodestrata.operators import records as B
from lodestrata.plans import cases as C
from lodestrata.plans.registry import SPACE, query, table


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'heap_buffer_read' WHEN o_orderkey % 5 = 1 THEN 'heap_buffer_write' WHEN o_orderkey % 5 = 2 THEN 'stack_buffer_read' WHEN o_orderkey % 5 = 3 THEN 'stack_buffer_write' END AS family
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 1000"""
)
def crash_families(spark, d):
    n = F.col("o_orderkey") % 5
    crash = F.when(n == 0, "Heap-buffer-overflow READ 4").when(n == 1, "heap-buffer-overflow WRITE {*}").when(n == 2, "Stack-buffer-overflow READ 1").when(n == 3, "Stack-buffer-overflow WRITE 8").otherwise("Null-dereference")
    rows = table(spark, d, "orders").select("o_orderkey", crash.alias("crash"), F.lower("o_orderstatus").alias("status"), (F.col("o_totalprice") > 1000).alias("reproduced"), "o_orderpriority")
    return K.eligible_reports(rows, ["reproduced"], "status", ["f", "o"], ["o_orderpriority"]).select("o_orderkey", K.crash_family(F.col("crash")).alias("family"))


@query(
    """WITH m AS (SELECT o_orderkey, count(*) AS n, count(DISTINCT p_brand) AS brands, min(p_brand) AS brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, brand, substr(sha256(o_orderkey || chr(0) || brand), 1, 16) AS candidate_id FROM m WHERE brands = 1"""
)
def single_class_candidates(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    brands = orders.join(lines, "o_orderkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("o_orderkey").agg(F.countDistinct("p_brand").alias("brands"), F.min("p_brand").alias("brand")).where("brands = 1")
    return brands.select("o_orderkey", "brand", F.substring(F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit("\0"), "brand"), 256), 1, 16).alias("candidate_id"))


_TOXIC = "t AS (SELECT d.doc_id, source, lang, text, toxic, quality FROM documents d JOIN labels USING (doc_id))"


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "text").join(table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality")), "doc_id")


@query(
    f"""WITH {_TOXIC} SELECT doc_id, 'vulnerable_before' AS side, 1 AS label, length(text)::INTEGER AS size FROM t UNION ALL
SELECT doc_id, 'fixed_after', 0, length(lower(text))::INTEGER FROM t WHERE toxic = 1 AND text != lower(text) AND source != 'src3'"""
)
def before_after_rows(spark, d):
    rows = _labelled(spark, d).select("doc_id", "text", F.lower("text").alias("fixed"), "toxic", F.when(F.col("source") == "src3", "").otherwise(F.col("source")).alias("patch"))
    verified = K.pair_verified(F.col("toxic"), F.col("text"), F.col("fixed"), F.col("patch"), F.lit("CWE-1"))
    found = K.before_after(rows.withColumn("ok", verified), "text", "fixed", F.col("ok"))
    return found.select("doc_id", "side", "label", F.length("code").alias("size"))


_GROUPS = f"""{_TOXIC}, g AS (SELECT doc_id // 5 AS g, count(*) AS n, count(*) FILTER (toxic = 1) AS ones, count(DISTINCT lang) AS s, count(DISTINCT sha256(text)) AS c FROM t GROUP BY 1),
r AS (SELECT g, substr(sha256('3:' || g), 1, 16) AS pair_id, CASE WHEN n != 2 THEN 'pair_must_contain_exactly_two_records' WHEN ones != 1 THEN 'pair_must_have_one_present_and_one_not_observed' WHEN s != 1 THEN 'pair_scope_mismatch'
 WHEN c != 2 THEN 'pair_code_hashes_must_be_distinct' ELSE 'eligible' END AS reason FROM g)"""


def _pair_reasons(spark, d):
    rows = _labelled(spark, d).select(F.floor(F.col("doc_id") / 5).alias("g"), "toxic", "lang", F.sha2("text", 256).alias("content"))
    return K.pair_reasons(rows, "g", "toxic", "lang", "content", 3)


@query(f"WITH {_GROUPS} SELECT g, pair_id, reason FROM r")
def pair_structure(spark, d):
    return _pair_reasons(spark, d)


@query(f"WITH {_GROUPS} SELECT reason, count(*) AS n FROM r GROUP BY 1")
def rejection_histogram(spark, d):
    return K.reason_histogram(_pair_reasons(spark, d))


@query(f"WITH {_TOXIC}, p AS (SELECT doc_id // 10 AS pair, min(doc_id) FILTER (toxic = 1) AS present, min(doc_id) FILTER (toxic = 0) AS not_observed FROM t GROUP BY 1) SELECT pair, present, not_observed FROM p WHERE present IS NOT NULL AND not_observed IS NOT NULL")
def present_fixed_pairs(spark, d):
    return K.pair_sides(_labelled(spark, d).withColumn("pair", F.floor(F.col("doc_id") / 10)), "pair", "toxic", "doc_id")


@query(
    f"""WITH {_TOXIC}, e AS (SELECT doc_id, quality = 1 AS ok FROM t WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, toxic = 0 FROM t WHERE doc_id % 4 = 0), p AS (SELECT doc_id, count(*) AS times, bool_and(ok) AS ok FROM e GROUP BY 1),
n AS (SELECT count(*) AS r, count(*) FILTER (ok) AS q, count(*) FILTER (times > 1) AS twice FROM p)
SELECT r AS n_reviewed, q AS n_qualified, least(q, 100) AS n_accepted, greatest(q - 100, 0) AS n_reserve, r - q AS n_rejected, twice AS n_decided_twice, CASE WHEN q >= 100 THEN 'pass' ELSE 'insufficient_accepted_supply' END AS decision FROM n"""
)
def review_rounds(spark, d):
    t = _labelled(spark, d)
    return K.review_rounds([t.where("doc_id % 3 = 0").withColumn("ok", F.col("quality") == 1), t.where("doc_id % 4 = 0").withColumn("ok", F.col("toxic") == 0)], "doc_id", "ok", 100)


@query(
    r"""WITH e AS (SELECT page_id, page_id // 4 AS pair, page_id % 2 AS compiler, CASE WHEN page_id % 4 < 2 THEN 'O0' ELSE 'O2' END AS level, html, length(regexp_replace(html, '[\s]+', '', 'g')) AS size FROM pages),
b AS (SELECT *, max(size) FILTER (level = 'O0') OVER (PARTITION BY pair, compiler) AS base FROM e)
SELECT page_id, array_to_string(list_filter([CASE WHEN size < 120 THEN 'body_too_short' END, CASE WHEN NOT contains(lower(html), 'table') THEN 'source_operation_not_recovered' END,
 CASE WHEN level = 'O2' AND base > 0 AND size / base::DOUBLE < 0.15 THEN 'o2_evidence_collapse' END], lambda x: x IS NOT NULL), ',') AS flags FROM b"""
)
def review_triage(spark, d):
    p = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.floor(p / 4).alias("pair"), (p % 2).alias("compiler"), F.when(p % 4 < 2, "O0").otherwise("O2").alias("level"), F.regexp_replace("html", r"^x^", "").alias("html"), F.lit("TABLE").alias("op"))
    return K.triage(rows, "pair", "compiler", "level", "html", "op").select("page_id", "flags")


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'present' ELSE 'not_observed' END AS assessment, CASE doc_id % 3 WHEN 0 THEN '' ELSE 'a,b,' || (doc_id % 7) END AS spans, CASE WHEN doc_id % 2 = 0 THEN 'low' ELSE 'medium' END AS confidence,
CASE doc_id % 3 WHEN 0 THEN 'The evidence on ' || source || ' is not sufficient.' WHEN 1 THEN source || ' is present; 3 evidence span(s).' ELSE source || ' was not observed; 3 evidence span(s).' END AS report FROM documents"""
)
def compact_targets(spark, d):
    n = F.col("doc_id")
    a = F.when(n % 3 == 0, "uncertain").when(n % 3 == 1, "present").otherwise("not_observed")
    spans = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), (n % 7).cast("string")))
    target = K.compact_target(a, spans, F.array(F.lit("high"), F.when(n % 2 == 0, "low").otherwise("medium"), F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", "source", target.alias("t"))
    return rows.select("doc_id", "t.assessment", F.array_join("t.evidence_spans", ",").alias("spans"), "t.confidence", K.rendered(F.col("t.assessment"), F.col("source"), F.size("t.evidence_spans")).alias("report"))


@query("SELECT page_id, 'int x;' || chr(10) || 'y' AS pseudo_c, 24 AS n_assembly, 32 AS n_imports, least(16, page_id % 20)::INTEGER AS n_strings FROM pages")
def compacted_functions(spark, d):
    p = F.col("page_id")
    many = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("string"))
    strings = F.slice(many(20), F.lit(1), (p % 20).cast("int"))
    f = F.struct(p.alias("function_id"), F.lit("int x; /* a\n b */\n\n  y ").alias("pseudo_c"), many(99).alias("assembly"), many(50).alias("imports"), strings.alias("strings"))
    rows = table(spark, d, "pages").select("page_id", K.compact_functions(F.array(f))[0].alias("f"))
    return rows.select("page_id", "f.pseudo_c", *[F.size(f"f.{x}").alias(f"n_{x}") for x in ("assembly", "imports", "strings")])


@query("SELECT s_suppkey, 'free,malloc_' || s_suppkey AS imports, '.data,.text' AS sections FROM supplier")
def object_features(spark, d):
    s = F.col("s_suppkey").cast("string")
    nm = F.concat(F.lit("                 U malloc_"), s, F.lit("@GLIBC_2.2\n0000 T main\n                 U free\n                 U free"))
    readelf = F.lit("  [ 1] .text PROGBITS\n  [12] .data PROGBITS\n  [13] .text PROGBITS")
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(K.undefined_imports(nm), ",").alias("imports"), F.array_join(K.section_names(readelf), ",").alias("sections"))


@query(
    "WITH c AS (SELECT * FROM (VALUES ('documents.doc_id'), ('documents.text'), ('documents.lang'), ('documents.source'), ('documents.n_chars'), ('pages.page_id'), ('pages.url'), ('pages.html'), ('nation.n_nationkey'), ('nation.n_name'), ('nation.n_regionkey')) v(c)), f AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', {v})" for k, v in K.FIELD_ALIASES.items())
    + ") v(field, aliases)) SELECT field, coalesce(string_agg(c, ',' ORDER BY c), '') AS columns FROM f LEFT JOIN c ON len(list_filter(aliases, lambda a: contains(string_split(c, '.')[-1], a))) > 0 GROUP BY field"
)
def schema_field_candidates(spark, d):
    return K.field_candidates({t: table(spark, d, t) for t in ("documents", "pages", "nation")})


_COHORT = {"priced": "o_totalprice > 50000", "closed": "o_orderstatus = 'F'", "even": "o_custkey % 2 = 0"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS field, count(*) FILTER ({' AND '.join(v for n, v in _COHORT.items() if n != k)}) AS n_without FROM orders" for k in _COHORT))
def cohort_intersections(spark, d):
    return K.cohorts(table(spark, d, "orders"), {k: F.expr(v) for k, v in _COHORT.items()})


@query(
    """WITH i AS (SELECT dayofmonth(ts) AS day, user_id, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT user_id, sum(n) AS n FROM i GROUP BY 1)
SELECT (SELECT sum(n - 1) FROM i)::BIGINT AS within_part, (SELECT sum(n - 1) FROM o)::BIGINT AS overall"""
)
def duplicate_scopes(spark, d):
    return K.duplicate_scopes(table(spark, d, "events").select(F.dayofmonth("ts").alias("day"), "user_id"), "day", "user_id")


@query("WITH e AS (SELECT user_id, dayofmonth(ts)::INTEGER AS day, event_type, event_id FROM events) SELECT user_id, day, count(DISTINCT event_type) AS n_values FROM e GROUP BY ALL HAVING count(DISTINCT event_type) > 1")
def gold_conflicts(spark, d):
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").cast("int").alias("day"), "event_type", "event_id")
    _, _, conflicts = K.split_fields(e, ["user_id", "day"], ["event_type"], "event_id")
    return conflicts


@query(
    f"""WITH {_TOXIC}, o AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS i FROM t WHERE quality = 1), u AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR)) AS tt FROM o WHERE i = 1),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY tt, sha256(source), doc_id)::INTEGER AS family_rank FROM u) SELECT doc_id, lang, family_rank FROM r WHERE family_rank <= 15"""
)
def family_quota(spark, d):
    t = _labelled(spark, d).withColumn("identity", F.sha2("text", 256))
    return K.family_quota(t, "lang", "source", "identity", "doc_id", F.col("quality") == 1, 15).select("doc_id", "lang", "family_rank")


@query(f"SELECT doc_id, CASE WHEN source = 'src2' THEN 'test' ELSE CASE WHEN {C.sql_draw(20260728, 'doc_id', 10000)} < 8000 THEN 'train' WHEN {C.sql_draw(20260728, 'doc_id', 10000)} < 9000 THEN 'validation' ELSE 'test' END END AS split FROM documents")
def forced_test_members(spark, d):
    from lodestrata.plans.supply import split_documents

    return K.forced_test_split(split_documents(spark, d), "split", F.col("source") == "src2").select("doc_id", "split")


@query("SELECT w.doc_id, d.lang, d.doc_id IS NOT NULL AS found FROM (SELECT doc_id * 7 AS doc_id FROM documents) w LEFT JOIN documents d USING (doc_id)")
def row_positions(spark, d):
    docs = table(spark, d, "documents")
    wanted = docs.select((F.col("doc_id") * 7).alias("doc_id"))
    return K.rows_at(docs.select("doc_id", "lang", F.lit(True).alias("f")), "doc_id", wanted).select("doc_id", "lang", F.coalesce("f", F.lit(False)).alias("found"))


@query("SELECT doc_id, 'unknown' AS side FROM (SELECT doc_id * 7 AS doc_id FROM documents) w WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def unknown_ids(spark, d):
    docs = table(spark, d, "documents")
    _, unknown = K.rows_by_ids(docs, "doc_id", docs.select((F.col("doc_id") * 7).alias("doc_id")))
    return unknown.withColumn("side", F.lit("unknown"))


@query("WITH s AS (SELECT doc_id // 2 AS pair, lang, max(CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END)::BIGINT AS n_tokens FROM documents GROUP BY ALL) SELECT pair, lang, n_tokens FROM s WHERE n_tokens <= 400 ORDER BY pair, lang LIMIT 100")
def tokenizer_gate(spark, d):
    from lodestrata.functions.text import estimated_tokens

    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("pair"), "lang", estimated_tokens(F.col("text")).alias("t"))
    return K.token_gate(rows, "pair", "lang", F.col("t"), 400, 100)


@query("SELECT doc_id FROM documents WHERE length(text) // 4 > 1000")
def over_cutoff(spark, d):
    from lodestrata.functions.text import estimated_tokens

    return K.cutoff_filter(table(spark, d, "documents"), estimated_tokens(F.col("text")), 1000)[1].select("doc_id")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS accepted_index FROM documents WHERE length(text) > 400")
def accepted_indexes(spark, d):
    return B.accepted_index(table(spark, d, "documents"), "source", "doc_id", F.length("text") > 400).select("doc_id", "source", "accepted_index")


RULES = {"CWE-121": [r"\bstrcpy\s*\(", r"\[\d+\]"], "CWE-190": [r"\+\s*1\b"], "CWE-476": [r"= NULL;", r"->"]}
PARTS = {"CWE-121": {"copy": r"strcpy", "buffer": r"\[\d+\]"}, "CWE-476": {"assignment": "NULL", "use": "->"}}
_CODE = [("CWE-121", "char b[8];\nstrcpy(b, s);"), ("CWE-121", "strcpy(b, s);"), ("CWE-190", "n = n + 1;"), ("CWE-476", "p = NULL;\nq = p->x;"), ("CWE-999", "x")]


def _snippets(spark, d):
    n = (F.col("s_suppkey") % 5).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _CODE]), n + 1)
    return table(spark, d, "supplier").select("s_suppkey", pick(0).alias("cwe"), pick(1).alias("code"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true END AS visible, CASE s_suppkey % 5 WHEN 1 THEN 'buffer' ELSE '' END AS missing FROM supplier")
def relation_visibility(spark, d):
    rows = _snippets(spark, d)
    return rows.select("s_suppkey", K.visible(F.col("code"), F.col("cwe"), RULES).alias("visible"), F.array_join(K.missing_spans(F.split("code", "\n"), F.col("cwe"), PARTS), ",").alias("missing"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
s AS (SELECT doc_id, line_no, trim(line, ' ') AS line, CASE WHEN regexp_matches(trim(line, ' '), 'the') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(trim(line, ' '), '[0-9]') THEN 3 ELSE 0 END AS score FROM l WHERE trim(line, ' ') != ''),
p AS (SELECT DISTINCT doc_id - 1 AS doc_id, line FROM s), q AS (SELECT s.doc_id, line_no, score + CASE WHEN p.line IS NULL THEN 12 ELSE 0 END AS score FROM s LEFT JOIN p ON s.doc_id = p.doc_id AND s.line = p.line),
r AS (SELECT doc_id, line_no, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS k FROM q) SELECT doc_id, line_no::INTEGER AS line_no, score::INTEGER AS score, k::INTEGER AS evidence_rank FROM r WHERE k <= 3"""
)
def ranked_evidence(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return K.ranked_evidence(docs, "doc_id", "text", {"the": 5, "[0-9]": 3}, docs.withColumn("doc_id", F.col("doc_id") - 1), 3).select("doc_id", "line_no", "score", "evidence_rank")


@query("SELECT s_suppkey, 'f_' || s_suppkey AS name, 2 AS first_line, 5 AS last_line FROM supplier UNION ALL SELECT s_suppkey, 'g', 7, 7 FROM supplier")
def extracted_functions(spark, d):
    code = F.concat(F.lit('#define X "{"\nint f_'), F.col("s_suppkey").cast("string"), F.lit('(int a) {\n  if (a) { b("}"); }\n  // }\n}\nstruct s { int x; };\nvoid g(void) { /* { */ }\n'))
    return K.extract_functions(table(spark, d, "supplier").select("s_suppkey", code.alias("code")), "s_suppkey", "code").select("s_suppkey", "name", "first_line", "last_line")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM documents)
SELECT doc_id, count(*) FILTER (regexp_matches(line, '\bthe\b')) AS added, count(*) FILTER (regexp_matches(line, '\bthe\b')) AS removed FROM l GROUP BY 1""".replace("\\\\", "\\")
)
def line_diffs(spark, d):
    """Every line with a changed word is removed and added again; tests hold diffs of other kinds against stated cases."""
    word = r"(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])"  # where \b is may depend on letters beyond ASCII
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.regexp_replace("text", word, "THE").alias("after"))
    return docs.select("doc_id", K.line_diff("text", "after").alias("x")).select("doc_id", "x.added", "x.removed")


@query(
    f"""WITH {C.SQL} SELECT doc_id, CASE WHEN NOT json_valid(raw_output) THEN 'parse' ELSE array_to_string(list_filter([CASE WHEN TRY(json_extract(raw_output, '$.summary')) IS NULL THEN 'summary:missing' END,
 CASE WHEN TRY(json_extract(raw_output, '$.risk_level')) IS NULL THEN 'risk_level:missing' END, CASE WHEN TRY(json_extract(raw_output, '$.limitations')) IS NULL THEN 'limitations:missing' END], lambda x: x IS NOT NULL), ',') END AS errors,
 json_valid(raw_output) AND coalesce(TRY(json_array_length(raw_output, '$.limitations')), 0) > 0 AS disciplined FROM p"""
)
def output_schema_errors(spark, d):
    p = C.predictions(spark, d)
    errors = K.schema_errors(F.col("raw_output"), {"summary": "STRING", "risk_level": "STRING", "limitations": "ARRAY"})
    limitations = F.from_json(F.get_json_object("raw_output", "$.limitations"), "array<string>")
    evidence = F.array().cast("array<string>")
    from lodestrata.functions.structures import is_json_object

    return p.select("doc_id", F.array_join(errors, ",").alias("errors"), (is_json_object(F.col("raw_output")) & K.disciplined(limitations, evidence)).alias("disciplined"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def embedded_json(spark, d):
    prompt = F.concat(F.lit("Assess this: "), F.col("props"), F.lit(" and answer {briefly}."))
    return table(spark, d, "events").select("event_id", K.embedded_json(prompt, "$.k").alias("k"))


@query("SELECT o_orderkey, o_orderkey % 3 != 1 AS date_like FROM orders")
def date_shapes(spark, d):
    n = F.col("o_orderkey") % 3
    return table(spark, d, "orders").select("o_orderkey", K.date_like(F.when(n == 0, "2026-99-99").when(n == 1, "2026-1-1").otherwise("2026-07-31")).alias("date_like"))


@query("SELECT column_name AS field FROM (DESCRIBE labels) WHERE column_name IN ('quality', 'toxic') UNION ALL SELECT 'items[].toxic'")
def forbidden_fields(spark, d):
    labels = table(spark, d, "labels")
    nested = labels.select("*", F.array(F.struct("toxic")).alias("items"))
    return spark.createDataFrame([(x,) for x in K.forbidden_fields(nested.schema, ["toxic", "quality"])], "field string")


@query("SELECT true AS approved")
def approval_chain(spark, d):
    from lodestrata.operators.audit import review_summary

    labels = table(spark, d, "labels")
    review = review_summary(labels, F.col("quality") == 0, 0.5)
    return K.approved(spark.createDataFrame([(True,)], "approved boolean"), review, review_summary(labels.repartition(3), F.col("quality") == 0, 0.5))


@query("SELECT 'approved' AS manifest, true AS approved UNION ALL SELECT 'not_approved', false UNION ALL SELECT 'review_of_other_rows', (SELECT count(*) FROM labels) = (SELECT count(*) FROM labels WHERE doc_id % 10 <> 3)")
def approval_outcomes(spark, d):
    """A manifest that holds, one that says no, and one whose review is not that of its rows."""
    from lodestrata.operators.audit import review_summary

    labels = table(spark, d, "labels")
    of = lambda rows: review_summary(rows, F.col("quality") == 0, 0.5)
    cases = {"approved": (True, labels), "not_approved": (False, labels), "review_of_other_rows": (True, labels.where("doc_id % 10 != 3"))}
    out = [K.approved(spark.createDataFrame([(told,)], "approved boolean"), of(labels), of(rows)).select(F.lit(name).alias("manifest"), "approved") for name, (told, rows) in cases.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '[^<>\s]+')) AS w FROM pages) SELECT page_id, count(*) FILTER (regexp_matches(w, '^\d{4}-\d{2}-\d{2}$')) AS n_dates, count(*) AS n_words FROM t GROUP BY 1""".replace("\\\\", "\\"))
def page_dates(spark, d):
    """Words of whole pages that have the shape of a date."""
    words = F.regexp_extract_all("html", F.lit(r"[^<>\s]+"), F.lit(0))
    found = table(spark, d, "pages").select("page_id", F.explode(words).alias("w"))
    return found.groupBy("page_id").agg(F.count_if(K.date_like(F.col("w"))).alias("n_dates"), F.count("*").alias("n_words"))


@query("SELECT 'documents' AS source, doc_id AS id, lang FROM documents UNION ALL SELECT 'pages', page_id, NULL FROM pages")
def unioned_sources(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "lang")
    return docs.unionByName(table(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id")), allowMissingColumns=True)


# Lines of a dump and the class of each.
_DUMP = [
    ("PRAGMA foreign_keys=OFF;", "pragma"), ("PRAGMA writable_schema=1;", "dangerous"), ("BEGIN TRANSACTION;", "transaction"), ("COMMIT;", "transaction"), ("CREATE TABLE t (a);", "create"), ("create unique index i on t (a);", "create"),
    ("CREATE TRIGGER x AFTER INSERT ON t BEGIN SELECT 1; END;", "dangerous"), ("CREATE VIRTUAL TABLE v USING fts5(a);", "dangerous"), ("INSERT INTO t VALUES (1);", "insert"), ("ATTACH x AS y;", "dangerous"), ("DETACH y;", "dangerous"),
    ("ALTER TABLE t ADD b;", "dangerous"), ("  drop table t;", "dangerous"), ("REINDEX t;", "dangerous"), ("SELECT load_extension (x);", "dangerous"), ("VACUUM;", "dangerous"), (".shell ls", "dangerous"), (".load x", "dangerous"), ("-- note", "other"), ("CREATE VIEW w AS SELECT 1;", "other"), ("", "other"),
]


@query(f"SELECT [{', '.join(repr(x[1]) for x in _DUMP)}][1 + s_suppkey % {len(_DUMP)}] AS statement, count(*) AS n FROM supplier GROUP BY 1")
def dump_statements(spark, d):
    from lodestrata.operators.audit import statement_counts

    line = F.element_at(F.array(*[F.lit(x[0]) for x in _DUMP]), (F.col("s_suppkey") % len(_DUMP) + 1).cast("int"))
    return statement_counts(table(spark, d, "supplier").select(F.col("s_suppkey").alias("line_no"), line.alias("text")), "text")[0]


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def chat_roles(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return g.select("conv_id", "n_messages", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT doc_id, 3 AS n_messages, 'system,user,assistant' AS roles, sha256(text) AS user_sha256 FROM documents JOIN labels USING (doc_id)")
def training_chats(spark, d):
    messages = B.chat(F.lit("You review code."), F.col("text"), F.when(F.col("toxic") == 1, "present").otherwise("not_observed"))
    rows = _labelled(spark, d).select("doc_id", messages.alias("m"))
    return rows.select("doc_id", F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.sha2(F.col("m")[1]["content"], 256).alias("user_sha256"))


_CLEAN = r"regexp_replace(regexp_replace(replace({x}, chr(0), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s]+|[\s]+$', '', 'g')"
_CUT = r"CASE WHEN length({x}) > {n} THEN regexp_replace(substr({x}, 1, {n}), '[\s]+$', '') || chr(10) || '[TRUNCATED]' ELSE {x} END"


def _canonical_context(excerpt: str, head: str) -> str:
    redacted = r"regexp_replace(c, '(\b[A-Za-z0-9_]*(?:password|api_key|client_secret)[A-Za-z0-9_]*\b)\s*=\s*([^\s,;)}}\]]+)', '\\1 = [REDACTED_SECRET]', 'gi')".replace("}}", "}").replace("\\\\", "\\")
    cut = _CUT.format(x=excerpt, n=4000)
    return f"""x AS (SELECT *, {head} || {cut} AS c FROM t), y AS (SELECT *, {_CLEAN.format(x=redacted)} AS k FROM x), z AS (SELECT *, {_CUT.format(x='k', n=6000)} AS context FROM y)"""


@query(
    f"""WITH {_TOXIC}, {_canonical_context('text', "'Code excerpt:' || chr(10)")}
SELECT doc_id, 'doc-' || doc_id AS id, sha256(context) AS context_sha256, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS risk_level FROM z"""
)
def canonical_records(spark, d):
    rows = _labelled(spark, d).select("doc_id", B.labelled_code_to_canonical(F.col("text"), F.col("toxic"), F.col("source"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("r"))
    return rows.select("doc_id", "r.id", F.sha2("r.input.context", 256).alias("context_sha256"), "r.expected_output.risk_level")


@query(
    rf"""WITH t AS (SELECT doc_id, coalesce(trim(lang), '') AS i, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS g FROM documents)
SELECT doc_id, 'legacy-alpaca-' || lpad(doc_id::VARCHAR, 6, '0') || '-' || substr(sha256(CASE WHEN i = '' THEN g WHEN g = '' THEN i ELSE i || chr(10) || chr(10) || g END), 1, 12) AS id, 'alpaca' AS legacy_format FROM t"""
)
def instruction_adapter(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", B.instruction_to_canonical(F.col("lang"), F.col("text"), F.lit(None).cast("string"), F.col("doc_id")).alias("r"))
    return rows.select("doc_id", "r.id", F.col("r.input.signals")["legacy_format"].alias("legacy_format"))


@query(
    """WITH m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
SELECT conv_id, max(text) FILTER (role = 'user' AND n = 1) AS question, max(text) FILTER (role = 'assistant' AND n = 1) AS answer FROM m GROUP BY 1 HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0"""
)
def question_answer_adapter(spark, d):
    return B.question_and_answer(table(spark, d, "conversations"), "conv_id")


@query(
    f"""WITH {_TOXIC} SELECT doc_id, CASE WHEN trim('Code excerpt:' || chr(10) || text) = '' THEN 'schema' WHEN doc_id % 7 = 0 THEN 'unsafe_guidance' ELSE 'eligible' END AS reason FROM t"""
)
def training_eligibility(spark, d):
    record = B.labelled_code_to_canonical(F.col("text"), F.col("toxic"), F.col("source"), F.col("doc_id").cast("string"))
    expected = F.when(F.col("doc_id") % 7 == 0, "a step-by-step plan").otherwise("a report")
    return _labelled(spark, d).select("doc_id", record.alias("r"), expected.alias("e")).select("doc_id", B.training_reason(F.col("r"), F.col("e")).alias("reason"))


@query(
    r"""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'present' ELSE 'not_observed' END AS assessment, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 IN (1, 4) THEN 'no_observable_target_relation' ELSE 'eligible' END AS reason,
CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 IN (1, 4) THEN NULL ELSE CASE s_suppkey % 5 WHEN 0 THEN 'strcpy(b, s);' WHEN 1 THEN 'strcpy(b, s);' WHEN 2 THEN 'n = n + 1;' WHEN 3 THEN 'q = p->x;' ELSE 'x' END END AS evidence FROM supplier"""
)
def evidence_targets(spark, d):
    rows = _snippets(spark, d).withColumn("label", (F.col("s_suppkey") % 2 == 0).cast("int"))
    return K.evidence_targets(rows, "s_suppkey", "cwe", "code", "label", RULES, {r"strcpy": 9, r"->": 5, r"=": 2}, 1)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) SELECT ceil(k / 10.0)::BIGINT AS packet, count(*) AS n, string_agg('- [' || k || '] ' || doc_id, chr(10) ORDER BY k) AS text FROM r GROUP BY 1")
def review_packets(spark, d):
    from lodestrata.operators.sampling import ranked

    return K.packets(ranked(table(spark, d, "documents").select("doc_id"), "doc_id", "k"), "k", "doc_id", 10)


@query(
    """WITH s AS (SELECT o_orderpriority AS p, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS ok FROM orders GROUP BY 1), r AS (SELECT (ascii(p) - 49) * 10 AS lo, (ascii(p) - 49) * 10 + 9 AS hi, n, ok FROM s), l AS (SELECT *, lo - lag(hi) OVER (ORDER BY lo) - 1 AS s FROM r)
SELECT count(*) AS n_shards, count(*) FILTER (s > 0) AS n_gaps, count(*) FILTER (s < 0) AS n_overlaps, sum(n)::BIGINT AS n_entries, round(sum(ok)::DOUBLE / sum(n), 4) AS success_rate FROM l"""
)
def merged_shards(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    low = (F.ascii("o_orderpriority") - 49) * 10
    return K.merged_shards(s.select(low.alias("lo"), (low + 9).alias("hi"), "n", "ok"), "lo", "hi", "ok", "n")
