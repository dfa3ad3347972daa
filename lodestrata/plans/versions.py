"""Queries: round trips, carried reviews, hooks, feature layouts, two stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import structures as S
from lodestrata.operators import evaluation as E
from lodestrata.operators import hooks as H
from lodestrata.operators import versions as V
from lodestrata.plans import cases as C
from lodestrata.plans.formats import _folder
from lodestrata.plans.gates import _ASSESSED, _DECIDES, _LINES, _checked, _gold, _predictions
from lodestrata.plans.registry import query, table

_TRIP = f"""
b AS (SELECT doc_id, text, lang, {C.sql_draw(81, modulus=20)} AS u FROM documents),
s AS (SELECT doc_id, text, lang FROM b WHERE u <> 0 UNION ALL SELECT doc_id, text, lang FROM b WHERE u = 1),
t AS (SELECT doc_id, CASE WHEN u = 2 THEN upper(text) ELSE text END AS text, CASE WHEN u = 3 THEN NULL ELSE lang END AS lang FROM b WHERE u <> 4 UNION ALL SELECT doc_id, text || '!', lang FROM b WHERE u = 5),
x AS (SELECT doc_id, CASE WHEN u = 6 THEN text || ' ' ELSE text END AS text FROM b WHERE u NOT IN (4, 7)),
sa AS (SELECT doc_id, count(*) AS n, min(text) AS text, min(lang) AS lang FROM s GROUP BY doc_id),
ta AS (SELECT doc_id, count(*) AS n, min(text) AS text, min(lang) AS lang, count(DISTINCT text) > 1 AS td FROM t GROUP BY doc_id),
xa AS (SELECT doc_id, count(*) AS n, min(text) AS text FROM x GROUP BY doc_id),
j AS (SELECT coalesce(sa.doc_id, ta.doc_id, xa.doc_id) AS doc_id, sa.n AS sn, ta.n AS tn, xa.n AS xn, sa.text AS st, ta.text AS tt, xa.text AS xt, sa.lang AS sl, ta.lang AS tl, td
  FROM sa FULL JOIN ta ON sa.doc_id = ta.doc_id FULL JOIN xa ON xa.doc_id = coalesce(sa.doc_id, ta.doc_id)),
p AS (SELECT doc_id, list_sort(list_filter([CASE WHEN sn IS NULL THEN 'missing:source' END, CASE WHEN tn IS NULL THEN 'missing:target' END, CASE WHEN xn IS NULL THEN 'missing:export' END,
  CASE WHEN sn > 1 THEN 'repeated:source' END, CASE WHEN tn > 1 THEN 'repeated:target' END, CASE WHEN td THEN 'unclear:target:text' END,
  CASE WHEN sn > 0 AND tn > 0 AND st IS DISTINCT FROM tt THEN 'differs:target:text' END, CASE WHEN sn > 0 AND tn > 0 AND sl IS DISTINCT FROM tl THEN 'differs:target:lang' END,
  CASE WHEN sn > 0 AND xn > 0 AND st IS DISTINCT FROM xt THEN 'differs:export:text' END], lambda y: y IS NOT NULL)) AS problems FROM j)"""


@query(f"WITH {_TRIP} SELECT doc_id, array_to_string(problems, ',') AS problems FROM p")
def round_trip_problems(spark, d):
    b = table(spark, d, "documents").select("doc_id", "text", "lang", C.draw(81, modulus=20).alias("u"))
    u, own = F.col("u"), ["doc_id", "text", "lang"]
    source = b.where(u != 0).select(*own).unionAll(b.where(u == 1).select(*own))
    target = b.where(u != 4).select("doc_id", F.when(u == 2, F.upper("text")).otherwise(F.col("text")).alias("text"), F.when(u != 3, F.col("lang")).alias("lang"))
    target = target.unionAll(b.where(u == 5).select("doc_id", F.concat("text", F.lit("!")), "lang"))
    export = b.where(~u.isin(4, 7)).select("doc_id", F.when(u == 6, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text"))
    found = V.round_trip({"source": source, "target": target, "export": export}, "doc_id", {"source": ["text", "lang"], "target": ["text", "lang"], "export": ["text"]})
    return found.select("doc_id", F.array_join("problems", ",").alias("problems"))


_REVIEWED = f"""
b AS (SELECT doc_id, text, lang, source, {C.sql_draw(82, modulus=12)} AS u FROM documents),
r AS (SELECT doc_id, text, lang, CASE WHEN u = 1 THEN 'fail' ELSE 'pass' END AS status, u <> 2 AS clean FROM b WHERE u <> 0 UNION ALL SELECT doc_id, text, lang, 'fail', true FROM b WHERE u = 3),
q AS (SELECT doc_id, CASE WHEN u = 4 THEN text || 'x' ELSE text END AS text, CASE WHEN u = 5 THEN NULL ELSE lang END AS lang, u <> 6 AS compact FROM b),
e AS (SELECT doc_id, text, lang, min(status) AS status, count(DISTINCT status) AS kinds, bool_and(status = 'pass' AND clean) AS ok FROM r GROUP BY ALL),
o AS (SELECT q.doc_id, CASE WHEN q.doc_id NOT IN (SELECT doc_id FROM r) THEN 'new' WHEN e.kinds IS NULL THEN 'stale' WHEN e.kinds > 1 THEN 'ambiguous' WHEN NOT ok THEN 'not_reusable' WHEN NOT compact THEN 'not_compact' ELSE 'carried' END AS outcome, e.status
  FROM q LEFT JOIN e ON e.doc_id = q.doc_id AND e.text IS NOT DISTINCT FROM q.text AND e.lang IS NOT DISTINCT FROM q.lang)"""


@query(f"WITH {_REVIEWED} SELECT doc_id, outcome, CASE WHEN outcome = 'carried' THEN status END AS carried_decision FROM o")
def carried_review_outcomes(spark, d):
    b = table(spark, d, "documents").select("doc_id", "text", "lang", C.draw(82, modulus=12).alias("u"))
    u = F.col("u")
    reviews = b.where(u != 0).select("doc_id", "text", "lang", F.when(u == 1, "fail").otherwise("pass").alias("status"), (u != 2).alias("clean"))
    reviews = reviews.unionAll(b.where(u == 3).select("doc_id", "text", "lang", F.lit("fail"), F.lit(True)))
    queue = b.select("doc_id", F.when(u == 4, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.when(u != 5, F.col("lang")).alias("lang"), (u != 6).alias("compact"))
    found = V.carried_reviews(reviews, queue, "doc_id", ["text", "lang"], "status", (F.col("status") == "pass") & F.col("clean"), F.col("compact"))
    return found.select("doc_id", "outcome", "carried_decision")


def word_tokenizer():
    """Words, numbers and single signs: a tokenizer for where no vocabulary is at hand."""
    import re

    pattern = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]", re.ASCII)
    return lambda texts: [len(pattern.findall(x)) for x in texts]


@query(r"WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\t-\r ]')) AS n_tokens FROM documents) SELECT doc_id, n_tokens, n_tokens > 512 AS over_cutoff FROM t")
def hooked_token_counts(spark, d):
    rows = H.with_token_counts(table(spark, d, "documents").select("doc_id", "text"), "text", word_tokenizer)
    return rows.select("doc_id", "n_tokens", (F.col("n_tokens") > 512).alias("over_cutoff"))


def counting_backend():
    """A stand-in for a model: it answers with the number of words, and fails on what has more than 400."""

    def answer(chats):
        out = []
        for chat in chats:
            words = len(chat[-1]["content"].split(" "))
            if words > 400:
                raise OverflowError(f"{words} words")
            out.append(f'{{"words":{words}}}')
        return out

    return answer


@query(
    """WITH t AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS record_id, CASE WHEN n <= 400 THEN '{"words":' || n || '}' END AS raw_output, CASE WHEN n > 400 THEN 'OverflowError: ' || n || ' words' END AS error, 2 AS prompt_message_count, 'mock' AS model_id FROM t"""
)
def generated_answers(spark, d):
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    docs = table(spark, d, "documents").where("text is not null")
    chats = docs.select("doc_id", F.array(message("system", F.lit("Count.")), message("user", F.col("text"))).alias("messages"))
    path = f"{_folder(spark)}/answers"
    H.generated(chats, "doc_id", "messages", counting_backend, path, "mock", "r1", waves=4, stop_after=2)  # a run that stops
    return H.generated(chats, "doc_id", "messages", counting_backend, path, "mock", "r1", waves=4).select("record_id", "raw_output", "error", "prompt_message_count", "model_id")


_NAMES = [f"kind{k}" for k in range(77)]
#: A general part, two histograms and the figures of strings: 696 of 2568 places.
_LAYOUT = [("general", 7), ("bytes", 256), ("entropy", 256), ("string_figures", 3), ("printable", 96), ("string_entropy", 1), ("string_kinds", 77)]
_AT = [1, 7, 8, 263, 264, 519, 520, 522, 523, 618, 619, 620, 696, 697, 2568]
_E = "list_transform(embedding, lambda x: abs(x)::DOUBLE)"


@query(
    f"""WITH v AS (SELECT vec_id, label, {_E} AS e FROM embeddings),
h AS (SELECT vec_id, label, e, list_transform(range(256), lambda i: e[1 + i % 64]) AS b, list_transform(range(256), lambda i: CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE e[1 + i % 7] END) AS y, list_transform(range(96), lambda i: e[1 + i % 11]) AS p FROM v),
l AS (SELECT vec_id, list_transform(range(7), lambda i: e[1 + i]) || list_transform(b, lambda x: x / list_reduce(list_prepend(0.0::DOUBLE, b), lambda m, n: m + n))
  || CASE WHEN vec_id % 5 = 0 THEN y ELSE list_transform(y, lambda x: x / list_reduce(list_prepend(0.0::DOUBLE, y), lambda m, n: m + n)) END || [e[1], e[2], label::DOUBLE] || CASE WHEN label > 0 THEN list_transform(p, lambda x: x / label) ELSE p END || [e[3]]
  || list_transform(range(77), lambda i: CASE WHEN i = label * 3 THEN 5.0 WHEN i = 76 THEN 2.0 ELSE 0.0 END) || list_transform(range(1872), lambda i: 0.0) AS f FROM h)
SELECT vec_id, len(f) AS dims, array_to_string(list_transform({_AT}, lambda i: round(f[i] * 1000000)::BIGINT), ',') AS places FROM l"""
)
def layout_places(spark, d):
    e = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", "label", e.alias("e"))
    e, label, one = F.col("e"), F.col("label"), F.lit(1)
    spread = lambda n, m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(e, (one + i % m).cast("int")))
    kinds = F.map_from_entries(F.array_distinct(F.array(F.struct(F.concat(F.lit("kind"), (label * 3).cast("string")), F.lit(5)), F.struct(F.lit("kind76"), F.lit(2)), F.struct(F.lit("unknown"), F.lit(9)))))
    parts = {
        "general": F.slice(e, 1, 7),
        "bytes": S.shares(spread(256, 64)),
        "entropy": S.shares(F.transform(spread(256, 7), lambda x: F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(x))),
        "string_figures": F.array(e[0], e[1], label.cast("double")),
        "printable": S.relative_to(spread(96, 11), label),
        "string_entropy": F.array(e[2]),
        "string_kinds": S.by_vocabulary(kinds, _NAMES),
    }
    found = rows.select("vec_id", S.features_by_layout(parts, _LAYOUT, 2568).alias("f"))
    wanted = F.transform(F.array(*map(F.lit, _AT)), lambda i: F.round(F.element_at("f", i) * 1000000).cast("long").cast("string"))
    return found.select("vec_id", F.size("f").cast("long").alias("dims"), F.array_join(wanted, ",").alias("places"))


_EVIDENCE = f"""{_ASSESSED}, s2 AS (SELECT doc_id, {C.sql_draw(63)} AS w FROM labels),
k2 AS (SELECT doc_id, (doc_id % 7 + 1)::INTEGER AS k, w, CASE WHEN w < 30 THEN 2 ELSE 1 END AS step FROM s2),
m2 AS (SELECT count(*) AS n, true AS complete, 1.0 AS parse_rate, 1.0 AS schema_rate, 1.0 AS renderer_rate, round(avg(CASE WHEN step = 1 THEN 1.0 ELSE 0.5 END), 4) AS evidence_precision, round(avg(CASE WHEN step = 1 THEN 1.0 ELSE 0.5 END), 4) AS evidence_recall FROM k2),
t1 AS (SELECT doc_id, {C.sql_draw(64)} AS x FROM labels),
ms AS (SELECT CASE WHEN x % 11 <> 0 AND p.doc_id IS NOT NULL THEN (100 + x % 50)::DOUBLE END + (40 + w % 30)::DOUBLE AS ms FROM t1 JOIN s2 USING (doc_id) LEFT JOIN pa p USING (doc_id)),
o2 AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM ms WHERE ms IS NOT NULL),
d1 AS (SELECT {_checked(_DECIDES)} FROM kd), d2 AS (SELECT {_checked(_LINES)} FROM m2)"""


@query(
    f"""WITH {_EVIDENCE} SELECT d1.passed AS decision_passed, d1.failed_checks AS decision_failed, d2.passed AS evidence_passed, d2.failed_checks AS evidence_failed, true AS same_cases,
(SELECT max(ms) FILTER (i = floor((n - 1) * 0.5)) FROM o2) AS latency_p50_ms, (SELECT max(ms) FILTER (i = floor((n - 1) * 0.95)) FROM o2) AS latency_p95_ms, d1.passed AND d2.passed AS passed FROM d1, d2"""
)
def two_stage_over_two_sets(spark, d):
    labels = table(spark, d, "labels").select("doc_id")
    timed = lambda seed, ms: table(spark, d, "documents").select("doc_id", C.draw(seed).alias("x")).select("doc_id", ms.alias("latency_ms"))
    x = F.col("x")
    decisions = _predictions(spark, d).join(timed(64, F.when(x % 11 != 0, (100 + x % 50).cast("double"))), "doc_id")
    k = (F.col("doc_id") % 7 + 1).cast("int")
    answers = labels.select("doc_id", C.draw(63).alias("w")).select(
        "doc_id", F.concat(F.lit('{"assessment":"present","basis":"b","evidence":['), k.cast("string"), F.lit(","), (k + F.when(F.col("w") < 30, 2).otherwise(1)).cast("string"), F.lit("]}")).alias("raw_output"), (40 + F.col("w") % 30).cast("double").alias("latency_ms")
    )
    records = labels.select("doc_id", F.lit(9).alias("n_lines"))
    return E.two_stage(_gold(spark, d).select("doc_id", "is_positive"), decisions, labels, _gold(spark, d).select("doc_id", "gold_lines"), records, answers, "doc_id")
