"""Queries: membership joins, relational supply audits, coverage and review summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.hashing import pair_key, sha
from lodestrata.functions.rates import failed_names
from lodestrata.functions.text import near_normal
from lodestrata.operators import audit as A
from lodestrata.operators import dedup as D
from lodestrata.operators import overlap as O
from lodestrata.plans import cases as C
from lodestrata.plans.registry import query, table

_SPLIT = "CASE WHEN {u} < 8000 THEN 'train' WHEN {u} < 9000 THEN 'validation' ELSE 'test' END"
SPLIT_SQL = _SPLIT.format(u=C.sql_draw(20260728, "doc_id", 10000))
NEAR_SQL = r"sha256(lower(regexp_replace(regexp_replace(text, '/\*.*?\*/|//[^\n]*', '', 'gs'), '[\s]+', '', 'g')))"


def split_documents(spark, d):
    from lodestrata.functions.hashing import hash_split

    return table(spark, d, "documents").select("doc_id", "source", "lang", hash_split(20260728, F.col("doc_id")).alias("split"), F.sha2("text", 256).alias("content"), F.sha2(near_normal(F.col("text"), r"[\s]"), 256).alias("near"))


_DOCS = f"s AS (SELECT doc_id, source, lang, {SPLIT_SQL} AS split, sha256(text) AS content, {NEAR_SQL} AS near FROM documents)"


@query(f"WITH {_DOCS} SELECT e.doc_id, e.split FROM s e WHERE split != 'train' AND content IN (SELECT content FROM s WHERE split = 'train')")
def contamination_by_hash(spark, d):
    s = split_documents(spark, d)
    seen = s.where("split = 'train'").select(F.col("content"))
    return s.where("split != 'train'").join(seen.distinct(), "content", "left_semi").select("doc_id", "split")


@query(f"WITH {_DOCS}, m AS (SELECT doc_id, split, unnest([source, lang || '-' || source]) AS mark FROM s) SELECT DISTINCT doc_id, upper(mark) AS mark FROM m WHERE split = 'test' AND upper(mark) IN (SELECT upper(mark) FROM m WHERE split = 'validation')")
def contamination_by_marks(spark, d):
    s = split_documents(spark, d).withColumn("marks", F.array("source", F.concat_ws("-", "lang", "source")))
    return O.shared_marks(s.where("split = 'validation'"), s.where("split = 'test'"), "doc_id", "marks").select("doc_id", "mark")


@query(f"WITH {_DOCS} SELECT doc_id FROM s WHERE split = 'test' AND near NOT IN (SELECT near FROM s WHERE split = 'train' UNION ALL SELECT content FROM s WHERE split = 'train')")
def fingerprint_exclusion(spark, d):
    s = split_documents(spark, d)
    return O.untrained(s.where("split = 'test'"), s.where("split = 'train'").select(F.col("near").alias("h1"), F.col("content").alias("h2")), "near", ["h1", "h2"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def untouched_subset(spark, d):
    fresh, _ = O.untouched(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
    return fresh


@query("SELECT doc_id, 'right' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def id_set_difference(spark, d):
    return O.symmetric_difference(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query(
    f"""WITH {_DOCS}, f AS (SELECT s.doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY ('0x' || substr(sha256('5:' || s.doc_id), 1, 16))::UBIGINT, s.doc_id) AS n
FROM s JOIN labels USING (doc_id) WHERE split = 'test' AND content NOT IN (SELECT content FROM s WHERE split = 'train')) SELECT doc_id, toxic FROM f WHERE n <= 10"""
)
def balanced_blind_challenge(spark, d):
    s = split_documents(spark, d)
    held = s.where("split = 'test'").join(table(spark, d, "labels"), "doc_id")
    return O.balanced_blind_sample(held, s.where("split = 'train'"), "doc_id", "content", "toxic", 10, 5).select("doc_id", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id LIMIT 50")
def review_queue(spark, d):
    labels = table(spark, d, "labels")
    return O.open_queue(table(spark, d, "documents").select("doc_id"), [labels.where("quality = 0"), labels.where("toxic = 1")], "doc_id", "doc_id", 50)


@query(
    """WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
r AS (SELECT source, doc_id AS replacement, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT f.source, f.k::INTEGER AS k, f.doc_id, r.replacement FROM f LEFT JOIN r USING (source, k)"""
)
def positional_replacements(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").withColumn("rank", F.col("doc_id"))
    return O.replacements(joined.where("quality = 0"), joined.where("quality = 1"), "doc_id", "rank", "source")


@query("SELECT doc_id, 'n_chars' AS field FROM documents WHERE n_chars != length(text) UNION ALL SELECT doc_id, 'lang' FROM documents WHERE lang != 'en' AND source = 'src1'")
def contract_mismatches(spark, d):
    docs = table(spark, d, "documents")
    left = docs.select("doc_id", "n_chars", "lang")
    right = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.when(F.col("source") == "src1", "en").otherwise(F.col("lang")).alias("lang"))
    return O.field_mismatches(left, right, "doc_id", ["n_chars", "lang"])


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'manifest_missing' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS bucket, count(*) AS n FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def manifest_join(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    bucket = F.when(F.col("known").isNull(), "manifest_missing").when(F.col("quality") == 1, "good").otherwise("bad")
    return joined.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS orderkey, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS members, count(DISTINCT p_brand) AS n_members FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def linked_brand_sets(spark, d):
    fixes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey"))
    classes = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_brand"))
    return A.linked_sets(fixes, classes, "partkey", "orderkey", "p_brand")


@query("SELECT l_partkey, l_suppkey, count(*) AS n_rows, count(*) FILTER (l_returnflag = 'R') AS n_before FROM lineitem GROUP BY ALL HAVING count(*) = 2 AND count(*) FILTER (l_returnflag = 'R') = 1")
def pair_supply(spark, d):
    return A.pair_supply(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], F.col("l_returnflag") == "R")


@query(
    """WITH m AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS orderkey FROM lineitem GROUP BY ALL HAVING count(*) = 2 AND count(*) FILTER (l_returnflag = 'R') = 1)
SELECT m.l_partkey, m.l_suppkey, o_orderstatus, n_name FROM m JOIN orders ON orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def pair_supply_joined(spark, d):
    keys = ["l_partkey", "l_suppkey"]
    lines = table(spark, d, "lineitem").select(*keys, "l_orderkey", "l_returnflag")
    pairs = lines.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("b"), F.min("l_orderkey").alias("o_orderkey")).where("n = 2 and b = 1")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    return pairs.join(orders, "o_orderkey").join(customers, "o_custkey", "left").join(nations, "n_nationkey", "left").select(*keys, "o_orderstatus", "n_name")


@query("SELECT o_orderstatus, count(DISTINCT o_orderkey) AS n_files, count(l_orderkey) AS n_methods FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY 1")
def file_method_balance(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    methods = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return A.balance(files, methods, "key", "o_orderstatus")


@query("SELECT l_returnflag, count(*) AS n, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS n_large FROM lineitem GROUP BY 1")
def conditional_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).cast("long").alias("n_large"))


_LEAST = {"region": 5, "nation": 25, "supplier": 50, "customer": 5000, "part": 1000}


@query(" UNION ALL ".join(f"SELECT '{k}' AS table_name, count(*) AS n_rows, count(*) >= {v} AS enough FROM {k}" for k, v in _LEAST.items()))
def minimum_scale(spark, d):
    return A.minimum_scale({k: table(spark, d, k) for k in _LEAST}, _LEAST)


@query(
    """SELECT count(*) AS n_rows, count(*) FILTER (o_totalprice > 1000) AS n_priced, count(*) FILTER (o_orderstatus = 'F') AS n_closed, count(*) FILTER (o_custkey % 2 = 0) AS n_even,
 count(*) FILTER (o_totalprice > 1000 AND o_orderstatus = 'F' AND o_custkey % 2 = 0) AS n_all, count(DISTINCT o_custkey) AS distinct_o_custkey, count(DISTINCT o_orderpriority) AS distinct_o_orderpriority FROM orders"""
)
def field_coverage(spark, d):
    c = F.col
    return A.coverage(table(spark, d, "orders"), {"priced": c("o_totalprice") > 1000, "closed": c("o_orderstatus") == "F", "even": c("o_custkey") % 2 == 0}, ["o_custkey", "o_orderpriority"])


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_distribution(spark, d):
    return A.distribution(table(spark, d, "orders"), "o_orderpriority")


@query(
    """WITH e AS (SELECT dayofmonth(ts) AS day, user_id, event_type, value > 50 AS label FROM events),
g AS (SELECT day, user_id, count(*) AS n, count(DISTINCT event_type) AS s, count(DISTINCT label) AS l FROM e GROUP BY ALL), r AS (SELECT user_id, count(*) AS p FROM g GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_observations, count(*) FILTER (n > 1) AS n_repeated, count(*) FILTER (s > 1) AS n_feature_conflicts, count(*) FILTER (l > 1) AS n_label_conflicts, max(n) AS max_multiplicity,
 (SELECT count(*) FILTER (p > 1) FROM r) AS n_recurring FROM g"""
)
def observation_audit(spark, d):
    e = table(spark, d, "events").select(F.dayofmonth("ts").alias("day"), "user_id", "event_type", (F.col("value") > 50).alias("label"))
    return A.observation_audit(e, "day", "user_id", "event_type", "label")


@query(
    """WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b, count(DISTINCT l_quantity) AS c FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT unnest(['l_returnflag', 'l_linestatus', 'l_quantity']) AS field, unnest([count(*) FILTER (a > 1), count(*) FILTER (b > 1), count(*) FILTER (c > 1)]) AS n_groups FROM g"""
)
def varying_fields(spark, d):
    return A.varying_fields(table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus", "l_quantity"])


@query(
    """SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (length(trim(text)) = 0) AS n_empty, count(*) - count(DISTINCT text) AS n_duplicates,
 min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 4) AS mean_chars FROM documents"""
)
def null_and_length_profile(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "documents").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.length(F.trim("text")) == 0).alias("n_empty"), (F.count("*") - F.countDistinct(F.sha2("text", 256))).alias("n_duplicates"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 4).alias("mean_chars")
    )


@query(
    r"""WITH r AS (SELECT nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS repository FROM pages)
SELECT repository, count(*) AS n, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 6) AS share FROM r WHERE repository IS NOT NULL GROUP BY 1"""
)
def repository_attribution(spark, d):
    found = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("repository"))
    total = found.agg(F.count("*").alias("total"))
    ranked = found.where("repository != ''").groupBy("repository").agg(F.count("*").alias("n")).crossJoin(total)  # one row of total
    return ranked.select("repository", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.col("n").desc(), "repository")


@query(f"WITH {_DOCS} SELECT split, lang, count(*) AS supply, least(count(*), 30) AS taken, greatest(0, 30 - count(*)) AS short FROM s GROUP BY ALL")
def quota_supply(spark, d):
    from lodestrata.operators.sampling import quotas_met

    return quotas_met(split_documents(spark, d), ["split", "lang"], 30)


@query(f"WITH {_DOCS} SELECT 'split' AS field, split AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM s GROUP BY 2")
def profile_summary(spark, d):
    s = split_documents(spark, d)
    pairs = s.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("split", "lang", "source")])).alias("x"))
    return pairs.groupBy("x.field", "x.value").agg(F.count("*").alias("n")).select("field", "value", "n")


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS errors, floor(count(*) * 0.1)::BIGINT AS budget, count(*) FILTER (quality = 0) > floor(count(*) * 0.1) AS early_fail,
 count(*) FILTER (quality = 0) <= floor(count(*) * 0.1) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY 1"""
)
def review_summary(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return A.review_summary(joined, F.col("quality") == 0, 0.1, "source")


@query(
    """WITH p AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity > 5) AS k FROM lineitem GROUP BY 1)
SELECT sum(n)::BIGINT AS n_variants, count(*) AS n_pairs, round(sum(k)::DOUBLE / sum(n), 4) AS variant_pass_rate, round((count(*) FILTER (n = k))::DOUBLE / count(*), 4) AS pair_pass_rate FROM p"""
)
def all_variants_pass(spark, d):
    return A.all_pass(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 5)


@query(
    """WITH a AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS n_passed FROM documents JOIN labels USING (doc_id) GROUP BY 1),
w AS (SELECT *, (n_passed / n::DOUBLE + 1.96::DOUBLE * 1.96::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(((n_passed / n::DOUBLE) * (1 - n_passed / n::DOUBLE) + 1.96::DOUBLE * 1.96::DOUBLE / (4 * n)) / n)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n) AS lo FROM a)
SELECT source, n, n_passed, round(lo, 6) AS wilson_lower, CASE WHEN lo > 0 THEN ceil(100 / lo)::BIGINT END AS candidates_needed FROM w"""
)
def supply_projection(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return A.supply_projection(joined, F.col("quality") == 1, 100, "source")


@query(
    """WITH s AS (SELECT o_custkey, o_orderkey - lag(o_orderkey + 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS s FROM orders)
SELECT o_custkey, count(*) AS n_ranges, count(*) FILTER (s > 0) AS n_gaps, count(*) FILTER (s < 0) AS n_overlaps FROM s GROUP BY 1"""
)
def shard_contiguity(spark, d):
    return A.contiguous(table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") + 3).alias("high")), "o_custkey", "o_orderkey", "high")


@query(
    """WITH a AS (SELECT source, count(*) AS n, avg(quality) AS q, avg(toxic) AS t FROM documents JOIN labels USING (doc_id) GROUP BY 1),
f AS (SELECT *, list_sort(list_filter([CASE WHEN NOT n >= 15 THEN 'minimum_rows' END, CASE WHEN NOT q >= 0.8 THEN 'quality' END, CASE WHEN NOT t <= 0.15 THEN 'toxicity' END], lambda x: x IS NOT NULL)) AS fl FROM a)
SELECT source, n, array_to_string(fl, ',') AS failed_checks, CASE WHEN list_contains(fl, 'toxicity') THEN 'rejected' WHEN len(fl) > 0 THEN 'review' ELSE 'approved' END AS decision FROM f"""
)
def source_decisions(spark, d):
    a = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    checks = {"minimum_rows": F.col("n") >= 15, "quality": F.col("q") >= 0.8, "toxicity": F.col("t") <= 0.15}
    return A.source_decisions(a, checks, ["toxicity"]).drop("q", "t")


@query(
    r"""WITH t AS (SELECT page_id, list_filter(string_split(html, chr(10)), lambda x: true) AS l FROM pages)
SELECT page_id, len(list_filter(l, lambda x: starts_with(x, 'diff --git '))) AS n_files, len(list_filter(l, lambda x: starts_with(x, '@@'))) AS n_hunks,
 len(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS n_added, len(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS n_removed FROM t"""
)
def patch_statistics(spark, d):
    return table(spark, d, "pages").select("page_id", *[v.alias(k) for k, v in A.patch_statistics(F.col("html")).items()])


@query(f"WITH {_DOCS}, c AS (SELECT near, count(*) AS c FROM s GROUP BY 1) SELECT sum(c)::BIGINT AS n, sum(c - 1)::BIGINT AS duplicate_mass, round(max(c)::DOUBLE / sum(c), 6) AS max_share FROM c")
def duplicate_mass(spark, d):
    return D.duplicate_mass(split_documents(spark, d), "near")


@query(f"WITH {_DOCS} SELECT content, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_isolation(spark, d):
    from lodestrata.operators.splits import isolation_violations

    return isolation_violations(split_documents(spark, d), "content")


@query(f"WITH {_DOCS}, x AS (SELECT near, array_to_string(list_sort(list_distinct(list(split))), '+') AS splits FROM s GROUP BY 1) SELECT splits, count(*) AS n_keys FROM x GROUP BY 1")
def split_overlap_counts(spark, d):
    from lodestrata.operators.splits import overlap_counts

    return overlap_counts(split_documents(spark, d), "near")


@query("SELECT 'binary-group-' || substr(sha256(o_orderkey || ':' || o_orderstatus), 1, 16) AS pair_key, o_orderkey, o_orderstatus FROM orders")
def opaque_pair_keys(spark, d):
    return table(spark, d, "orders").select(pair_key(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("pair_key"), "o_orderkey", "o_orderstatus")


@query(
    """WITH v AS (SELECT l_orderkey, min(l_quantity) FILTER (l_linenumber = 1) AS baseline FROM lineitem GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, l_quantity < baseline AS below_baseline FROM lineitem l JOIN v USING (l_orderkey) WHERE l_linenumber > 1 AND baseline IS NOT NULL"""
)
def baseline_self_join(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    base = l.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_quantity").alias("baseline"))
    return l.where("l_linenumber > 1").join(base, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("l_quantity") < F.col("baseline")).alias("below_baseline"))


@query("SELECT substr(sha256(text), 1, 12) AS key, count(DISTINCT source) AS n_payloads FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def union_conflicts(spark, d):
    docs = table(spark, d, "documents").select(sha(F.col("text"), 12).alias("key"), "source", "lang")
    _, conflicts = D.union_checked([docs.where("lang = 'en'"), docs.where("lang != 'en'"), docs.where("lang is null")], "key", "source")
    return conflicts


@query("SELECT doc_id, source, CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'approved' ELSE 'rejected' END AS decision FROM documents LEFT JOIN labels l USING (doc_id)")
def review_decisions(spark, d):
    decided = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"))
    return table(spark, d, "documents").select("doc_id", "source").join(decided, "doc_id", "left").select("doc_id", "source", F.coalesce("decision", F.lit("pending")).alias("decision"))


@query("SELECT coalesce(l.toxic::VARCHAR, 'default') AS policy, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) l USING (doc_id) GROUP BY 1")
def policy_expansion(spark, d):
    override = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.col("toxic").cast("string").alias("override"))
    joined = table(spark, d, "documents").select("doc_id").join(override, "doc_id", "left")
    return joined.groupBy(F.coalesce("override", F.lit("default")).alias("policy")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props) AND json_type(props) = 'OBJECT') AS n_objects, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS n_with_key FROM events GROUP BY 1")
def json_schema_variants(spark, d):
    from lodestrata.functions.structures import is_json_object

    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(is_json_object(F.col("props"))).alias("n_objects"), F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("n_with_key"))


@query("SELECT array_to_string(list_sort(list_filter([CASE WHEN NOT (SELECT count(*) FROM documents) >= 500 THEN 'documents' END, CASE WHEN NOT (SELECT count(*) FROM labels) >= 5000 THEN 'labels' END], lambda x: x IS NOT NULL)), ',') AS failed_checks")
def gate_rollup(spark, d):
    counts = table(spark, d, "documents").agg(F.count("*").alias("n_docs")).crossJoin(table(spark, d, "labels").agg(F.count("*").alias("n_labels")))  # one row each
    return counts.select(F.array_join(failed_names({"documents": F.col("n_docs") >= 500, "labels": F.col("n_labels") >= 5000}), ",").alias("failed_checks"))
