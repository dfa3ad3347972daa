"""Queries: deterministic samples, quotas and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import sampling as S
from lodestrata.operators import splits as P
from lodestrata.plans.registry import query, table


def _u(seed: int, key: str = "doc_id") -> str:
    return f"('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::UBIGINT"


_TEMPER = f"""w AS (SELECT doc_id, source, lang, -ln((({_u(11)})::DOUBLE + 1) / 18446744073709551617.0::DOUBLE) / (pow(count(*) OVER (PARTITION BY lang), -0.25) * pow(count(*) OVER (PARTITION BY source), -0.15)) AS priority FROM documents)"""


@query(f"WITH {_TEMPER} SELECT doc_id, source, round(priority, 6) AS priority FROM w ORDER BY w.priority, doc_id LIMIT 100")
def weighted_sample(spark, d):
    s = S.weighted_sample(table(spark, d, "documents").select("doc_id", "source", "lang"), "lang", "source", "doc_id", 11, 100, None)
    return s.select("doc_id", "source", F.round("priority", 6).alias("priority"))


@query(f"WITH {_TEMPER}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, doc_id) AS k FROM w) SELECT doc_id, source FROM k ORDER BY k > 10, priority, doc_id LIMIT 100")
def capped_weighted_sample(spark, d):
    return S.weighted_sample(table(spark, d, "documents").select("doc_id", "source", "lang"), "lang", "source", "doc_id", 11, 100).select("doc_id", "source")


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_u(13)}, doc_id) AS turn FROM documents) SELECT doc_id, source, turn::INTEGER AS turn FROM r ORDER BY turn, sha256('13:' || source), doc_id LIMIT 60")
def diverse_rank(spark, d):
    return S.round_robin(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 13, 60).select("doc_id", "source", "turn")


@query("SELECT doc_id FROM documents ORDER BY sha256('17' || chr(0) || doc_id), doc_id LIMIT 50")
def top_by_hash(spark, d):
    return S.top_by_hash(table(spark, d, "documents").select("doc_id"), "doc_id", 17, 50)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('17' || chr(0) || doc_id), doc_id) AS n FROM documents) WHERE n <= 10")
def top_by_hash_per_class(spark, d):
    return S.top_by_hash(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 17, 10, ["lang"])


def _quota(counts: str, stratum: str, n: str, target: int, seed: int, name: str) -> str:
    return f"""{name}0 AS (SELECT {stratum}, {n}, {target} * {n} / (sum({n}) OVER ())::DOUBLE AS x FROM {counts}),
{name} AS (SELECT {stratum}, {n}, (floor(x) + (row_number() OVER (ORDER BY floor(x) - x, sha256('{seed}:' || {stratum})) <= {target} - sum(floor(x)) OVER ())::INTEGER)::BIGINT AS quota FROM {name}0)"""


@query(f"WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), {_quota('c', 'source', 'n', 137, 19, 'q')} SELECT source, n, quota FROM q")
def largest_remainder_quotas(spark, d):
    return S.largest_remainder(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n", 137, 19)


@query(
    f"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), {_quota('c', 'source', 'n', 137, 19, 'q')},
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_u(19)}, doc_id) AS k FROM documents) SELECT doc_id, source FROM r JOIN q USING (source) WHERE k <= quota"""
)
def proportional_sample(spark, d):
    return S.proportional_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 137, 19).select("doc_id", "source")


@query(
    f"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), {_quota('c', 'source', 'n', 600, 23, 'q')}, e AS (SELECT source, quota AS n_train, n - quota AS rest FROM q), {_quota('e', 'source', 'rest', 200, 24, 'v')},
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_u(23)}, doc_id) AS k FROM documents)
SELECT doc_id, source, CASE WHEN k <= n_train THEN 'train' WHEN k <= n_train + v.quota THEN 'validation' ELSE 'test' END AS split FROM r JOIN e USING (source) JOIN v USING (source)"""
)
def stratified_split(spark, d):
    return S.stratified_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 600, 200, 23)


@query(
    f"""WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {_u(29)}, doc_id) AS cw FROM documents),
b AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY cw > 1, CASE WHEN cw = 1 THEN source END, {_u(29)}, doc_id)::INTEGER AS sample_rank FROM a) SELECT doc_id, lang, source, sample_rank FROM b WHERE sample_rank <= 25"""
)
def coverage_first_sample(spark, d):
    return S.coverage_first(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 29, 25).select("doc_id", "lang", "source", "sample_rank")


@query(
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_u(31)}, doc_id) AS k, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r"""
)
def ratio_split(spark, d):
    return P.ratio_split(table(spark, d, "documents").select("doc_id"), "doc_id", 31, 0.8, 0.1)


@query("SELECT event_id, CASE WHEN dayofmonth(ts) BETWEEN 1 AND 14 THEN 'fit' WHEN dayofmonth(ts) BETWEEN 15 AND 21 THEN 'calibration' WHEN dayofmonth(ts) BETWEEN 22 AND 28 THEN 'test' END AS split FROM events")
def temporal_split(spark, d):
    return table(spark, d, "events").select("event_id", P.ranged_split(F.dayofmonth("ts"), {"fit": (1, 14), "calibration": (15, 21), "test": (22, 28)}).alias("split"))


@query("SELECT doc_id, CASE WHEN k <= 40 THEN 'train' WHEN k <= 60 THEN 'validation' WHEN k <= 80 THEN 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents)")
def contiguous_quota_split(spark, d):
    rows = S.ranked(table(spark, d, "documents").select("doc_id"), "doc_id", "k")
    return rows.select("doc_id", S.contiguous_split(F.col("k"), [("train", 40), ("validation", 20), ("test", 20)]).alias("split"))


@query(
    f"""WITH g AS (SELECT source || '-' || (doc_id // 20) AS g, toxic, doc_id FROM documents JOIN labels USING (doc_id)), p AS (SELECT g, min(doc_id) FILTER (toxic = 1) AS a, min(doc_id) FILTER (toxic = 0) AS b FROM g GROUP BY 1),
c AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL ORDER BY {_u(37, 'g')}, g LIMIT 20) SELECT g, 1 AS toxic, a AS doc_id FROM c UNION ALL SELECT g, 0, b FROM c"""
)
def whole_pair_holdout(spark, d):
    g = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 20).cast("string"))
    joined = table(spark, d, "documents").select("doc_id", g.alias("g")).join(table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "doc_id")
    return S.whole_pairs(joined, "g", "toxic", "doc_id", 37, 20)


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, min(doc_id) LIMIT 8")
def top_sources(spark, d):
    return S.top_values(table(spark, d, "documents"), "source", "doc_id", 8)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def limited_records(spark, d):
    return S.limited(table(spark, d, "documents").select("doc_id"), 25, ["doc_id"])


@query(
    f"""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_u(41)}, doc_id) AS k FROM documents)
SELECT doc_id, k::INTEGER AS queue_rank, CASE WHEN k <= 15 THEN 'primary' ELSE 'reserve' END AS queue, ceil(k / 10.0)::BIGINT AS packet FROM r WHERE k <= 30"""
)
def queue_with_reserve(spark, d):
    from pyspark.sql import Window

    from lodestrata.functions.hashing import derived_seed

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(derived_seed(41, F.col("doc_id")), "doc_id"))
    r = table(spark, d, "documents").select("doc_id", "lang").withColumn("queue_rank", rank).where("queue_rank <= 30")
    return r.select("doc_id", "queue_rank", F.when(F.col("queue_rank") <= 15, "primary").otherwise("reserve").alias("queue"), F.ceil(F.col("queue_rank") / 10).alias("packet"))


@query()
def category_round_robin(spark, d):
    """Order-dependent greedy choice: SQL cannot express it; tests hold it against a plain loop."""
    joined = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").withColumn("cell", F.concat_ws("|", "lang", (F.col("doc_id") % 3).cast("string")))
    return S.category_round_robin(joined, ["toxic"], "cell", "lang", "source", "doc_id", 43, 30).select("toxic", "doc_id", "project")


@query()
def capped_greedy(spark, d):
    """Order-dependent greedy choice: SQL cannot express it; tests hold it against a plain loop."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 3).alias("commit"))
    return S.capped_greedy(docs, ["lang"], "commit", "source", "doc_id", 47, 40, 3).select("lang", "doc_id", "source")


@query()
def balanced_variants(spark, d):
    """Least-used-first assignment: SQL cannot express it; tests hold it against a plain loop."""
    return S.balanced_variants(table(spark, d, "documents").select("doc_id"), "doc_id", ["gcc-O0", "gcc-O2", "clang-O0", "clang-O2"], 53)


@query()
def unique_content_groups(spark, d):
    """Depends on which groups were kept before: SQL cannot express it; tests hold it against a plain loop."""
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).alias("g"), F.sha2("text", 256).alias("content"))
    return S.unique_content_groups(docs.withColumn("o", F.col("g")), "g", "content", "o")
