"""Supply and coverage audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.rates import ratio, wilson_lower


def coverage(df: DataFrame, predicates: dict[str, Column], distinct: list[str]) -> DataFrame:
    """One row, from one pass: n_rows, rows that satisfy each predicate and all of them, distinct values."""
    everything = None
    for p in predicates.values():
        everything = p if everything is None else everything & p
    return df.agg(
        F.count("*").alias("n_rows"), *[F.count_if(p).alias(f"n_{k}") for k, p in predicates.items()], F.count_if(everything).alias("n_all"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct]
    )


def distribution(df: DataFrame, value: str) -> DataFrame:
    """value, n in descending order of n, then by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value)


def pair_supply(methods: DataFrame, keys: list[str], before: Column) -> DataFrame:
    """Keys with exactly two rows, one before and one after."""
    return methods.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(before).alias("n_before")).where("n_rows = 2 and n_before = 1")


def truthy(value: Column) -> Column:
    """Whether a stored flag is one of 1, True, true."""
    return value.cast("string").isin("1", "True", "true")


def linked_sets(fixes: DataFrame, classes: DataFrame, via: str, key: str, member: str) -> DataFrame:
    """key, members (sorted, comma-joined), n_members over a many-to-many link."""
    found = fixes.join(classes, via).groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("s"))
    return found.select(key, F.array_join(F.col("s").cast("array<string>"), ",").alias("members"), F.size("s").cast("long").alias("n_members"))


def balance(files: DataFrame, methods: DataFrame, key: str, by: str) -> DataFrame:
    """Of each class: distinct files, and methods, files without methods included."""
    joined = files.join(methods.select(key, F.lit(1).alias("_m")), key, "left")
    return joined.groupBy(by).agg(F.countDistinct(key).alias("n_files"), F.count("_m").alias("n_methods"))


def minimum_scale(counts: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """table, n_rows, enough."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", (F.col("n_rows") >= least[name]).alias("enough"))
        out = one if out is None else out.unionAll(one)
    return out


def observation_audit(df: DataFrame, part: str, identity: str, signature: str, label: str) -> DataFrame:
    """One row: rows, observations, groups that repeat or conflict, identities that recur over parts."""
    groups = df.groupBy(part, identity).agg(F.count("*").alias("n"), F.countDistinct(signature).alias("sigs"), F.countDistinct(label).alias("labels"))
    per_part = groups.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_observations"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("sigs") > 1).alias("n_feature_conflicts"), F.count_if(F.col("labels") > 1).alias("n_label_conflicts"), F.max("n").alias("max_multiplicity")
    )
    recurring = groups.groupBy(identity).agg(F.count("*").alias("parts")).agg(F.count_if(F.col("parts") > 1).alias("n_recurring"))
    return per_part.crossJoin(recurring)  # one row each


def varying_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """field, n_groups: in how many groups of repeated rows a field has over one value (nulls are a value)."""
    grouped = df.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.countDistinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f) for f in fields]).where("n > 1")
    counts = grouped.agg(*[F.count_if(F.col(f) > 1).alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_groups")) for f in fields])).alias("x")).select("x.field", "x.n_groups")


def review_summary(reviews: DataFrame, failed: Column, max_error_rate: float, by: str | None = None) -> DataFrame:
    """n, errors, error budget (floor of n times the rate), early_fail, passed."""
    counted = reviews.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))
    budget = F.floor(F.col("n") * F.lit(max_error_rate)).cast("long")
    return counted.select("*", budget.alias("budget"), (F.col("errors") > budget).alias("early_fail"), (F.col("errors") <= budget).alias("passed"))


def all_pass(variants: DataFrame, pair: str, ok: Column) -> DataFrame:
    """One row: pass rates of variants, and of pairs of which all variants pass."""
    pairs = variants.groupBy(pair).agg(F.count("*").alias("n"), F.count_if(ok).alias("k"))
    return pairs.agg(
        F.sum("n").alias("n_variants"), F.count("*").alias("n_pairs"), F.round(ratio(F.sum("k"), F.sum("n")), 4).alias("variant_pass_rate"), F.round(ratio(F.count_if(F.col("n") == F.col("k")), F.count("*")), 4).alias("pair_pass_rate")
    )


def supply_projection(results: DataFrame, passed: Column, needed: int, by: str) -> DataFrame:
    """Of each class: trials, passes, Wilson lower bound, and how many candidates ``needed`` passes take."""
    counted = results.groupBy(by).agg(F.count("*").alias("n"), F.count_if(passed).alias("n_passed"))
    low = wilson_lower(F.col("n_passed"), F.col("n"))
    return counted.select(by, "n", "n_passed", F.round(low, 6).alias("wilson_lower"), F.when(low > 0, F.ceil(F.lit(needed) / low)).cast("long").alias("candidates_needed"))


def contiguous(ranges: DataFrame, by: str, low: str, high: str) -> DataFrame:
    """Of each class: ranges, gaps, overlaps; a range must begin one after the end of the one before."""
    w = Window.partitionBy(by).orderBy(low, high)
    step = F.col(low) - F.lag(high).over(w) - 1
    return ranges.withColumn("_s", step).groupBy(by).agg(F.count("*").alias("n_ranges"), F.count_if(F.col("_s") > 0).alias("n_gaps"), F.count_if(F.col("_s") < 0).alias("n_overlaps"))


def source_decisions(sources: DataFrame, checks: dict[str, Column], blocking: list[str]) -> DataFrame:
    """Adds ``failed_checks`` and ``decision``: rejected if a blocking check fails, review if any, else approved."""
    from lodestrata.functions.rates import failed_names

    failed = failed_names(checks)
    blocked = F.size(F.array_intersect(failed, F.array(*map(F.lit, blocking)))) > 0
    return sources.select("*", F.array_join(failed, ",").alias("failed_checks"), F.when(blocked, "rejected").when(F.size(failed) > 0, "review").otherwise("approved").alias("decision"))


def patch_statistics(text: Column) -> dict[str, Column]:
    """Files, hunks, added and removed lines of a unified diff."""
    lines = F.split(text, "\n")
    count = lambda test: F.size(F.filter(lines, test)).cast("long")
    return {
        "n_files": count(lambda x: x.startswith("diff --git ")),
        "n_hunks": count(lambda x: x.startswith("@@")),
        "n_added": count(lambda x: x.startswith("+") & ~x.startswith("+++")),
        "n_removed": count(lambda x: x.startswith("-") & ~x.startswith("---")),
    }


def statement_counts(lines: DataFrame, column: str, shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts of SQL statements by class; and the first dangerous lines by number (columns line_no, text)."""
    kind = statement_class(F.col(column))
    counts = lines.groupBy(kind.alias("statement")).agg(F.count("*").alias("n"))
    return counts, lines.where(kind == "dangerous").orderBy("line_no").limit(shown)


# What a dump may not hold, and the only pragma it may.
DANGEROUS_STATEMENTS = [
    r"ATTACH\b",
    r"DETACH\b",
    r"ALTER\s+TABLE\b",
    r"CREATE\s+TRIGGER\b",
    r"CREATE\s+VIRTUAL\s+TABLE\b",
    r"DROP\b",
    r"REINDEX\b",
    r"SELECT\s+load_extension\s*\(",
    r"VACUUM\b",
    r"\.(?:load|shell|system)\b",
]
ALLOWED_PRAGMA = r"PRAGMA\s+foreign_keys\s*=\s*OFF\s*;\s*$"


def statement_class(text: Column) -> Column:
    """The class of a dump line: the first that applies. A pragma other than the allowed one is dangerous."""
    rules = [
        ("dangerous", "|".join(DANGEROUS_STATEMENTS)),
        ("pragma", ALLOWED_PRAGMA),
        ("dangerous", r"PRAGMA\b"),
        ("transaction", r"(?:BEGIN|COMMIT|ROLLBACK)\b"),
        ("create", r"CREATE\s+(?:TABLE|(?:UNIQUE\s+)?INDEX)\b"),
        ("insert", r"INSERT\s+INTO\b"),
    ]
    out = F.lit("other")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(rf"(?i)^\s*(?:{pattern})"), name).otherwise(out)
    return out


def missing_tables(lines: DataFrame, column: str, required: list[str]) -> DataFrame:
    """table_name of the required tables that no line of a dump creates."""
    created = F.regexp_extract(column, r'(?i)^CREATE\s+TABLE(?:\s+IF\s+NOT\s+EXISTS)?\s+"?([A-Za-z_][A-Za-z0-9_]*)"?', 1)
    wanted = lines.sparkSession.createDataFrame([(x,) for x in required], "table_name string")
    return wanted.join(lines.select(created.alias("table_name")), "table_name", "left_anti")
