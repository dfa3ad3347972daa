"""Candidate pools, pairs, evidence and review: rules over curated records."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.hashing import sha
from lodestrata.functions.structures import least_confidence
from lodestrata.functions.text import UNICODE_INK

# Prefixes, aliases and limits that results depend on.
CRASH_FAMILIES = {
    "heap-buffer-overflow read": "heap_buffer_read",
    "heap-buffer-overflow write": "heap_buffer_write",
    "stack-buffer-overflow read": "stack_buffer_read",
    "stack-buffer-overflow write": "stack_buffer_write",
}
FIELD_ALIASES = {
    "repository": ["repo", "repository", "github", "url"],
    "repository_license": ["license", "licence", "spdx"],
    "compiler": ["compiler", "toolchain"],
    "optimization": ["optimization", "opt", "cflags", "flags"],
    "architecture": ["architecture", "arch", "machine"],
    "binary_pointer": ["path", "binary", "file"],
    "source_code": ["source", "code", "content"],
    "function_identity": ["function", "name", "rva", "address"],
}
MAX_SPANS = 8
ASSEMBLY_LIMIT, IMPORT_LIMIT, STRING_LIMIT = 24, 32, 16
SHORT_BODY, COLLAPSE_RATIO = 120, 0.15


def crash_family(crash_type: Column) -> Column:
    """Family of a crash type by its beginning; null without one."""
    out = F.lit(None).cast("string")
    for prefix, family in reversed(CRASH_FAMILIES.items()):
        out = F.when(F.startswith(F.lower(crash_type), F.lit(prefix)), family).otherwise(out)
    return out


def eligible_reports(df: DataFrame, flags: list[str], language: str, languages: list[str], required: list[str]) -> DataFrame:
    """Rows with all flags set, an accepted language, and no required field blank."""
    keep = F.lower(language).isin(languages)
    for f in flags:
        keep = keep & F.coalesce(F.col(f), F.lit(False))
    for f in required:
        keep = keep & F.coalesce(F.col(f).cast("string"), F.lit("")).rlike(UNICODE_INK)
    return df.where(keep)


def before_after(rows: DataFrame, before: str, after: str, verified: Column) -> DataFrame:
    """One row for the state before, and one for that after if the pair is verified: side, code, label."""
    sides = F.array_compact(
        F.array(
            F.struct(F.lit("vulnerable_before").alias("side"), F.col(before).alias("code"), F.lit(1).alias("label")),
            F.when(verified, F.struct(F.lit("fixed_after").alias("side"), F.col(after).alias("code"), F.lit(0).alias("label"))),
        )
    )
    return rows.select(*[c for c in rows.columns if c not in (before, after)], F.explode(sides).alias("x")).select("*", "x.side", "x.code", "x.label").drop("x")


def pair_verified(label: Column, before: Column, after: Column, patch: Column, cwe: Column) -> Column:
    return F.coalesce((label == 1) & (before != after) & patch.rlike(UNICODE_INK) & cwe.rlike(UNICODE_INK), F.lit(False))


def pair_reasons(rows: DataFrame, group: str, label: str, same: str, content: str, seed: int) -> DataFrame:
    """group, pair_id, reason: the first structural rule that a group of two labelled records breaks; ``eligible`` if none."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("ones"), F.countDistinct(same).alias("same"), F.countDistinct(content).alias("contents"))
    reason = (
        F.when(F.col("n") != 2, "pair_must_contain_exactly_two_records")
        .when(F.col("ones") != 1, "pair_must_have_one_present_and_one_not_observed")
        .when(F.col("same") != 1, "pair_scope_mismatch")
        .when(F.col("contents") != 2, "pair_code_hashes_must_be_distinct")
        .otherwise("eligible")
    )
    return g.select(group, sha(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string")), 16).alias("pair_id"), reason.alias("reason"))


def reason_histogram(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def pair_sides(rows: DataFrame, pair: str, label: str, value: str) -> DataFrame:
    """pair, present, not_observed: the values of both sides of pairs that have one of each."""
    one = lambda x: F.min(F.when(F.col(label) == x, F.col(value)))
    return rows.groupBy(pair).agg(one(1).alias("present"), one(0).alias("not_observed")).where("present is not null and not_observed is not null")


def review_rounds(rounds: list[DataFrame], pair: str, passed: str, required: int) -> DataFrame:
    """One row over all rounds of review: reviewed, qualified, accepted, reserve, rejected, pairs decided twice, gate."""
    every = rounds[0].select(pair, passed)
    for x in rounds[1:]:
        every = every.unionAll(x.select(pair, passed))
    decided = every.groupBy(pair).agg(F.count("*").alias("times"), F.bool_and(F.col(passed)).alias("ok"))
    n = decided.agg(F.count("*").alias("n_reviewed"), F.count_if("ok").alias("n_qualified"), F.count_if(F.col("times") > 1).alias("n_decided_twice"))
    q = F.col("n_qualified")
    return n.select(
        "n_reviewed", "n_qualified", F.least(q, F.lit(required).cast("long")).alias("n_accepted"), F.greatest(q - required, F.lit(0).cast("long")).alias("n_reserve"), (F.col("n_reviewed") - q).alias("n_rejected"), "n_decided_twice",
        F.when(q >= required, "pass").otherwise("insufficient_accepted_supply").alias("decision"),
    )


def triage(entries: DataFrame, pair: str, compiler: str, level: str, text: str, operation: str) -> DataFrame:
    """Adds ``flags``: short bodies, source operations not recovered, bodies that collapse against their own O0 baseline."""
    size = F.length(F.regexp_replace(text, r"\s+", ""))
    base = F.max(F.when(F.col(level) == "O0", size)).over(Window.partitionBy(pair, compiler))
    flags = F.array_compact(
        F.array(
            F.when(size < SHORT_BODY, "body_too_short"),
            F.when(~F.contains(F.lower(text), F.lower(operation)), "source_operation_not_recovered"),
            F.when((F.col(level) == "O2") & (base > 0) & (size / base < COLLAPSE_RATIO), "o2_evidence_collapse"),
        )
    )
    return entries.withColumn("flags", F.array_join(flags, ","))


def compact_target(assessment: Column, spans: Column, confidences: Column) -> Column:
    """struct(assessment, evidence_spans, confidence): distinct spans in order, at most MAX_SPANS, none if uncertain."""
    kept = F.slice(F.array_distinct(F.flatten(spans)), 1, MAX_SPANS)
    return F.struct(
        assessment.alias("assessment"), F.when(assessment == "uncertain", F.array().cast("array<string>")).otherwise(kept).alias("evidence_spans"), least_confidence(F.filter(confidences, lambda c: c != "")).alias("confidence")
    )


def rendered(assessment: Column, scope: Column, n_spans: Column) -> Column:
    """A one-line report of a compact target."""
    return (
        F.when(assessment == "present", F.concat(scope, F.lit(" is present; "), n_spans.cast("string"), F.lit(" evidence span(s).")))
        .when(assessment == "not_observed", F.concat(scope, F.lit(" was not observed; "), n_spans.cast("string"), F.lit(" evidence span(s).")))
        .otherwise(F.concat(F.lit("The evidence on "), scope, F.lit(" is not sufficient.")))
    )


def compact_functions(functions: Column) -> Column:
    """Functions without block comments and blank lines, with bounded lists and no section or symbol inventories."""

    def lines(code: Column) -> Column:
        bare = F.regexp_replace(code, r"(?s)/\*.*?\*/", "")
        return F.array_join(F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")

    return F.transform(
        functions,
        lambda f: F.struct(
            f["function_id"].alias("function_id"),
            lines(f["pseudo_c"]).alias("pseudo_c"),
            F.slice(f["assembly"], 1, ASSEMBLY_LIMIT).alias("assembly"),
            F.slice(f["imports"], 1, IMPORT_LIMIT).alias("imports"),
            F.slice(f["strings"], 1, STRING_LIMIT).alias("strings"),
        ),
    )


def undefined_imports(nm: Column) -> Column:
    """Sorted names of undefined symbols in ``nm`` output, without versions."""
    found = F.regexp_extract_all(nm, F.lit(r"(?:^|\n)\s*U\s+([^\s@]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def section_names(readelf: Column) -> Column:
    """Sorted section names in ``readelf -SW`` output."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(readelf, F.lit(r"\[\s*[0-9]+\]\s+(\.[A-Za-z0-9_.]+)"), F.lit(1))))


def field_candidates(tables: dict[str, DataFrame]) -> DataFrame:
    """field, columns: columns (table.column, sorted, comma-joined) whose name has one of the field's aliases."""
    spark = next(iter(tables.values())).sparkSession
    names = [f"{t}.{c}" for t, df in tables.items() for c in df.columns]
    rows = [(f, ",".join(sorted(n for n in names if any(a in n.rpartition(".")[2].lower() for a in aliases)))) for f, aliases in FIELD_ALIASES.items()]
    return spark.createDataFrame(rows, "field string, columns string")


def cohorts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """field, n_without: rows that satisfy all predicates but, at most, this one. From one pass."""
    every = list(predicates.items())

    def but(k: str) -> Column:
        out = F.lit(True)
        for name, p in every:
            out = out & p if name != k else out
        return out

    counts = df.agg(*[F.count_if(but(k)).alias(k) for k, _ in every])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("n_without")) for k, _ in every])).alias("x")).select("x.field", "x.n_without")


def duplicate_scopes(df: DataFrame, part: str, identity: str) -> DataFrame:
    """One row: rows beyond the first of their identity inside a part, and over all parts."""
    inside = df.groupBy(part, identity).agg(F.count("*").alias("n"))
    total = inside.agg(F.sum(F.col("n") - 1).alias("within_part"))
    over = inside.groupBy(identity).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") - 1).alias("overall"))
    return total.crossJoin(over)  # one row each


def split_fields(df: DataFrame, keys: list[str], gold: list[str], order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features and gold of the first row of each key, apart; and the keys whose rows differ in a gold field."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    conflicts = df.groupBy(*keys).agg(F.countDistinct(F.struct(*gold)).alias("n_values")).where("n_values > 1")
    return first.drop(*gold), first.select(*keys, *gold), conflicts


def family_quota(df: DataFrame, family: str, project: str, identity: str, key: str, valid: Column, quota: int) -> DataFrame:
    """``quota`` valid rows of each family: one of an identity, projects in turn."""
    one = df.where(valid).withColumn("_i", F.row_number().over(Window.partitionBy(identity).orderBy(key))).where("_i = 1")
    turn = one.withColumn("_t", F.row_number().over(Window.partitionBy(family, project).orderBy(F.sha2(F.col(key).cast("string"), 256))))
    ranked = turn.withColumn("family_rank", F.row_number().over(Window.partitionBy(family).orderBy("_t", F.sha2(F.col(project).cast("string"), 256), key)))
    return ranked.where(F.col("family_rank") <= quota).drop("_i", "_t")


def forced_test_split(df: DataFrame, split: str, forced: Column) -> DataFrame:
    """``split`` with the forced members in test, whatever was drawn for them."""
    return df.withColumn(split, F.when(forced, "test").otherwise(F.col(split)))


def rows_at(df: DataFrame, index: str, wanted: DataFrame) -> DataFrame:
    """Rows at the wanted positions (column of the same name); positions that do not occur have nulls."""
    return wanted.join(df, index, "left")


def rows_by_ids(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is wanted, and wanted ids that are nowhere."""
    return df.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(df.select(key), key, "left_anti")


def token_gate(rows: DataFrame, pair: str, variant: str, tokens: Column, cutoff: int, k: int) -> DataFrame:
    """pair, variant, n_tokens, accepted: the first ``k`` pairs and variants of which no side is over the cutoff."""
    sized = rows.groupBy(pair, variant).agg(F.max(tokens).alias("n_tokens"))
    fits = sized.where(F.col("n_tokens") <= cutoff)
    return fits.orderBy(pair, variant).limit(k)


def cutoff_filter(rows: DataFrame, tokens: Column, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff, and rows beyond it."""
    return rows.where(tokens <= cutoff), rows.where(tokens > cutoff)


def visible(code: Column, cwe: Column, rules: dict[str, list[str]]) -> Column:
    """Whether all patterns that a weakness needs are seen in the code; null without a rule for it."""
    out = F.lit(None).cast("boolean")
    for name, patterns in rules.items():
        seen = F.lit(True)
        for p in patterns:
            seen = seen & code.rlike(p)
        out = F.when(cwe == name, seen).otherwise(out)
    return out


def _any_like(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda x: x.rlike(pattern))


def missing_spans(spans: Column, cwe: Column, rules: dict[str, dict[str, str]]) -> Column:
    """Names of what a weakness requires among its spans and none of them has."""
    out = F.array().cast("array<string>")
    for name, parts in rules.items():
        wanting = F.array_compact(F.array(*[F.when(~_any_like(spans, p), F.lit(k)) for k, p in parts.items()]))
        out = F.when(cwe == name, wanting).otherwise(out)
    return out


def ranked_evidence(rows: DataFrame, key: str, text: str, scores: dict[str, int], paired: DataFrame | None, k: int, contrast: int = 12) -> DataFrame:
    """The ``k`` best lines of each text: sum of the scores of the patterns found, and a bonus if the paired text lacks the line."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).select(key, "line_no", F.trim("line").alias("line")).where("line != ''")
    score = F.lit(0)
    for pattern, points in scores.items():
        score = score + F.when(F.col("line").rlike(pattern), points).otherwise(0)
    scored = lines.withColumn("score", score)
    if paired is not None:
        other = paired.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, F.trim("line").alias("line")).distinct().withColumn("_seen", F.lit(True))
        scored = scored.join(other, [key, "line"], "left").withColumn("score", F.col("score") + F.when(F.col("_seen").isNull(), contrast).otherwise(0)).drop("_seen")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "line_no"))
    return scored.withColumn("evidence_rank", rank).where(F.col("evidence_rank") <= k)


FUNCTIONS = "name string, first_line int, last_line int, body string"
_HEADER = re.compile(r"([A-Za-z_]\w*)\s*\([^;{}]*\)\s*$", re.S)


def c_functions(code: str) -> list[tuple[str, int, int, str]]:
    """Top-level function definitions of C code: name, lines, text. Braces in comments, strings and characters don't count."""
    # comments, strings, characters and preprocessor lines become spaces
    ignored = r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|(?:^|(?<=\n))[ \t]*#(?:\\\n|[^\n])*'
    masked = re.sub(ignored, lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.S)
    out, depth, opened, since = [], 0, 0, 0
    for m in re.finditer(r"[{};]", masked):
        if m[0] == "{":
            if depth == 0:
                opened = m.start()
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                header = _HEADER.search(masked[since:opened])
                if header:
                    start = since + len(masked[since:opened]) - len(masked[since:opened].lstrip())
                    out.append((header[1], code.count("\n", 0, start) + 1, code.count("\n", 0, m.end()) + 1, code[start : m.end()]))
                since = m.end()
        elif depth == 0:
            since = m.end()
    return out


def extract_functions(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, first_line, last_line, body of the functions in each file."""
    source = files.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *f) for k, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in c_functions(code or "")]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4])], [key, "name", "first_line", "last_line", "body"])

    return source.mapInArrow(run, T.StructType([source.schema[key], *T.StructType.fromDDL(FUNCTIONS)]))


_DIFF = T.StructType([T.StructField("added", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("diff", T.StringType())])


@F.pandas_udf(_DIFF)
def line_diff(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Unified diff of two texts, with its numbers of added and removed lines.

    Where lines stand in the same places and no diff can be shorter, they are compared in place; else blocks are matched, lines that occur often included.
    """
    rows = []
    for a, b in zip(before, after):
        lines = unified_diff((a or "").splitlines(), (b or "").splitlines())
        body = lines[2:]
        rows.append((sum(x.startswith("+") for x in body), sum(x.startswith("-") for x in body), "\n".join(lines)))
    return pd.DataFrame(rows, columns=["added", "removed", "diff"])


def unified_diff(a: list[str], b: list[str], context: int = 3) -> list[str]:
    """Lines of a unified diff without line ends. ``difflib`` itself leaves lines out of a match that are frequent in a text of 200 lines or more."""
    import difflib
    from collections import Counter

    matcher = difflib.SequenceMatcher(None, [], [], autojunk=False)
    kept = [x == y for x, y in zip(a, b)]
    if len(a) == len(b) and len(a) - sum(kept) == (Counter(a) - Counter(b)).total():  # lines that the other side has not so often must go
        runs = [(same, len(list(run))) for same, run in itertools.groupby(kept)]
        starts = [0, *itertools.accumulate(n for _, n in runs)]
        matcher.opcodes = [("equal" if same else "replace", i, i + n, i, i + n) for (same, n), i in zip(runs, starts)]
    else:
        matcher.set_seqs(a, b)
    out = []
    for group in matcher.get_grouped_opcodes(context):
        if not out:
            out = ["--- ", "+++ "]
        spans = [(group[0][i], group[-1][i + 1]) for i in (1, 3)]
        shown = [f"{i + 1}" if j - i == 1 else f"{i + (j > i)},{j - i}" for i, j in spans]
        out.append(f"@@ -{shown[0]} +{shown[1]} @@")
        for kind, i, j, k, m in group:
            if kind == "equal":
                out += [f" {x}" for x in a[i:j]]
            else:
                out += [f"-{x}" for x in a[i:j]] + [f"+{x}" for x in b[k:m]]
    return out


def schema_errors(text: Column, required: dict[str, str]) -> Column:
    """``key:missing`` or ``key:type`` of required JSON members; ``parse`` if the text is no object."""
    from lodestrata.functions.structures import is_json_object

    parsed = F.try_parse_json(text)
    found = []
    for key, kind in required.items():
        value = F.try_variant_get(parsed, f"$.{key}", "variant")
        found.append(F.when(value.isNull(), F.lit(f"{key}:missing")).when(~F.schema_of_variant(value).like(f"{kind}%"), F.lit(f"{key}:type")))
    return F.when(~is_json_object(text), F.array(F.lit("parse"))).otherwise(F.array_compact(F.array(*found)))


def disciplined(limitations: Column, evidence: Column) -> Column:
    """Whether limitations are stated and every piece of evidence has text."""
    return F.coalesce((F.size(limitations) > 0) & F.forall(evidence, lambda e: F.trim(F.coalesce(e, F.lit(""))) != ""), F.lit(False))


def embedded_json(prompt: Column, path: str) -> Column:
    """A member of the first JSON object in a prompt; text may stand before and after it."""
    return F.get_json_object(F.substr(prompt, F.instr(prompt, "{")), path)


def date_like(text: Column) -> Column:
    """Whether a text has the shape of a date; it need not be one."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def forbidden_fields(schema: T.StructType, forbidden: list[str], prefix: str = "") -> list[str]:
    """Paths of fields with a forbidden name, at any depth of a schema."""
    out = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if field.name.lower() in forbidden:
            out.append(path)
        kind = field.dataType
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, f"{path}[]"
        if isinstance(kind, T.StructType):
            out += forbidden_fields(kind, forbidden, f"{path}.")
    return out


def approved(manifest: DataFrame, review: DataFrame, recomputed: DataFrame) -> DataFrame:
    """One row, approved: the manifest says so, and the review it embeds equals the one recomputed."""
    equal = review.exceptAll(recomputed).isEmpty() and recomputed.exceptAll(review).isEmpty()
    return manifest.select((F.col("approved") & F.lit(equal)).alias("approved"))


def evidence_targets(rows: DataFrame, key: str, cwe: str, code: str, label: str, rules: dict[str, list[str]], scores: dict[str, int], k: int) -> DataFrame:
    """key, assessment, evidence (the ``k`` best lines, joined), reason: a positive without an observable relation is quarantined."""
    evidence = ranked_evidence(rows, key, code, scores, None, k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("evidence_rank", "line"))).alias("x"))
    seen = F.coalesce(visible(F.col(code), F.col(cwe), rules), F.lit(False))
    reason = F.when((F.col(label) == 1) & ~seen, "no_observable_target_relation").otherwise("eligible")
    return rows.select(key, F.when(F.col(label) == 1, "present").otherwise("not_observed").alias("assessment"), reason.alias("reason")).join(evidence, key, "left").select(
        key, "assessment", F.when(F.col("reason") == "eligible", F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("evidence"), "reason"
    )


def packets(queue: DataFrame, rank: str, title: str, batch: int) -> DataFrame:
    """packet, n, text: the queue in review packets of ``batch`` entries."""
    numbered = queue.withColumn("packet", F.ceil(F.col(rank) / batch))
    grouped = numbered.groupBy("packet").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(title).cast("string").alias("t")))).alias("x"))
    return grouped.select("packet", "n", F.array_join(F.transform("x", lambda x: F.concat(F.lit("- ["), x["r"].cast("string"), F.lit("] "), x["t"])), "\n").alias("text"))


def merged_shards(shards: DataFrame, low: str, high: str, ok: str, n: str) -> DataFrame:
    """One row: shards, gaps, overlaps, entries, success rate of shards that must join without a gap."""
    step = F.col(low) - F.lag(high).over(Window.partitionBy(F.lit(1)).orderBy(low)) - 1  # one row a shard
    marked = shards.withColumn("_s", step)
    return marked.agg(
        F.count("*").alias("n_shards"), F.count_if(F.col("_s") > 0).alias("n_gaps"), F.count_if(F.col("_s") < 0).alias("n_overlaps"), F.sum(n).alias("n_entries"), F.round(F.try_divide(F.sum(ok).cast("double"), F.sum(n).cast("double")), 4).alias("success_rate")
    )
