"""Scoring predictions against held-out gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.rates import f1, failed_names, percentile_rank, rate, ratio
from lodestrata.operators.ranks import running_sums

# The least or largest figures of each contract; True: must hold.
_RATES = {"parse_rate": 0.99, "schema_rate": 0.99}
_STRICT = {"precision": 0.90, "recall": 0.95, "false_positive_rate": 0.05, "abstention_rate": 0.05}
_LOOSE = {"precision": 0.75, "recall": 0.75, "false_positive_rate": 0.20, "abstention_rate": 0.10}
_EVIDENCE = {"evidence_precision": 0.50, "evidence_recall": 0.50, "renderer_rate": 1.0}
_SOURCE = {"safety_rate": 1.0, "repetition_rate": 0.01, "abnormal_length_rate": 0.01}
GATES = {
    "absolute": {"n": 200, "complete": True, **_STRICT, **_RATES, "safety_rate": 1.0, "evidence_rate": 0.90},
    "source": {"n": 200, "complete": True, "both_answered": True, **_STRICT, **_RATES, **_SOURCE, "evidence_rate": 0.90},
    "source_diagnostic": {"n": 20, "complete": True, "both_answered": True, **_LOOSE, **_RATES, **_SOURCE, "evidence_rate": 0.0},
    "binary": {"n": 200, "complete": True, **_STRICT, **_RATES, "evidence_rate": 0.90, "consistency_rate": 0.95},
    "decision": {"n": 20, "complete": True, "both_answered": True, **_LOOSE, **_RATES},
    "compact": {"n": 100, "complete": True, "both_labels": True, **_LOOSE, **_RATES, **_EVIDENCE},
    "evidence_lines": {"n": 100, "complete": True, **_RATES, **_EVIDENCE},
    "two_stage_decision": {"n": 100, "complete": True, "both_answered": True, **_STRICT, **_RATES},
    "two_stage_evidence": {"n": 100, "complete": True, **_RATES, **_EVIDENCE},
    "target_audit": {
        "n": 1, "schema_rate": 1.0, "n_leaks": 0, "link_rate": 0.95, "n_generic": 0, "exact_duplicate_rate": 0.05, "single_target_rate": 0.02, "n_safety_claims": 0, "n_over_cutoff": 0, "n_over_budget": 0,
    },
}
#: Figures that must not be exceeded; all others must be reached.
CEILINGS = {
    "false_positive_rate", "abstention_rate", "repetition_rate", "abnormal_length_rate", "exact_duplicate_rate", "single_target_rate", "n_leaks", "n_generic", "n_safety_claims", "n_over_cutoff", "n_over_budget", "max_fpr",
}
ASSESSMENTS = ["present", "not_observed", "uncertain"]


def confusion(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of ``is_positive`` (gold) against ``decision`` (null: abstained or unusable).

    An abstention on a positive is a false negative; on a negative it is neither right nor wrong.
    """
    positive, said = F.col("is_positive"), F.col("decision")
    n, tp = F.count("*"), F.count_if(positive & F.coalesce(said, F.lit(False)))
    positives, negatives = F.count_if(positive), F.count_if(~positive)
    fp, tn = F.count_if(~positive & F.coalesce(said, F.lit(False))), F.count_if(~positive & ~F.coalesce(said, F.lit(True)))
    counted = cases.groupBy(*(by or [])).agg(
        n.alias("n"), positives.alias("positives"), negatives.alias("negatives"), tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), (positives - tp).alias("fn"), F.count_if(said.isNull()).alias("abstained")
    )
    c = F.col
    precision, recall = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("positives"))
    return counted.select(
        "*",
        F.round(precision, 6).alias("precision"),
        F.round(recall, 6).alias("recall"),
        F.round(f1(precision, recall), 6).alias("f1"),
        F.round(ratio(c("fp"), c("negatives")), 6).alias("false_positive_rate"),
        F.round(ratio(c("abstained"), c("n")), 4).alias("abstention_rate"),
    )


def gate(metrics: DataFrame, contract: str | dict[str, float | bool]) -> DataFrame:
    """Adds ``passed`` and ``failed_checks`` (sorted names, comma-joined) of a contract's limits.

    A figure that is absent or null fails its check. Where the counts are there, precision, recall and false
    positive rate are compared as exact ratios, not as they are rounded.
    """
    exact = {"precision": ("tp", ("tp", "fp")), "recall": ("tp", ("positives",)), "false_positive_rate": ("fp", ("negatives",))}

    def figure(name: str) -> Column:
        if name not in metrics.columns:
            return F.lit(None).cast("double")
        if name in exact and {"tp", "fp", "positives", "negatives"} <= set(metrics.columns):
            top, below = exact[name]
            return ratio(F.col(top), sum((F.col(x) for x in below[1:]), F.col(below[0])))
        return F.col(name)

    def holds(name: str, limit: float | bool) -> Column:
        if limit is True:
            return figure(name).cast("boolean")
        return figure(name) <= limit if name in CEILINGS else figure(name) >= limit

    failed = failed_names({k: holds(k, v) for k, v in (GATES[contract] if isinstance(contract, str) else contract).items()})
    return metrics.select("*", (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed_checks"))


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """``df``; a key that occurs twice fails the job when it is read."""
    once = F.when(F.count("*").over(Window.partitionBy(key)) == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))))
    return df.withColumn(key, once.cast(df.schema[key].dataType))


def join_predictions(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Gold with its prediction, if any; a key that is not unique on both sides fails the job.

    Both sides are in the order of their key, which tells repeated ones, and are merged so: outputs may be long, and however small
    their table seems they never pass the driver.
    """
    predicted = unique_keys(predictions, key).withColumn("predicted", F.lit(True)).hint("merge")
    return unique_keys(gold, key).join(predicted, key, "left").withColumn("missing", F.col("predicted").isNull()).drop("predicted")


def judged(joined: DataFrame, n_lines: str = "n_lines", gold_lines: str = "gold_lines") -> DataFrame:
    """Cases of gold joined with predictions (is_positive, missing, raw_output, gold_lines, n_lines): what the output is worth.

    An output is an object with ``assessment``, ``basis`` and ``evidence`` (numbers of lines), by the contract ``assessed``. Adds parsed, schema_ok,
    safe, has_evidence, repeats, abnormal, assessment and decision (null: abstained or unusable), renders, and
    the sizes of evidence: n_predicted, n_gold, n_shared.
    """
    from lodestrata.functions import text as T
    from lodestrata.functions.contracts import assessed
    from lodestrata.functions.json_schema import conforms
    from lodestrata.functions.structures import is_json_object

    raw, present = F.col("raw_output"), ~F.col("missing")
    parsed = joined.withColumn("parsed", F.coalesce(is_json_object(raw), F.lit(False)) & present)
    parts = F.from_json(F.when(F.col("parsed"), raw), "assessment string, basis string, evidence array<int>")
    read = parsed.withColumn("_o", parts)
    valid = F.col("parsed") & conforms(raw, assessed()) & F.col("_o.evidence").isNotNull()
    read = read.withColumn("schema_ok", F.coalesce(valid, F.lit(False)))
    lines = F.when(F.col("schema_ok"), F.array_distinct("_o.evidence")).otherwise(F.array().cast("array<int>"))
    told = F.when(F.col("schema_ok"), F.col("_o.assessment"))
    return read.select(
        *joined.columns, "parsed", "schema_ok",
        (F.col("parsed") & ~T.any_match(raw, T.UNSAFE_GUIDANCE)).alias("safe"),
        F.coalesce(told.isNotNull() & ((told != "present") | (F.size(lines) > 0)), F.lit(False)).alias("has_evidence"),
        (present & T.repeats(raw)).alias("repeats"), (present & T.abnormal_length(raw)).alias("abnormal"),
        told.alias("assessment"), F.when(told == "present", True).when(told == "not_observed", False).alias("decision"),
        (F.col("schema_ok") & F.forall(lines, lambda x: x.between(1, F.col(n_lines)))).alias("renders"),
        F.size(lines).alias("n_predicted"), F.size(F.array_distinct(gold_lines)).alias("n_gold"), F.size(F.array_intersect(lines, gold_lines)).alias("n_shared"),
    )


def contract_metrics(cases: DataFrame, n_extra: DataFrame, group: str | None = None) -> DataFrame:
    """One row with every figure that the contracts on judged cases ask for. ``n_extra``: one row, predictions without gold."""
    rates = {"parse_rate": "parsed", "schema_rate": "schema_ok", "safety_rate": "safe", "evidence_rate": "has_evidence", "repetition_rate": "repeats", "abnormal_length_rate": "abnormal", "renderer_rate": "renders"}
    shares = cases.agg(
        *[rate(F.col(c)).alias(k) for k, c in rates.items()], F.count_if("missing").alias("n_missing"),
        *[F.round(ratio(F.sum("n_shared"), F.sum(c)), 4).alias(k) for k, c in (("evidence_precision", "n_predicted"), ("evidence_recall", "n_gold"))],
    )
    m = confusion(cases).crossJoin(shares).crossJoin(n_extra)  # one row each
    if group:
        m = m.crossJoin(consistency(cases, group, "assessment").select("consistency_rate"))
    c = F.col
    return m.select("*", ((c("n_missing") == 0) & (c("n_extra") == 0)).alias("complete"), ((c("tp") + c("fp") > 0) & (c("tn") + c("fn") > 0)).alias("both_answered"), ((c("positives") > 0) & (c("negatives") > 0)).alias("both_labels"))


def extra_predictions(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """One row, n_extra: predictions whose key is no gold's."""
    return predictions.join(gold.select(key), key, "left_anti").agg(F.count("*").alias("n_extra"))


def target_audit(targets: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """One row: figures of training targets (target, label, schema_ok, leaked, linked, generic, claim, over_cutoff, over_budget), checks and status.

    It never approves: what passes all checks still waits for a review by hand, so ``overall_pass`` is false.
    """
    masses = targets.groupBy("target").agg(F.count("*").alias("_n")).agg(F.sum(F.col("_n") - 1).alias("_again"), F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    flags = {"n_leaks": "leaked", "n_generic": "generic", "n_safety_claims": "claim", "n_over_cutoff": "over_cutoff", "n_over_budget": "over_budget"}
    counted = targets.agg(
        F.count("*").alias("n"), rate(F.col("schema_ok")).alias("schema_rate"), rate(F.when(F.col("label") == "present", F.col("linked"))).alias("link_rate"), *[F.count_if(c).alias(k) for k, c in flags.items()],
        *[F.count_if(F.col("label") == k).alias(f"n_{k}") for k in quotas],
    )
    metrics = counted.crossJoin(masses).select(  # one row each
        "*", F.round(ratio(F.col("_again"), F.col("_all")), 6).alias("exact_duplicate_rate"), F.round(ratio(F.col("_most"), F.col("_all")), 6).alias("single_target_rate")
    )
    supplied = F.lit(True)
    for k, n in quotas.items():
        supplied = supplied & (F.col(f"n_{k}") >= n)
    found = gate(metrics.drop("_again", "_most", "_all"), "target_audit").withColumnRenamed("passed", "automated_pass")
    status = F.when(~supplied, "evidence_supply_blocked").when(F.col("automated_pass"), "manual_review_required").otherwise("automated_quality_gate_failed")
    return found.select("*", status.alias("status"), F.lit(False).alias("overall_pass")).withColumn("automated_pass", F.col("automated_pass") & supplied)


def completeness_report(gold: DataFrame, predictions: DataFrame, key: str, shown: int = 20) -> DataFrame:
    """One row: numbers of missing and extra keys, and the first of each."""
    both = gold.select(key).distinct().withColumn("g", F.lit(1)).join(predictions.select(key).distinct().withColumn("p", F.lit(1)), key, "full_outer")
    side = both.select(key, F.when(F.col("p").isNull(), "missing").when(F.col("g").isNull(), "extra").alias("side")).where("side is not null")
    # the first keys of each side by rank, so that no list grows with the data
    ranked = side.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(key))).where(F.col("rank") <= shown)
    firsts = ranked.groupBy().agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col(key)))).cast("array<string>"), ",").alias(f"first_{s}") for s in ("missing", "extra")])
    counts = side.groupBy().agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("missing", "extra")])
    return counts.crossJoin(firsts)  # one row each


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def _by_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row for each distinct score: n, pos (positives)."""
    return scored.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row: n, positives, roc_auc with tied scores at their mean rank."""
    ranked = running_sums(_by_score(scored, score, label), "score", ["n"]).withColumn("midrank", F.col("n_before") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum(F.col("midrank") * F.col("pos")).alias("ranks"))
    p, n = F.col("positives"), F.col("n")
    return total.select("n", "positives", F.round(ratio(F.col("ranks") - p * (p + 1) / 2, p * (n - p)), 6).alias("roc_auc"))


def average_precision(scored: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """One row: average precision, tied scores in the order of their key.

    Ranks come from counts per score, and tied rows are ranked in ranges of their key.
    """
    base = running_sums(_by_score(scored, score, label), "score", ["n", "pos"], descending=True).select("score", "n_before", "pos_before")
    rows = scored.select(F.col(score).alias("score"), F.col(label).cast("long").alias("hit"), key, F.lit(1).alias("one"))
    at = running_sums(rows, key, ["one", "hit"], ["score"]).join(base, "score").where("hit = 1")
    precision = (F.col("pos_before") + F.col("hit_before") + 1) / (F.col("n_before") + F.col("one_before") + 1)
    return at.agg(F.round(F.coalesce(F.sum(precision) / F.count("*"), F.lit(0.0)), 6).alias("average_precision"))


def threshold_at_fpr(scored: DataFrame, score: str, label: str, cap: float) -> DataFrame:
    """One row: threshold, recall, precision, false_positive_rate: the best (recall, precision, -fpr, threshold)
    over all distinct scores, and one above all of them, with a false positive rate of at most ``cap``."""
    rows = _by_score(scored, score, label)
    totals = rows.agg(F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"), (F.max("score") + 1e-12).alias("top"))
    upto = running_sums(rows, "score", ["n", "pos"], descending=True)
    tp = F.col("pos_before") + F.col("pos")
    curve = upto.select("score", tp.alias("tp"), (F.col("n_before") + F.col("n") - tp).alias("fp"))
    sentinel = totals.select(F.col("top").alias("score"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    points = curve.unionAll(sentinel).crossJoin(F.broadcast(totals.select("p", "q")))  # one row of totals
    measured = points.select("score", ratio(F.col("tp"), F.col("p")).alias("recall"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("fp"), F.col("q")).alias("fpr"))
    best = measured.where(F.col("fpr") <= cap).agg(F.max(F.struct("recall", "precision", (-F.col("fpr")).alias("minus"), "score")).alias("b"))
    return best.select(F.round("b.score", 6).alias("threshold"), F.round("b.recall", 6).alias("recall"), F.round("b.precision", 6).alias("precision"), F.round(-F.col("b.minus"), 6).alias("false_positive_rate"))


def threshold_metrics(scored: DataFrame, score: str, label: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """The confusion counts and rates of ``score >= threshold``."""
    cases = scored.select(*(by or []), (F.col(label) == 1).alias("is_positive"), (F.col(score) >= threshold).alias("decision"))
    return confusion(cases, by)


def percentiles(values: DataFrame, column: str, points: dict[str, tuple[float, str]]) -> DataFrame:
    """One row: n, and for each name the value at its quantile by its rank rule.

    Equal values are counted first; what is ordered, in ranges, is the table of distinct values.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    upto = running_sums(counts, column, ["c"]).withColumn("upto", F.col("c_before") + F.col("c"))
    total = counts.agg(F.sum("c").alias("n"))
    joined = upto.crossJoin(F.broadcast(total))  # one row
    picks = [F.min(F.when(F.col("upto") > percentile_rank(F.col("n"), q, rule), F.col(column))).alias(name) for name, (q, rule) in points.items()]
    return joined.agg(F.max("n").alias("n"), *picks)


def set_scores(cases: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """One row: micro precision, recall, f1 of the sets of all cases together."""
    sized = cases.select(F.size(F.array_intersect(expected, actual)).alias("both"), F.size(F.array_distinct(expected)).alias("e"), F.size(F.array_distinct(actual)).alias("a"))
    total = sized.agg(F.sum("both").alias("b"), F.sum("e").alias("e"), F.sum("a").alias("a"))
    p, r = ratio(F.col("b"), F.col("a")), ratio(F.col("b"), F.col("e"))
    return total.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"))


def consistency(answers: DataFrame, group: str, answer: str) -> DataFrame:
    """One row: groups with two answers or more, how many of them agree, their share."""
    groups = answers.where(F.col(answer).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.min(answer).alias("low"), F.max(answer).alias("high")).where("n >= 2")
    return groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("low") == F.col("high")).alias("n_consistent"), F.round(F.coalesce(F.avg((F.col("low") == F.col("high")).cast("double")), F.lit(0.0)), 4).alias("consistency_rate"))


def one_or_mixed(column: str) -> Column:
    """Aggregate: the only value, or ``mixed``."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise("mixed")


def classifier_gate(gold: DataFrame, predictions: DataFrame, key: str, score: str, label: str, by: str, threshold: float, threshold_source: str, limits: dict[str, float]) -> DataFrame:
    """One row: all figures of scored predictions at a threshold that calibration has fixed, and their checks.

    ``limits``: precision, recall, false_positive_rate, roc_auc, average_precision, min_recall and max_fpr (over the
    classes of ``by``). The predictions must also be complete; only keys on both sides are scored.
    """
    if threshold_source != "calibration":
        raise ValueError("the threshold must come from calibration")
    scored = gold.join(unique_keys(predictions.select(key, score), key), key)
    sides = completeness_report(gold, predictions, key).select("n_missing", "n_extra")
    each = threshold_metrics(scored, score, label, threshold, [by]).agg(F.coalesce(F.min("recall"), F.lit(0.0)).alias("min_recall"), F.coalesce(F.max("false_positive_rate"), F.lit(1.0)).alias("max_fpr"))
    m = threshold_metrics(scored, score, label, threshold)
    for one in (roc_auc(scored, score, label).select("roc_auc"), average_precision(scored, score, label, key), each, sides):
        m = m.crossJoin(one)  # one row each
    m = m.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("n") > 0))
    return gate(m, {"complete": True, **limits})


def two_stage(decision_gold: DataFrame, decisions: DataFrame, challenge: DataFrame, evidence_gold: DataFrame, records: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """One row: both sub-gates on their own prediction sets, and the latency of the two stages together.

    ``decision_gold``: key, is_positive; ``challenge``: keys of the evidence stage, which are joined to the private ``records``
    (key, n_lines) before they are scored, and to ``evidence_gold`` (key, gold_lines). Both prediction sets have raw_output and
    latency_ms. A case of one stage that the other does not have fails ``same_cases``.
    """
    lines = F.coalesce(F.col("n_lines"), F.lit(0))
    empty = F.array().cast("array<int>")
    first = judged(join_predictions(decision_gold.select(key, "is_positive"), decisions, key).withColumn("gold_lines", empty).withColumn("n_lines", F.lit(2**31 - 1)))
    private = challenge.select(key).join(unique_keys(records, key).select(key, "n_lines"), key, "left").join(unique_keys(evidence_gold, key).select(key, "gold_lines"), key, "left")
    private = private.select(key, F.lit(True).alias("is_positive"), lines.alias("n_lines"), F.coalesce("gold_lines", empty).alias("gold_lines"))
    second = judged(join_predictions(private, evidence, key))
    sides = []
    for name, cases, given, gold in (("decision", first, decisions, decision_gold), ("evidence", second, evidence, challenge)):
        found = gate(contract_metrics(cases, extra_predictions(gold, given, key)), f"two_stage_{name}")
        sides.append(found.select(F.col("passed").alias(f"{name}_passed"), F.col("failed_checks").alias(f"{name}_failed")))
    both = first.select(key, F.lit(True).alias("a"), F.col("latency_ms").alias("first_ms")).join(second.select(key, F.lit(True).alias("b"), F.col("latency_ms").alias("second_ms")), key, "full")
    same = both.agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same_cases"))
    spent = percentiles(both.select((F.col("first_ms") + F.col("second_ms")).alias("ms")), "ms", {"latency_p50_ms": (0.5, "floor"), "latency_p95_ms": (0.95, "floor")})
    out = sides[0].crossJoin(sides[1]).crossJoin(same).crossJoin(spent.drop("n"))  # one row each
    return out.withColumn("passed", F.col("decision_passed") & F.col("evidence_passed") & F.col("same_cases"))
