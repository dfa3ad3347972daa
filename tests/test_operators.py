"""Operators on small tables, against plain loops and stated values."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import audit, dedup, evaluation, overlap, records, sampling, splits


def draw(seed, value):
    return int(hashlib.sha256(f"{seed}:{value}".encode()).hexdigest()[:16], 16)


def test_confusion_counts_abstentions(spark):
    rows = [(True, True)] * 84 + [(True, False)] * 20 + [(True, None)] * 146 + [(False, True)] * 116 + [(False, False)] * 100 + [(False, None)] * 34
    m = evaluation.confusion(spark.createDataFrame(rows, "is_positive boolean, decision boolean")).first()
    assert (m.tp, m.fp, m.tn, m.fn, m.abstained) == (84, 116, 100, 166, 180)
    assert (m.precision, m.recall, m.false_positive_rate) == (0.42, 0.336, 0.464)


def test_empty_evaluation(spark):
    m = evaluation.gate(evaluation.confusion(spark.createDataFrame([], "is_positive boolean, decision boolean")), "absolute").first()
    assert (m.n, m.precision, m.passed) == (0, 0.0, False) and "n" in m.failed_checks.split(",")


def test_ranking_metrics(spark):
    rows = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.3, 0), (5, 0.2, 1), (6, 0.2, 0)]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    ones, zeros = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / 9
    assert evaluation.roc_auc(df, "s", "y").first().roc_auc == pytest.approx(auc, abs=1e-6)
    order, hits, total = sorted(rows, key=lambda r: (-r[1], r[0])), 0, 0.0
    for k, r in enumerate(order, 1):
        hits += r[2]
        total += r[2] * hits / k
    assert evaluation.average_precision(df, "s", "y", "id").first().average_precision == pytest.approx(total / 3, abs=1e-6)


@pytest.mark.parametrize("cap", [0.0, 0.05, 0.3, 0.5, 1.0])
def test_threshold(spark, cap):
    rows = [(k, ((k * 37) % 23) / 23, int((k * 37) % 23 + k % 7 > 14)) for k in range(60)]
    best = None
    for t in sorted({r[1] for r in rows}) + [max(r[1] for r in rows) + 1e-12]:
        tp, fp = sum(r[2] for r in rows if r[1] >= t), sum(1 - r[2] for r in rows if r[1] >= t)
        p, q = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
        if fp / q <= cap:
            best = max(best or (-1,), (tp / p, tp / (tp + fp) if tp + fp else 0.0, -fp / q, t))
    got = evaluation.threshold_at_fpr(spark.createDataFrame(rows, "id long, s double, y int"), "s", "y", cap).first()
    assert (got.recall, got.precision, got.false_positive_rate, got.threshold) == pytest.approx((best[0], best[1], -best[2], best[3]), abs=1e-6)


def test_percentiles(spark):
    xs = [float(x) for x in [5, 1, 9, 3, 3, 7, 2, 8]]
    got = evaluation.percentiles(spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double"), "x", {"a": (0.5, "nearest"), "b": (0.95, "floor"), "c": (0.95, "capped")}).first()
    o, n = sorted(xs), len(xs)
    assert (got.n, got.a, got.b, got.c) == (n, o[round((n - 1) * 0.5)], o[int((n - 1) * 0.95)], o[min(n - 1, int(n * 0.95))])


def test_completeness_and_duplicates(spark):
    gold = spark.createDataFrame([(k,) for k in range(50)], "id long")
    pred = spark.createDataFrame([(k,) for k in range(25, 60)] + [(30,)], "id long")
    r = evaluation.completeness_report(gold, pred, "id").first()
    assert (r.n_missing, r.n_extra) == (25, 10) and r.first_missing == ",".join(map(str, range(20))) and r.first_extra == ",".join(map(str, range(50, 60)))
    assert [x.id for x in evaluation.duplicate_keys(pred, "id").collect()] == [30]


def test_dedup(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, "c", "x")]
    df = spark.createDataFrame(rows, "i long, h string, label string")
    assert {r.i: r.duplicate_of for r in dedup.duplicate_pointers(df, "h", "i").collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None}
    assert {r.i: r.x_conflict for r in dedup.first_of(df, "h", "i", "x", "label").collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}
    m = dedup.duplicate_mass(df, "h").first()
    assert (m.n, m.duplicate_mass, m.max_share) == (5, 2, 0.4)
    kept, conflicts = dedup.union_checked([df.where("i < 4"), df.where("i >= 3")], "h", "label")
    assert kept.count() == 3 and [r.h for r in conflicts.collect()] == ["b"]


def test_disposition_order(spark):
    flags = ["ec", "nc", "payload", "ed", "nd", "code", "scoped", "ok"]
    rows = [tuple(k == j for j in range(5)) + (k != 5, k != 6, k == 7) for k in range(9)] + [(True,) * 5 + (False, False, True)]
    df = spark.createDataFrame(rows, ", ".join(f"{x} boolean" for x in flags))
    got = [r.d.reason for r in df.select(dedup.disposition(*[F.col(x) for x in flags]).alias("d")).collect()]
    assert got[:5] == ["conflicting_exact_duplicate_labels", "conflicting_near_duplicate_labels", "executable_payload_forbidden", "exact_duplicate", "near_duplicate"]
    assert got[5:] == ["source_code_missing", "scoped_cwe_missing", "requires_prompt_and_target_sanitization", "outside_source_profile", "conflicting_exact_duplicate_labels"]


def pool(spark, n=240):
    rows = [(k, f"c{k % 5}", f"p{k * k % 11}", f"cell{k % 7}", k % 2) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, cwe string, project string, cell string, label int")


def priorities(rows, seed):
    cwes, projects = Counter(r[1] for r in rows), Counter(r[2] for r in rows)
    out = {}
    for r in rows:
        u = (draw(seed, r[0]) + 1) / (2**64 + 1)
        out[r[0]] = -math.log(u) / (cwes[r[1]] ** -0.25 * projects[r[2]] ** -0.15)
    return out


@pytest.mark.parametrize("quota", [5, 30, 100])
def test_capped_weighted_sample(spark, quota):
    rows, df = pool(spark)
    p = priorities(rows, 11)
    cap, used, taken, late = max(1, math.ceil(quota * 0.1)), Counter(), [], []
    for r in sorted(rows, key=lambda r: (p[r[0]], r[0])):
        if used[r[2]] >= cap:
            late.append(r[0])
        elif len(taken) < quota:
            used[r[2]] += 1
            taken.append(r[0])
    want = (taken + late)[:quota]
    assert [r.id for r in sampling.weighted_sample(df, "cwe", "project", "id", 11, quota).collect()] == want


def test_category_round_robin(spark):
    rows, df = pool(spark)
    quota, seed = 40, 43
    want = set()
    for label in (0, 1):
        mine = [r for r in rows if r[4] == label]
        own = draw(seed, label)  # each class has a seed and frequencies of its own
        p = priorities(mine, own)
        queues = {}
        for r in sorted(mine, key=lambda r: (p[r[0]], r[0])):
            queues.setdefault(r[3], []).append(r)
        order = sorted(queues, key=lambda c: (draw(own, c), c))
        cap, used, taken, late = 4, Counter(), [], []
        while len(taken) < quota:
            moved = False
            for c in order:
                while queues[c] and len(taken) < quota:
                    r = queues[c].pop(0)
                    if used[r[2]] >= cap:
                        late.append(r)
                        continue
                    used[r[2]] += 1
                    taken.append(r)
                    moved = True
                    break
            if not moved:
                break
        rest = sorted(late + [r for q in queues.values() for r in q], key=lambda r: (p[r[0]], r[0]))
        want |= {r[0] for r in (taken + rest)[:quota]}
    got = sampling.category_round_robin(df, ["label"], "cell", "cwe", "project", "id", seed, quota).collect()
    assert {r.id for r in got} == want and len(got) == 2 * quota


def test_capped_greedy(spark):
    rows, df = pool(spark)
    want = set()
    for label in (0, 1):
        groups, uses, n = set(), Counter(), 0
        for r in sorted((r for r in rows if r[4] == label), key=lambda r: (draw(3, r[0]), r[0])):
            if n < 12 and r[2] not in groups and uses[r[1]] < 3:
                groups.add(r[2])
                uses[r[1]] += 1
                n += 1
                want.add(r[0])
    assert {r.id for r in sampling.capped_greedy(df, ["label"], "project", "cwe", "id", 3, 12, 3).collect()} == want


def test_balanced_variants(spark):
    variants, use, want = ["a", "b", "c"], Counter(), {}
    for k in range(40):
        least = min(use[v] for v in variants)
        v = min((v for v in variants if use[v] == least), key=lambda v: (hashlib.sha256(f"5:{k}:{v}".encode()).hexdigest(), v))
        use[v] += 1
        want[k] = v
    got = sampling.balanced_variants(spark.createDataFrame([(k,) for k in range(40)], "id long"), "id", variants, 5)
    assert {r.id: r.variant for r in got.collect()} == want


def test_unique_content_groups(spark):
    rows = [(g, c) for g in range(60) for c in {(g * 7) % 50, (g * 13) % 41, 100 + g}]
    taken, want = set(), set()
    for g in range(60):
        mine = {c for h, c in rows if h == g}
        if not mine & taken:
            taken |= mine
            want.add(g)
    df = spark.createDataFrame([(g, str(c), g) for g, c in rows], "g long, c string, o long")
    for pass_rows in (100_000, 30, 0):  # one pass, rounds and a pass, rounds alone
        assert sorted(r.g for r in sampling.unique_content_groups(df, "g", "c", "o", pass_rows).collect()) == sorted(want)
    bare = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "x", 3), (4, "x", 4), (4, None, 4)], "g long, c string, o long")
    for pass_rows in (100_000, 0):
        assert sorted(r.g for r in sampling.unique_content_groups(bare, "g", "c", "o", pass_rows).collect()) == [1, 2, 3]
    assert sampling.unique_content_groups(bare.limit(0), "g", "c", "o").count() == 0


@pytest.mark.parametrize("target", [0, 7, 50, 99])
def test_largest_remainder(spark, target):
    counts = {"a": 10, "b": 33, "c": 56, "d": 1}
    exact = {k: target * n / 100 for k, n in counts.items()}
    want = {k: math.floor(x) for k, x in exact.items()}
    order = sorted(counts, key=lambda k: (math.floor(exact[k]) - exact[k], hashlib.sha256(f"1:{k}".encode()).hexdigest()))
    for k in order[: target - sum(want.values())]:
        want[k] += 1
    got = sampling.largest_remainder(spark.createDataFrame(list(counts.items()), "s string, n long"), "s", "n", target, 1)
    assert {r.s: r.quota for r in got.collect()} == want


def test_quota_is_never_filled_from_elsewhere(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 9, "k string")
    assert {r.k: (r.supply, r.taken, r.short) for r in sampling.quotas_met(df, ["k"], 5).collect()} == {"a": (3, 3, 2), "b": (9, 5, 0)}


@pytest.mark.parametrize("parts", [1, 7])
def test_samples_do_not_depend_on_partitions(spark, parts):
    rows, df = pool(spark)
    same = df.orderBy(F.rand(parts)).repartition(parts)
    for f in (
        lambda x: sampling.round_robin(x, "project", "id", 1, 30),
        lambda x: sampling.proportional_sample(x, "cwe", "id", 31, 2),
        lambda x: sampling.coverage_first(x, "label", "cwe", "id", 3, 9),
        lambda x: sampling.stratified_split(x, "cwe", "id", 100, 50, 4),
        lambda x: splits.ratio_split(x, "id", 5, 0.8, 0.1),
    ):
        assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(same).collect()))


def test_splits(spark):
    rows, df = pool(spark, 100)
    n = Counter(r.split for r in splits.ratio_split(df, "id", 5, 0.8, 0.1).collect())
    assert n == {"train": 80, "validation": 10, "test": 10}
    s = sampling.stratified_split(df, "cwe", "id", 60, 20, 1)
    assert Counter(r.split for r in s.collect()) == {"train": 60, "validation": 20, "test": 20}
    assert splits.isolation_violations(s, "id").isEmpty() and not splits.isolation_violations(s, "cwe").isEmpty()
    three = splits.ratio_split(df.limit(3), "id", 5, 0.9, 0.1).collect()
    assert len(three) == 3 and "test" in {r.split for r in three}


def test_overlap(spark):
    df = lambda ids: spark.createDataFrame([(k, f"h{k % 10}", [f"cve-{k % 4}"]) for k in ids], "id long, h string, m array<string>")
    assert {r.id for r in overlap.shared_ids(df(range(5)), df(range(3, 9)), "id").collect()} == {3, 4}
    assert {(r.id, r.mark) for r in overlap.shared_marks(df([0, 4]), df([8, 9]), "id", "m").collect()} == {(8, "CVE-0")}
    assert {r.id for r in overlap.untrained(df(range(20, 25)), df([21, 3]), "h", ["h"]).collect()} == {20, 22, 24}
    fresh, unknown = overlap.untouched(df(range(4)), df([2, 9]), "id")
    assert {r.id for r in fresh.collect()} == {0, 1, 3} and {r.id for r in unknown.collect()} == {9}


def test_audits(spark):
    ranges = spark.createDataFrame([("a", 0, 9), ("a", 10, 19), ("b", 0, 9), ("b", 11, 12), ("c", 0, 9), ("c", 5, 12)], "k string, lo long, hi long")
    assert {r.k: (r.n_gaps, r.n_overlaps) for r in audit.contiguous(ranges, "k", "lo", "hi").collect()} == {"a": (0, 0), "b": (1, 0), "c": (0, 1)}
    methods = spark.createDataFrame([("f", "1"), ("f", "0"), ("g", "True"), ("g", "true"), ("h", "1")], "name string, before string")
    assert [r.name for r in audit.pair_supply(methods, ["name"], audit.truthy(F.col("before"))).collect()] == ["f"]
    diff = spark.createDataFrame([("diff --git a b\n--- a\n+++ b\n@@ -1 +1 @@\n-x\n+y\n+z",)], "t string")
    r = diff.select(*[v.alias(k) for k, v in audit.patch_statistics(F.col("t")).items()]).first()
    assert (r.n_files, r.n_hunks, r.n_added, r.n_removed) == (1, 1, 2, 1)


def test_records(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True)], "s string, o long, ok boolean")
    got = {(r.s, r.o): r.accepted_index for r in records.accepted_index(df, "s", "o", F.col("ok")).collect()}
    assert got == {("a", 1): 0, ("a", 3): 1, ("b", 1): 0}
    row = spark.range(1).select(records.compacted(F.array(*map(F.lit, ["a", " ", "b", "a", "c"])), 2).alias("x"), records.without_keys(F.create_map(F.lit("Label"), F.lit("1"), F.lit("k"), F.lit("2")), ["label"]).alias("m")).first()
    assert row.x == ["a", "b"] and row.m == {"k": "2"}


def test_c_functions():
    from lodestrata.operators.curation import c_functions

    code = '#define X "{" \\\n  {\nstatic int f(int a)\n{\n  char c = \'{\'; // }\n  /* } */ if (a) { g("}"); }\n}\nint x = 1; struct s { int y; };\nvoid g(void) {}\n'
    assert [(name, a, b) for name, a, b, _ in c_functions(code)] == [("f", 3, 7), ("g", 9, 9)]
    assert c_functions("") == [] and c_functions("}{") == []


def test_curation(spark):
    from lodestrata.operators import curation as K

    df = spark.createDataFrame([(1, "a\nb\nc", "a\nX\nc\nd")], "i int, b string, a string")
    r = df.select(K.line_diff("b", "a").alias("x")).first().x
    assert (r.added, r.removed) == (2, 1) and r.diff.startswith("---")
    rows = spark.createDataFrame([(1, "x", "y", 1, "p"), (2, "x", "x", 1, "p"), (3, "x", "y", 0, "p"), (4, "x", "y", 1, None)], "i int, b string, a string, label int, patch string")
    found = K.before_after(rows.withColumn("ok", K.pair_verified(F.col("label"), F.col("b"), F.col("a"), F.col("patch"), F.lit("CWE-1"))).drop("label"), "b", "a", F.col("ok"))
    assert sorted((r.i, r.side, r.code, r.label) for r in found.collect()) == [(1, "fixed_after", "y", 0), (1, "vulnerable_before", "x", 1), (2, "vulnerable_before", "x", 1), (3, "vulnerable_before", "x", 1), (4, "vulnerable_before", "x", 1)]
    features, gold, conflicts = K.split_fields(spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 6), (2, 1, "a", 7)], "k int, o int, g string, f int"), ["k"], ["g"], "o")
    assert sorted(map(tuple, gold.collect())) == [(1, "a"), (2, "a")] and "g" not in features.columns and [r.k for r in conflicts.collect()] == [1]
    yes, no = spark.createDataFrame([(1, True)], "n int, ok boolean"), spark.createDataFrame([(1, False)], "n int, ok boolean")
    manifest = spark.createDataFrame([(True,)], "approved boolean")
    assert K.approved(manifest, yes, yes).first().approved and not K.approved(manifest, yes, no).first().approved


@pytest.mark.parametrize("quota", [1, 12, 119, 121])
def test_category_pools_are_enough(spark, quota):
    """Only a part of the rows reaches a class's task; the choice is that from all rows, and none of a class with too few."""
    rows, df = pool(spark)
    got = Counter(r.label for r in sampling.category_round_robin(df, ["label"], "cell", "cwe", "project", "id", 7, quota).collect())
    assert got == ({0: quota, 1: quota} if quota <= 120 else {})


class TestGates:
    PASSING = {
        "n": 300, "complete": True, "both_answered": True, "both_labels": True, "precision": 1.0, "recall": 1.0, "false_positive_rate": 0.0, "abstention_rate": 0.0, "parse_rate": 1.0, "schema_rate": 1.0, "safety_rate": 1.0, "evidence_rate": 1.0,
        "repetition_rate": 0.0, "abnormal_length_rate": 0.0, "consistency_rate": 1.0, "evidence_precision": 1.0, "evidence_recall": 1.0, "renderer_rate": 1.0, "n_leaks": 0, "link_rate": 1.0, "n_generic": 0, "exact_duplicate_rate": 0.0, "single_target_rate": 0.0,
        "n_safety_claims": 0, "n_over_cutoff": 0, "n_over_budget": 0,
    }

    @pytest.mark.parametrize("contract", sorted(evaluation.GATES))
    def test_each_check_fails_alone(self, spark, contract):
        """By a figure beyond its limit, by null and by an absent figure; a passing row passes."""
        names = list(evaluation.GATES[contract])
        row = {k: self.PASSING[k] for k in names}
        bad = {k: False if row[k] is True else (99.0 if k in evaluation.CEILINGS else -1.0) for k in names}
        kinds = ", ".join(f"{k} {'boolean' if row[k] is True else 'double'}" for k in names)
        plain = lambda x: tuple(v if v is None or isinstance(v, bool) else float(v) for v in x)
        rows = [row] + [row | {k: v} for k in names for v in (bad[k], None)]
        got = [r.failed_checks for r in evaluation.gate(spark.createDataFrame([plain(r.values()) for r in rows], kinds).coalesce(1), contract).collect()]
        assert got == [""] + [k for k in names for _ in range(2)]
        frame = spark.createDataFrame([plain(row.values())], kinds)
        assert {k: evaluation.gate(frame.drop(k), contract).first().failed_checks for k in names[:3]} == {k: k for k in names[:3]}

    def test_exact_ratio(self, spark):
        """0.8999999 is rounded to 0.9 and is not enough."""
        m = spark.createDataFrame([(8_999_999, 1_000_001, 9_000_000, 5, 0.9, 1.0, 0.0)], "tp long, fp long, positives long, negatives long, precision double, recall double, false_positive_rate double")
        assert "precision" in evaluation.gate(m, {"precision": 0.9}).first().failed_checks

    def test_repeated_keys_fail(self, spark):
        df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, x string")
        with pytest.raises(Exception, match="repeated id"):
            evaluation.join_predictions(df.select("id").distinct(), df, "id").collect()

    def test_judged(self, spark):
        good = '{"assessment":"present","basis":"b","evidence":[2,3]}'
        outputs = [good, None, "[1]", '{"assessment":"present","basis":" ","evidence":[2]}', '{"assessment":"present","basis":"run this exploit","evidence":[]}', good.replace("3", "12"), good + "\u2028" * 3, "  \n", '{"assessment":"uncertain","basis":"b","evidence":[]}']
        rows = [(k, True, x, [2, 3], 9, x is None) for k, x in enumerate(outputs)]
        df = spark.createDataFrame(rows, "id long, is_positive boolean, raw_output string, gold_lines array<int>, n_lines int, missing boolean")
        got = [(r.parsed, r.schema_ok, r.safe, r.has_evidence, r.abnormal, r.decision, r.renders, r.n_shared) for r in evaluation.judged(df).orderBy("id").collect()]
        assert got[0] == (True, True, True, True, False, True, True, 2)
        assert got[1] == (False, False, False, False, False, None, False, 0) == got[2]
        assert got[3] == (True, False, True, False, False, None, False, 0)
        assert got[4] == (True, True, False, False, False, True, True, 0)
        assert got[5] == (True, True, True, True, False, True, False, 1)
        assert got[7] == (False, False, False, False, True, None, False, 0)
        assert got[8] == (True, True, True, True, False, None, True, 0)

    def test_target_audit_never_approves(self, spark):
        rows = [(f"t{k}", "present" if k % 2 else "not_observed", True, False, True, False, False, False, False) for k in range(100)]
        df = spark.createDataFrame(rows, "target string, label string, schema_ok boolean, leaked boolean, linked boolean, generic boolean, claim boolean, over_cutoff boolean, over_budget boolean")
        ok = evaluation.target_audit(df, {"present": 50}).first()
        assert (ok.automated_pass, ok.status, ok.overall_pass) == (True, "manual_review_required", False)
        short = evaluation.target_audit(df, {"present": 51}).first()
        assert (short.automated_pass, short.status) == (False, "evidence_supply_blocked")
        again = evaluation.target_audit(df.withColumn("target", F.lit("same")), {"present": 50}).first()
        assert again.status == "automated_quality_gate_failed" and again.failed_checks == "exact_duplicate_rate,single_target_rate"

    def test_classifier(self, spark):
        gold = spark.createDataFrame([(k, k % 2, k % 4 // 2) for k in range(40)], "id long, y int, week int")
        given = gold.select("id", (F.col("y") * 0.8 + 0.1).alias("s"))
        limits = {"precision": 0.9, "recall": 0.9, "false_positive_rate": 0.1, "roc_auc": 0.9, "average_precision": 0.9, "min_recall": 0.9, "max_fpr": 0.1}
        run = lambda p: evaluation.classifier_gate(gold, p, "id", "s", "y", "week", 0.5, "calibration", limits).first()
        assert run(given).passed
        assert run(given.where("id > 0")).failed_checks == run(given.unionAll(spark.createDataFrame([(99, 0.5)], "id long, s double"))).failed_checks == "complete"
        assert run(given.withColumn("s", 1 - F.col("s"))).failed_checks == "average_precision,false_positive_rate,max_fpr,min_recall,precision,recall,roc_auc"
        with pytest.raises(ValueError):
            evaluation.classifier_gate(gold, given, "id", "s", "y", "week", 0.5, "test", limits)


class TestRanks:
    def frame(self, spark):
        """A class with a third of all rows, many distinct values, ties of none."""
        rows = [(k, "hot" if k % 3 == 0 else f"c{k % 11}", (k * 7919) % 5003 / 5003) for k in range(3000)]
        return rows, spark.createDataFrame(rows, "id long, c string, s double")

    @pytest.mark.parametrize("descending", [False, True])
    def test_running_sums(self, spark, descending):
        from lodestrata.operators.ranks import running_sums

        rows, df = self.frame(spark)
        got = {r.id: r.id_before for r in running_sums(df, "s", ["id"], descending=descending).collect()}
        total, want = 0, {}
        for r in sorted(rows, key=lambda r: r[2], reverse=descending):
            want[r[0]] = total
            total += r[0]
        assert got == want

    def test_ranks_in_classes(self, spark):
        from lodestrata.functions.hashing import derived_seed
        from lodestrata.operators.ranks import draw_rank, key_rank

        rows, df = self.frame(spark)
        by_key, by_draw, want_key, want_draw = ({r.id: r.k for r in x.collect()} for x in (key_rank(df, "c", "id", "k"), draw_rank(df, "c", derived_seed(5, F.col("id")), "id", "k"), df.limit(0).withColumn("k", F.lit(0)), df.limit(0).withColumn("k", F.lit(0))))
        for c in {r[1] for r in rows}:
            mine = [r[0] for r in rows if r[1] == c]
            want_key |= {i: k for k, i in enumerate(sorted(mine), 1)}
            want_draw |= {i: k for k, i in enumerate(sorted(mine, key=lambda i: draw(5, i)), 1)}
        assert by_key == want_key and by_draw == want_draw

    def test_no_window_over_all_rows(self, spark):
        """The plans of the ranking metrics have no window without a partition but over one row a range."""
        _, df = self.frame(spark)
        df = df.withColumn("y", (F.col("id") % 2).cast("int"))
        for found in (evaluation.roc_auc(df, "s", "y"), evaluation.average_precision(df, "s", "y", "id"), evaluation.threshold_at_fpr(df, "s", "y", 0.1), evaluation.percentiles(df, "s", {"p": (0.5, "floor")})):
            windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
            assert windows and all("_bin" in x for x in windows)


def test_without_fields(spark):
    df = spark.sql("SELECT named_struct('Label', 1, 'k', array(named_struct('gold', 2, 'v', map('Split', 'x', 'm', 'y')))) AS s")
    got = df.select(records.without_fields(F.col("s"), df.schema["s"].dataType, ["label", "gold", "split"]).alias("s")).first().s
    assert got.asDict(True) == {"k": [{"v": {"m": "y"}}]}


def test_dump_tables(spark):
    lines = spark.createDataFrame([("CREATE TABLE a (x);",), ('create table if not exists "b" (y);',), ("INSERT INTO c VALUES (1);",)], "text string")
    assert {r.table_name for r in audit.missing_tables(lines, "text", ["a", "b", "c", "d"]).collect()} == {"c", "d"}
