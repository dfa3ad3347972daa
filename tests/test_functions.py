"""Column functions against their rule stated in Python."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import hashing as H
from lodestrata.functions import rates as R
from lodestrata.functions import structures as S
from lodestrata.functions import text as T


def values(spark, texts, *columns):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


TEXTS = ["", " ", "abc", "int x; // c\n/* a\n b */ y\tZ", "A B\x1cC\xa0d", "password = hunter2; my_API_KEY=abc,d", "취약 safe", "é" * 3]


def test_hashes(spark):
    seed = lambda x: int(hashlib.sha256(f"7:{x}".encode()).hexdigest()[:16], 16)
    for x, (u, split, short) in zip(TEXTS, values(spark, TEXTS, H.derived_seed(7, F.col("t")), H.hash_split(7, F.col("t")), H.sha(F.col("t"), 12))):
        assert int(u) == seed(x)
        assert split == ("train" if seed(x) % 10000 < 8000 else "validation" if seed(x) % 10000 < 9000 else "test")
        assert short == hashlib.sha256(x.encode()).hexdigest()[:12]


def test_priority(spark):
    for x, (p,) in zip(TEXTS, values(spark, TEXTS, H.exponential_priority(7, F.col("t"), F.lit(0.5)))):
        u = (int(hashlib.sha256(f"7:{x}".encode()).hexdigest()[:16], 16) + 1) / (2**64 + 1)
        assert p == pytest.approx(-math.log(u) / 0.5, rel=1e-9)


def test_near_normal(spark):
    for x, (got,) in zip(TEXTS, values(spark, TEXTS, T.near_normal(F.col("t")))):
        assert got == re.sub(r"\s+", "", re.sub(r"/\*.*?\*/|//[^\n]*", "", x, flags=re.S)).lower()


def test_redaction(spark):
    got = values(spark, TEXTS, T.redacted(F.col("t")), T.redactions(F.col("t")))
    assert got[5] == ("password = [REDACTED_SECRET]; my_API_KEY = [REDACTED_SECRET],d", 2)
    assert got[2] == ("abc", 0)


def test_scans(spark):
    texts = ["x = eval (y)", "os.system('a') open(f)", "this program is safe", "bypass EDR now", "nothing", "취약", "labeled vulnerable train split BigVul"]
    got = values(spark, texts, T.named_hits(F.col("t"), T.SUSPICIOUS), T.any_match(F.col("t"), T.GLOBAL_SAFETY_CLAIMS), T.any_match(F.col("t"), T.UNSAFE_GUIDANCE), T.risk_of(F.col("t")), T.leakage_flags(F.col("t"), F.array(F.lit("Target"), F.lit("k"))))
    assert got[0][0] == ["dynamic_execution"] and got[1][0] == ["process_execution", "filesystem_modification"]
    assert [x[1] for x in got] == [False, False, True, False, False, False, False]
    assert [x[2] for x in got] == [False, False, False, True, False, False, False]
    assert [x[3] for x in got][2:6] == ["low", "unknown", "unknown", "high"]
    assert got[6][4] == ["dataset_label", "dataset_name", "signal_key:Target", "split"]


def repeats(text):
    lines = [" ".join(x.split()) for x in text.split("\n") if x.strip()]
    if any(len(x) >= 24 and lines.count(x) >= 4 for x in set(lines)):
        return True, None
    return False, None


def repeats_windows(text):
    tokens = re.findall(r"\S+", text)
    for w in (8, 16, 32):
        for s in range(len(tokens) - 4 * w + 1):
            if all(tokens[s + w * k : s + w * (k + 1)] == tokens[s : s + w] for k in range(1, 4)):
                return True
    return False


def test_repetition(spark):
    random.seed(5)
    texts = ["", "x"]
    for _ in range(60):
        w = random.choice([4, 8, 16, 32, 5])
        unit = [random.choice("abcdef") for _ in range(w)]
        tokens = [random.choice("xyz") for _ in range(random.randint(0, 9))] + unit * random.choice([2, 3, 4, 5]) + unit[: random.randint(0, w)] + list("pq")
        texts.append(" ".join(tokens))
        line = "a line of text with over twenty-four characters "
        texts.append("\n".join([line + str(k % random.choice([1, 2, 5])) for k in range(random.randint(1, 9))] + ["short"] * 6))
    got = values(spark, texts, T.repeats_lines(F.col("t")), T.repeats_tokens(F.col("t")))
    assert [x[0] for x in got] == [repeats(t)[0] for t in texts]
    assert [x[1] for x in got] == [repeats_windows(t) for t in texts]


def test_small_text_rules(spark):
    texts = ["a\n```c\nint x;\n```\nb", "Code excerpt:\n x ", "Vulnerable excerpt:\ny Code excerpt:\nz", "plain", "  ", "a; b{c}\na; "]
    got = values(spark, texts, T.without_fences(F.col("t")), T.code_of(F.col("t")), T.abnormal_length(F.col("t")), T.statements(F.col("t")), F.array_join(T.numbered_lines(F.col("t")), "\n"))
    assert got[0][0] == "a\nb" and got[1][1] == "x" and got[2][1] == "z" and got[3][1] is None
    assert [x[2] for x in got] == [False, False, False, False, True, False]
    assert got[5][3] == ["a", "b", "c"] and got[5][4] == "0001|a; b{c}\n0002|a; "


def test_strict_objects(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} tail', '{"a":1}}', '{"a":1},2', '{"a":1}],[', "{'a':1}", "[1]", "null", "", '{"a":{"b":[1,2]}}', '{"a":1}{"b":2}', '{"a":1}],"b":[1']
    assert [x[0] for x in values(spark, texts, S.is_json_object(F.col("t")))] == [True, True, False, False, False, False, False, False, False, False, True, False, False]


def test_ranges(spark):
    random.seed(1)
    cases = [sorted({(a := random.randint(1, 12), a + random.randint(0, 4)) for _ in range(random.randint(0, 5))}) for _ in range(40)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "i long, r array<struct<a:int,b:int>>")
    rows = df.select("i", S.merged_ranges(F.col("r")).alias("m"), S.lines_of(F.col("r")).alias("l")).orderBy("i").collect()
    for c, row in zip(cases, rows):
        merged = []
        for a, b in c:
            if merged and a <= merged[-1][1] + 1:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        assert [tuple(x) for x in row.m] == merged
        assert row.l == sorted({x for a, b in c for x in range(a, b + 1)})


def test_spans(spark):
    df = spark.createDataFrame([("l1\nl2\nl3", "l2\nl3"), ("l1", "x")], "t string, s string")
    got = df.select(S.span_lines(F.col("t"), F.col("s")).alias("x"), S.grounded(F.col("t"), F.array("s")).alias("g")).collect()
    assert tuple(got[0].x) == (2, 3) and got[0].g and got[1].x is None and not got[1].g


@pytest.mark.parametrize(("expected", "actual", "scores"), [([], [], (1, 1, 1, 0)), (["a"], [], (0, 0, 0, 0)), ([], ["a"], (0, 0, 0, 1)), (["a", "b"], ["b", "c", "c"], (0.5, 0.5, 0.5, 1))])
def test_overlap_scores(spark, expected, actual, scores):
    df = spark.createDataFrame([(expected, actual)], "e array<string>, a array<string>")
    row = df.select(*[v.alias(k) for k, v in S.overlap_scores(F.col("e"), F.col("a")).items()]).first()
    assert (row.precision, row.recall, row.f1, row.hallucinated) == pytest.approx(scores)


def test_rates(spark):
    df = spark.createDataFrame([(84, 200), (0, 0), (5, 5)], "k long, n long")
    got = df.select(R.ratio(F.col("k"), F.col("n")).alias("r"), R.wilson_lower(F.col("k"), F.col("n")).alias("w")).collect()
    assert [r.r for r in got] == [0.42, 0.0, 1.0]
    z = 1.96
    for (k, n), r in zip([(84, 200), (0, 0), (5, 5)], got):
        if n:
            p = k / n
            want = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
            assert r.w == pytest.approx(want)
        else:
            assert r.w == 0


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 3.0], ["high", "low"]), ([0.0, 0.0], []), (None, None)], "v array<double>, c array<string>")
    got = df.select(S.shares(F.col("v")).alias("s"), S.fixed_length(F.col("v"), 2).alias("f"), S.least_confidence(F.col("c")).alias("c"), S.padded(F.col("v"), 4).alias("p")).collect()
    assert got[0].s == [0.25, 0.75] and got[1].s == [0.0, 0.0] and [r.f for r in got] == [True, True, False]
    assert [r.c for r in got] == ["low", "low", "low"] and got[0].p == [1.0, 3.0, 0.0, 0.0]
