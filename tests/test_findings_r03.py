"""Findings of the third round, each by a case that failed before."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F


class TestShares:
    def test_total_is_worked_out_once(self, spark):
        from lodestrata.functions.structures import features_by_layout, shares

        n = 20_000
        row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("double")).alias("v"))
        start = time.monotonic()
        got = row.select(features_by_layout({"a": shares(F.col("v"))}, [("a", n)], n + 1).alias("f")).first().f
        assert time.monotonic() - start < 15  # a sum for each element took minutes
        assert len(got) == n + 1 and got[1] == pytest.approx(2 / (n * (n + 1) / 2)) and got[-1] == 0

    def test_null_and_zero(self, spark):
        from lodestrata.functions.structures import shares

        rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, None])], "k int, v array<double>")
        assert {r.k: r.s for r in rows.select("k", shares(F.col("v")).alias("s")).collect()} == {1: [0.0, 0.0], 2: None, 3: [1.0, None]}


class TestPredictions:
    def test_long_outputs_do_not_pass_the_driver(self, spark):
        from lodestrata.operators.evaluation import join_predictions

        gold = spark.createDataFrame([(1, True), (2, False)], "k int, is_positive boolean")
        given = spark.createDataFrame([(1, "x" * 40_000)], "k int, raw_output string")
        joined = join_predictions(gold, given, "k")
        assert {r.k: (len(r.raw_output or ""), r.missing) for r in joined.collect()} == {1: (40_000, False), 2: (0, True)}
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


class TestSourceFiles:
    def test_cut_at_a_vertical_tab(self, spark):
        """The SQL's white space has no vertical tab, and its end is the very end."""
        from lodestrata.functions.text import PYTHON_SPACE, cleaned, truncated

        rows = spark.createDataFrame([(1, "ab \x0bcd"), (2, "ab  cd"), (3, "ab\t \ncd")], "k int, t string")
        cut = lambda **of: {r.k: r.x for r in rows.select("k", truncated(F.col("t"), 4, "|", **of).alias("x")).collect()}
        assert cut() == {1: "ab \x0b|", 2: "ab  |", 3: "ab|"}
        assert cut(space=PYTHON_SPACE) == {1: "ab|", 2: "ab  |", 3: "ab|"}
        assert rows.select(cleaned(F.concat(F.lit(" \x0b"), F.substring("t", 1, 4))).alias("x")).first().x == "\x0bab \x0b"


class TestLineDiff:
    def counts(self, spark, tmp_path, rows):
        from lodestrata.plans import catalog

        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        return {r.doc_id: (r.added, r.removed) for r in catalog.queries()["line_diffs"](spark, str(tmp_path)).collect()}

    def test_frequent_lines_match(self, spark, tmp_path):
        often = ["x", "", "the y"] * 200
        got = self.counts(spark, tmp_path, [(1, "\n".join(often)), (2, "THE a\nthe b\nTHE b\nthe a\nTHE b"), (3, None), (4, "éthe thé"), (5, "")])
        assert got == {1: (200, 200), 2: (2, 2), 4: (1, 1), 5: (0, 0)}

    def test_as_python_has_it(self):
        import difflib
        import random

        from lodestrata.operators.curation import unified_diff

        draw = random.Random(1)
        for _ in range(300):
            a = [draw.choice("abcd") for _ in range(draw.randrange(12))]
            b = [x for x in a if draw.random() < 0.8] + ["e"] * draw.randrange(3)
            got = unified_diff(a, b)
            if len(a) != len(b):
                assert got == list(difflib.unified_diff(a, b, lineterm=""))
            assert (got == []) == (a == b)


class TestContents:
    def test_worked_out_once_for_copies(self, spark):
        from lodestrata.operators.targets import by_content, targets

        calls = spark.sparkContext.accumulator(0)

        def sized(text):
            calls.add(1)
            return len(text or "")

        pairs = spark.createDataFrame([(k, "CWE-78" if k % 2 else None, f"system({k % 2});", "x;") for k in range(60)], "k int, w string, present_code string, fixed_code string").coalesce(1)
        of = lambda rows, key: rows.select(key, F.udf(sized, "int")("present_code").alias("n"))
        assert {(r.k, r.n) for r in by_content(pairs, "k", ["w", "present_code"], of).collect()} == {(k, 10) for k in range(60)}
        assert calls.value == 2
        assert targets(pairs, "k", "w", "v2", []).groupBy("side").count().count() == 2 and targets(pairs, "k", "w", "v2", []).count() == 120


class TestFiles:
    def test_numbered_from_file_to_file(self, spark, tmp_path):
        from lodestrata.sources import text as X

        (tmp_path / "b").write_bytes(b"3\n4\x0b5\n")
        (tmp_path / "a").write_bytes(b"1\r\n2\n")
        got = X.numbered_across(X.numbered_lines(spark, str(tmp_path))).collect()
        assert sorted((r.line_no, r.value) for r in got) == [(k, str(k)) for k in range(1, 6)]

    @pytest.mark.parametrize("name", ["numbered_line_ends", "csv_split_map"])
    def test_no_task_writes_all(self, spark, monkeypatch, name):
        from pyspark.sql import DataFrame

        from lodestrata.plans import catalog

        def refused(self, n):
            raise AssertionError("one task would do all rows")

        monkeypatch.setattr(DataFrame, "coalesce", refused)
        monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


class TestArchives:
    def test_no_archive_is_a_value(self, spark, tmp_path):
        """Several archives of a task, in order of members; only paths are read of an archive, and no group is handed on whole."""
        from lodestrata.sources import readers as R

        rows = [(f"a{k % 3}", f"m{k:03d}", bytes([k]) * k) for k in range(60)] + [(None, "m", b"x"), ("a0", "m000", b"")]
        written = R.write_zips(spark.createDataFrame(rows, "archive string, member string, content binary").coalesce(1), f"{tmp_path}/zips")
        assert "FlatMapGroups" not in written._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.archive or "", r.n_members) for r in written.collect()) == [("", 1), ("a0", 21), ("a1", 20), ("a2", 20)]
        found = R.zip_members(spark, f"{tmp_path}/zips/a*.zip")
        assert re.search(r"Project \[path#[0-9]+\]", found._jdf.queryExecution().optimizedPlan().toString())
        got = [(r.archive.rsplit("/", 1)[1][:-4], r.member, bytes(r.content)) for r in found.collect()]
        assert sorted(got) == sorted(r for r in rows if r[0]) and [r[1] for r in got if r[0] == "a1"] == [f"m{k:03d}" for k in range(1, 60, 3)]

    def test_whole_md5_in_steps(self, spark, tmp_path, monkeypatch):
        """Several files as one archive; no task takes much more than a step of its MD5."""
        import hashlib

        from lodestrata.sources import ranges as G

        monkeypatch.setattr(G, "STEP", 100)
        bodies = [bytes([k]) * (37 * k % 190) for k in range(12)]
        for k, body in enumerate(bodies):
            (tmp_path / f"f{k:02d}").write_bytes(body)
        files, whole = [(f"{tmp_path}/f{k:02d}", len(x)) for k, x in enumerate(bodies)], b"".join(bodies)
        assert G.whole_md5(spark, files) == hashlib.md5(whole).hexdigest() and G.whole_md5(spark, []) == hashlib.md5(b"").hexdigest()
        state = None
        for k in range(3):
            state = G.md5_step(state, iter([whole[k * 70 : k * 70 + 30], whole[k * 70 + 30 : k * 70 + 70]]), k == 2)
        assert state == hashlib.md5(whole[:210]).digest()
        parts = G.cut(spark, files, len(whole), 64, f"{tmp_path}/ranges").localCheckpoint()
        assert G.assemble(parts, f"{tmp_path}/archive", len(whole), hashlib.md5(whole).hexdigest()).isEmpty()
        assert b"".join(G.archive_bytes(f"{tmp_path}/archive")) == whole


class TestRoundTrip:
    def test_values_are_not_joined(self, spark):
        """Nulls, repeated rows that differ, and one key that is null; no row is expanded for a count of distinct values."""
        from lodestrata.operators.versions import round_trip

        side = lambda *rows: spark.createDataFrame(rows, "k int, t string")
        a, b = side((1, "x"), (2, None), (3, "m"), (None, "n"), (4, "q"), (5, None)), side((1, "x"), (1, "x!"), (2, None), (2, ""), (3, "M"), (None, "n"), (5, ""))
        found = round_trip({"a": a, "b": b}, "k", {"a": ["t"], "b": ["t"]})
        assert {r.k: ",".join(r.problems) for r in found.collect()} == {
            1: "repeated:b,unclear:b:t", 2: "differs:b:t,repeated:b,unclear:b:t", 3: "differs:b:t", None: "", 4: "missing:b", 5: "differs:b:t"}
        assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


class TestContracts:
    def test_record_is_read_once(self, spark):
        """A text is made and parsed once for all rules, a path is worked out only where it has places."""
        from lodestrata.functions import contracts as K

        rows = spark.createDataFrame([('{"id":"r"', "}"), ('{"id":', '""}'), ("{", "")], "a string, b string")
        found = rows.select(K.record_errors(F.concat("a", F.lit(""), "b"), K.record(["alpha"])).alias("e"))
        plan = found._jdf.queryExecution().analyzed().toString()
        assert plan.count("concat(a#") == 1 and plan.count("<root>.") == 0 and plan.count("CASE WHEN (<root>") == 0
        told = [{(e.path, e.rule, e.detail) for e in r.e} for r in found.collect()]
        assert told[0] == {("<root>", "required", k) for k in ("source", "input", "expected_output", "metadata")}
        assert told[1] == told[0] | {("id", "minLength", "")} and told[2] == {("<root>", "parse", "")}

    @pytest.mark.parametrize("text,rules", [("a Step-by-step plan, and run THIS exploit", 2), ("astep by step", 0), ("by-pass edr", 0)])
    def test_unsafe_patterns_are_told_apart(self, spark, text, rules):
        from lodestrata.functions import contracts as K

        row = spark.createDataFrame([(f'{{"expected_output":{{"a":["{text}"]}}}}',)], "t string")
        assert [e.rule for e in row.select(K.record_errors(F.col("t"), {}).alias("e")).first().e] == ["unsafe"] * rules


class TestWriteUps:
    def test_excerpt_is_worked_out_once(self, spark):
        """However many fields of a record are read; fences, notes and payloads that end with a line's white space."""
        from lodestrata.functions.text import PAYLOAD_NOTE
        from lodestrata.operators.adapters import writeup_records

        texts = {1: " # A **b**\n```\ncurl x\n ``` \nkept\nwget; NC -l\ncurl \n```sh\nopen", 2: "```\nx", 3: "a\n```\n```\n```\nx\n\x0b```\nb\n", 4: "nc x\u2028# T"}
        files = spark.createDataFrame([(k, f"d/{k}.tar.md", t) for k, t in texts.items()], "k int, path string, text string")
        found = writeup_records(files, "k", "path", "text", "s").select("k", "record.id", "record.input.context", "record.input.signals", "record.expected_output.risk_level")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Redacted excerpt") == 1
        head = lambda title, k, body: f"Title: {title}\nRelative path: d/{k}.tar.md\n\nRedacted excerpt:\n{body}"
        got = {r.k: r.context for r in found.collect()}
        assert got[1] == head("A b", 1, f"# A **b**\nkept\n{PAYLOAD_NOTE}\ncurl") and got[2] == head("2.tar", 2, "").rstrip("\n")
        assert got[3] == head("3.tar", 3, "a\nb") and got[4] == head("T", 4, f"{PAYLOAD_NOTE}\n# T")


class TestNearNormal:
    def test_no_pattern_for_plain_white_space(self, spark):
        from lodestrata.functions.text import ASCII_SPACE, has_hit, near_normal

        texts = ["A\tb \x0bc\r\n d\x0c/", "x // Y\nz /* a\n*/ b /*", "/**/ //", "", None, "a\xa0 B"]
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        found = rows.select("k", near_normal(F.col("t"), ASCII_SPACE).alias("x"))
        assert {r.k: r.x for r in found.collect()} == {0: "abcd/", 1: "xzb/*", 2: "", 3: "", 4: None, 5: "a\xa0 b"}
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
        calls = spark.createDataFrame([("x eval (y)",), ("exec()",), ("medieval(1)",), ("eval",), ("EVAL(",)], "t string")
        assert [r.x for r in calls.select(has_hit(F.col("t"), "dynamic_execution").alias("x")).collect()] == [True, True, False, False, False]
