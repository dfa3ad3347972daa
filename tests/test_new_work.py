"""Schemas, hooks, versions, annotations, ranges and targets: what the registered queries do not reach."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F


class TestJsonSchema:
    def errors(self, spark, schema, *values):
        from lodestrata.functions.json_schema import errors_of

        rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, t string")
        return [[(e.path, e.rule, e.detail) for e in r.e] for r in rows.select("k", errors_of(F.col("t"), schema).alias("e")).orderBy("k").collect()]

    def test_types(self, spark):
        value = lambda kind: {"properties": {"a": {"type": kind}}}
        fits = {"string": ["", "x"], "integer": [1, 2.0, -3], "number": [1, 1.5], "boolean": [True], "null": [None], "array": [[], [1]], "object": [{}, {"b": 1}]}
        every = [x for v in fits.values() for x in v]
        for kind, good in fits.items():
            found = self.errors(spark, value(kind), *[{"a": x} for x in every])
            same = lambda x, y: type(x) is type(y) and x == y
            ok = lambda x: any(same(x, y) for y in good) or (kind == "number" and type(x) in (int, float))
            assert found == [[] if ok(x) else [("a", "type", "")] for x in every], kind
        assert self.errors(spark, value(["string", "null"]), {"a": None}, {"a": "x"}, {"a": 1}, {}) == [[], [], [("a", "type", "")], []]

    @pytest.mark.parametrize(
        ("rules", "good", "bad"),
        [
            ({"minLength": 2}, ["ab", 1, []], ["a", ""]),
            ({"maxLength": 2}, ["é\U0001f600", 123], ["abc"]),
            ({"pattern": "^[0-9]+$"}, ["12", 3], ["1a", ""]),
            ({"minimum": 1}, [1, 1.5, "0"], [0, 0.5, -1]),
            ({"maximum": 5}, [5, -1], [6, 5.5]),
            ({"enum": ["a", None, 1, False]}, ["a", None, 1, False], ["b", 0, True, []]),
            ({"const": False}, [False], [0, "false", None]),
            ({"minItems": 1}, [[1], "x"], [[]]),
            ({"maxItems": 1}, [[1], []], [[1, 2]]),
            ({"uniqueItems": True}, [[1, 2], [{"a": 1, "b": 2}, {"a": 1}]], [[1, 1], [{"a": 1, "b": 2}, {"b": 2, "a": 1}]]),
        ],
    )
    def test_keywords(self, spark, rules, good, bad):
        found = self.errors(spark, {"properties": {"a": rules}}, *[{"a": x} for x in good + bad])
        assert found == [[]] * len(good) + [[("a", next(iter(rules)), "")]] * len(bad)

    def test_nested_paths_and_conditions(self, spark):
        schema = {"required": ["a"], "additionalProperties": False, "properties": {"a": {"items": {"items": {"type": "integer"}}}, "b": {}}, "allOf": [{"if": {"required": ["b"]}, "then": {"properties": {"a": {"minItems": 1}}}, "else": {"properties": {"a": {"maxItems": 1}}}}]}
        assert self.errors(spark, schema, {"a": [[1], [2, "x", []]], "b": 1}, {"b": None}, {"a": [[], []]}, {"a": [], "b": 0}, {"a": [], "z": 1, "y": 2}) == [
            [("a.1.1", "type", ""), ("a.1.2", "type", "")], [("<root>", "required", "a")], [("a", "maxItems", "")], [("a", "minItems", "")], [("<root>", "additionalProperties", "y,z")],
        ]

    def test_unknown_rule(self):
        from lodestrata.functions.json_schema import errors_of

        with pytest.raises(ValueError, match="oneOf"):
            errors_of(F.lit("{}"), {"oneOf": []})

    def test_strings(self, spark):
        from lodestrata.functions.json_schema import strings_of

        value = {"k\"ey:": ["a\"b", {"x": "c\\", "y": "d: \n"}], "z": ":"}
        got = spark.createDataFrame([(json.dumps(value),)], "t string").select(strings_of(F.col("t")).alias("s")).first().s
        assert got == ['a"b', "c\\", "d: \n", ":"]


def failing_and_right():
    """Factories that travel by value, as workers do not have this module."""

    def failing():
        def answer(chats):
            if any(c[0]["content"] == "bad" for c in chats):
                raise RuntimeError("no answer")
            return [c[0]["content"].upper() for c in chats]

        return answer

    return failing, lambda: lambda chats: ["second " + c[0]["content"] for c in chats]


class TestHooks:
    def chats(self, spark, *texts):
        message = F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))
        return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", message.alias("m"))

    def test_resume_and_errors(self, spark, tmp_path):
        from lodestrata.operators.hooks import generated

        _failing, _right = failing_and_right()
        chats, path = self.chats(spark, *[f"t{k}" for k in range(20)], "bad"), str(tmp_path / "a")
        first = {r.record_id: r for r in generated(chats, "k", "m", _failing, path, "m1", "r1", waves=4, stop_after=2).collect()}
        assert 0 < len(first) < 21
        rest = {r.record_id: r for r in generated(chats, "k", "m", _failing, path, "m1", "r1", waves=4).collect()}
        assert len(rest) == 21 and rest["20"].error == "RuntimeError: no answer" and rest["20"].raw_output is None
        assert all(rest[str(k)].raw_output == f"T{k}" and rest[str(k)].error is None for k in range(20))
        # another rerun asks only what failed
        again = {r.record_id: r.raw_output for r in generated(chats, "k", "m", _right, path, "m1", "r2", waves=4).collect()}
        assert again == {str(k): f"T{k}" for k in range(20)} | {"20": "second bad"}

    def test_keys(self, spark, tmp_path):
        from lodestrata.operators.hooks import generated

        twice = self.chats(spark, "a").unionAll(self.chats(spark, "b"))
        with pytest.raises(ValueError, match="repeated"):
            generated(twice, "k", "m", failing_and_right()[1], str(tmp_path / "b"), "m", "r")

    def test_token_counts(self, spark):
        from lodestrata.operators.hooks import with_token_counts
        from lodestrata.plans.versions import word_tokenizer

        rows = spark.createDataFrame([(1, "a b-c"), (2, None), (3, "")], "k int, t string")
        assert [r.n_tokens for r in with_token_counts(rows, "t", word_tokenizer).orderBy("k").collect()] == [4, None, 0]


class TestVersions:
    def test_null_keys_and_values(self, spark):
        from lodestrata.operators.versions import round_trip

        make = lambda rows: spark.createDataFrame(rows, "k long, v string")
        sides = {"a": make([(1, None), (None, "x"), (2, "y"), (2, "z")]), "b": make([(1, None), (None, "w")])}
        got = {r.k: r.problems for r in round_trip(sides, "k", {"a": ["v"], "b": ["v"]}).collect()}
        assert got == {1: [], None: ["differs:b:v"], 2: ["missing:b", "repeated:a", "unclear:a:v"]}

    def test_null_differs_from_text(self, spark):
        from lodestrata.operators.versions import carried_reviews

        reviews = spark.createDataFrame([(1, None, "pass"), (2, "null", "pass"), (3, "", "pass")], "k long, v string, d string")
        queue = spark.createDataFrame([(1, "null"), (2, None), (3, "")], "k long, v string")
        got = {r.k: (r.outcome, r.carried_decision) for r in carried_reviews(reviews, queue, "k", ["v"], "d", F.lit(True), F.lit(True)).collect()}
        assert got == {1: ("stale", None), 2: ("stale", None), 3: ("carried", "pass")}


class TestLayout:
    def test_wrong_length(self, spark):
        from lodestrata.functions.structures import features_by_layout, placed

        layout = [("a", 2), ("b", 1)]
        assert placed(layout) == {"a": (0, 2), "b": (2, 3)}
        parts = {"a": F.array(F.lit(1.0)), "b": F.array(F.lit(2.0))}
        with pytest.raises(Exception, match="a: 2 values are wanted, there are 1"):
            spark.range(1).select(features_by_layout(parts, layout, 5).alias("f")).collect()
        with pytest.raises(ValueError, match="longer"):
            features_by_layout(parts, layout, 2)


class TestAnnotations:
    def test_one_pass(self):
        from lodestrata.operators.annotations import annotated, cleaned, following

        code = 'int f_bad(void) {\n  /* FIX: a "string" // here */\n  call("/* no */ FIX: no", \'"\',\n    2); // POTENTIAL FLAW: last\n  done();\n}'
        rows = list(annotated(code))
        assert [(r[3], r[4], r[5], r[6]) for r in rows] == [("fix", 'a "string" // here', 3, 4), ("flaw", "last", 5, 5)]
        assert rows[0][1].count("\n") == code.count("\n") and "FIX: a" not in rows[0][1] and "sample_function" in rows[0][1]
        assert following("  ", 0) is None and following("a = b", 0) == (0, 5)
        assert cleaned("x /* open", {})[0] == "x "

    def test_left_out(self, spark):
        from lodestrata.operators.annotations import annotated_functions

        files = spark.createDataFrame([(1, "void f(void) {\n#if A\n/* FIX: x */ a();\n#endif\n}"), (2, None), (3, "")], "k int, t string")
        assert [(r.k, r.reason) for r in annotated_functions(files, "k", "t").collect()] == [(1, "conditional_preprocessor")]


class TestRanges:
    def test_bytes_come_back(self, spark, tmp_path):
        from lodestrata.sources import ranges as G

        data = bytes(range(256)) * 40 + b"end"
        (tmp_path / "x").write_bytes(data)
        parts = G.cut(spark, str(tmp_path / "x"), len(data), 1000, str(tmp_path / "parts"))
        parts = spark.createDataFrame(parts.collect(), G.PART)
        out = str(tmp_path / "archive")
        assert G.assemble(parts, out, len(data), hashlib.md5(data).hexdigest()).count() == 0
        assert b"".join(G.archive_bytes(out)) == data
        with pytest.raises(FileExistsError):
            G.assemble(parts, out, len(data))
        assert [tuple(r) for r in G.assemble(parts.limit(0), f"{out}2", 5).collect()] == [(0, "no_parts")]
        wrong = parts.withColumn("end", F.when(F.col("start") == 0, F.col("end")).otherwise(F.col("end")))
        (tmp_path / "parts" / f"range-{0:020d}").write_bytes(b"short")
        assert [tuple(r) for r in G.assemble(wrong, f"{out}3", len(data)).collect()] == [(0, "wrong_size")]
        assert sorted(x.name for x in tmp_path.iterdir()) == ["archive", "parts", "x"]  # nothing half done stays


class TestTargets:
    def pairs(self, spark, *rows):
        return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, w string, present_code string, fixed_code string")

    def test_unknown_contract(self, spark):
        from lodestrata.operators.targets import targets

        with pytest.raises(ValueError, match="unknown contract"):
            targets(self.pairs(spark, ("CWE-78", "a", "b")), "k", "w", "v9", [])

    def test_empty_and_null_code(self, spark):
        from lodestrata.operators.targets import targets

        pairs = self.pairs(spark, ("CWE-78", None, "system(a);"), ("CWE-78", "", ""), (None, "x;", "y;"))
        got = {(r.k, r.side): r.reason for r in targets(pairs, "k", "w", "v2", []).collect()}
        assert got == {(k, side): "no_observable_relation" for k in range(3) for side in ("present", "fixed")}

    def test_names(self, spark):
        from lodestrata.operators.targets import identifiers_of, statements_of

        row = spark.createDataFrame([("  {\n int i_1 = (char)data + undefined4;\r\n\n if (x)\n printLine(y)\n if (z) {\n;  \n data = 1;\n data = 1;",)], "c string")
        got = row.select(statements_of(F.col("c")).alias("s")).first().s
        assert got == ["int i_1 = (char)data + undefined4;", "if (x)", "if (z) {", ";", "data = 1;"]
        assert row.select(identifiers_of(F.lit("int i_1 = (char)data + undefined4; printIt(Data)")).alias("n")).first().n == ["data", "Data"]
