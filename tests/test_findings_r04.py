"""Findings of the fourth round, each by a case that failed before."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

BLANK, NO_ID, LETTERS = [(i, t) for i in range(4) for t in ("", " \n　", None, "a\n")], [(None, t) for t in ("", None, "a")], [(i, t) for i in range(4, 8) for t in ("AİB", "ΟΣ x", "ΟΣ")]


class TestRawPatchRows:
    @pytest.mark.parametrize("given", [BLANK, NO_ID, LETTERS])
    def test_as_the_sql_has_it(self, spark, tmp_path, given):
        from lodestrata.plans import catalog

        rows = [(i, t, lang, "s") for i, t in given for lang in ("en", None)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        got = catalog.queries()["raw_patch_rows"](spark, str(tmp_path))
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()['raw_patch_rows']})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))

    def test_ends_are_kept_only_where_told(self, spark):
        from lodestrata.operators.adapters import patch_raw_rows

        names = ["text", "after", "positive", "patch", "lang", "source", "commit", "file"]
        rows = spark.createDataFrame([(1, " a", " b ", 1, "p", "x", "s", "c", "f")], ["doc_id", *names])
        codes = lambda **of: sorted(r.code for r in patch_raw_rows(rows, "doc_id", "d", *names, **of).collect())
        assert codes() == ["a", "b"] and codes(stripped=True) == [" a", " b "]


class TestLowerCase:
    def test_a_character_each(self, spark):
        from lodestrata.functions.text import ASCII_SPACE, near_normal

        rows = spark.createDataFrame([(1, "Aİ B"), (2, "ΟΣ /* x */"), (3, None)], "k int, t string")
        for space in ({}, {"space": ASCII_SPACE}):
            assert {r.k: r.x for r in rows.select("k", near_normal(F.col("t"), **space).alias("x")).collect()} == {1: "aib", 2: "οσ", 3: None}
