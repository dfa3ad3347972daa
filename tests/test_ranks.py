"""Ranks and running sums in ranges: every kind of key, uneven keys, ties, null classes, many ranges."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ranks as R


@pytest.mark.parametrize("kind", ["long", "double", "string", "date", "timestamp"])
@pytest.mark.parametrize("rows", [7, 40, 10_000])
def test_every_kind_of_key(spark, kind, rows):
    draw = random.Random(3)
    make = {"long": lambda k: k if k else 2**62, "double": lambda k: k / 7, "string": lambda k: f"k{k % 50}-{k}", "date": lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k), "timestamp": lambda k: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=k)}[kind]
    data = [(make(k), draw.choice(["a", "b", None]), draw.randrange(9)) for k in range(500)]
    df = spark.createDataFrame(data, f"k {kind}, g string, n long").repartition(3)
    got = {(r.k, r.g): r.n_before for r in R.running_sums(df, "k", ["n"], ["g"], rows=rows).collect()}
    want, total = {}, {}
    for k, g, n in sorted(data, key=lambda x: x[0]):
        want[k, g] = total.get(g, 0)
        total[g] = want[k, g] + n
    assert got == want


def test_one_far_key_leaves_ranges_even(spark):
    df = spark.range(20_000).unionAll(spark.range(2**62, 2**62 + 1)).toDF("id")
    sizes = [r["count"] for r in df.groupBy(R.bin_of(df, "id", 1000).alias("b")).count().collect()]
    assert len(sizes) > 15 and max(sizes) < 4000


def test_more_ranges_than_a_tree_has(spark, monkeypatch):
    monkeypatch.setattr(R, "TREE", 4)
    df = spark.range(3000).select((F.col("id") * 37 % 3001).alias("id"))
    got = sorted((r.id, r.b) for r in df.select("id", R.bin_of(df, "id", 50).alias("b")).collect())
    assert [b for _, b in got] == sorted(b for _, b in got) and len({b for _, b in got}) > 40
    assert [r.r for r in R.key_rank(df, [], "id", "r").orderBy("id").collect()] == list(range(1, 3001))


def test_null_keys_and_ties(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (5, 1), (1, 3)], "k long, t long")
    assert [(r.k, r.t, r.r) for r in R.key_rank(df, [], "k", "r", ["t"]).orderBy("r").collect()] == [(None, 1, 1), (1, 3, 2), (5, 1, 3), (5, 2, 4)]


def test_lines_of_a_file_in_parts(spark, tmp_path):
    """Numbers do not depend on where a file is cut; errors have them."""
    from lodestrata.sources import text as X

    ends = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r\n"]
    whole = "".join(f'{{"a":{k}}}{" " * (k % 7)}{ends[k % 11]}' for k in range(2000)) + 'oops\n{"a":-1}\n'
    (tmp_path / "x.jsonl").write_bytes(whole.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = X.numbered_lines(spark, str(tmp_path / "x.jsonl"))
        assert lines.rdd.getNumPartitions() > 1
        assert [r.value for r in lines.orderBy("line_no").collect()] == whole.splitlines()
        assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(1, len(whole.splitlines()) + 1))
        assert [(r.line_no, r.value) for r in X.numbered_jsonl_errors(spark, str(tmp_path / "x.jsonl")).collect()] == [(2001, "oops")]
        with pytest.raises(Exception, match="line 2001 is no JSON object: oops"):
            X.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int", python_ends=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
