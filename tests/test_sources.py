"""Readers and writers on small files."""

from __future__ import annotations

import gzip
import json
import sqlite3
import zipfile

import pyarrow as pa
import pytest

from lodestrata.operators.audit import statement_counts
from lodestrata.sources import readers, text


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1, "s": "x y"}\n\n  \n{"a": 2}\n', encoding="utf-8")
    rows = text.read_jsonl(spark, str(good), "a long, s string").collect()
    assert sorted((r.a, r.s) for r in rows) == [(1, "x y"), (2, None)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n[1]\n{"a": 2} x\n')
    with pytest.raises(Exception, match="not a JSON object"):
        text.read_jsonl(spark, str(bad), "a long").collect()
    ok, rest = text.quarantined_jsonl(spark, str(bad), "a long")
    assert ok.count() == 1 and rest.count() == 2


def test_json_array(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert text.read_json_or_jsonl(spark, str(path), "a long").count() == 2


def test_predictions(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    row = {"record_id": "1", "model_id": "m", "run_id": "r", "raw_output": "{}", "latency_ms": 1.5}
    path.write_text(json.dumps(row))
    assert text.read_predictions(spark, str(path)).first().latency_ms == 1.5
    path2 = tmp_path / "q.jsonl"
    path2.write_text(json.dumps(row | {"run_id": ""}))
    with pytest.raises(Exception, match="without run_id"):
        text.read_predictions(spark, str(path2)).collect()


def test_csv_with_line_ends(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b,c\n1,"x\ny ""q""",2\n3,z,4\n')
    rows = text.read_csv(spark, str(path), "a int, b string, c int", ["c", "b"]).collect()
    assert [(r.c, r.b) for r in rows] == [(2, 'x\ny "q"'), (4, "z")]


def test_line_pairs(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(f'{{"a": {k}}}\n' for k in range(6)))
    rows = text.read_line_pairs(spark, str(path), "a long").orderBy("pair").collect()
    assert [(r.first.a, r.second.a) for r in rows] == [(0, 1), (2, 3), (4, 5)]
    path.write_text("".join(f'{{"a": {k}}}\n' for k in range(5)))
    with pytest.raises(Exception, match="unpaired line"):
        text.read_line_pairs(spark, str(path), "a long").collect()


def test_freeze(spark, tmp_path):
    out = str(tmp_path / "frozen")
    inventory = text.freeze({"x": spark.range(5).toDF("id"), "y": spark.range(2).toDF("id")}, out)
    assert spark.read.parquet(f"{out}/x").count() == 5 and inventory.count() >= 2
    assert text.broken_files(spark, out, inventory).isEmpty()
    with pytest.raises(FileExistsError):
        text.freeze({"x": spark.range(5).toDF("id")}, out)
    with pytest.raises(ValueError, match="nothing to write"):
        text.freeze({"x": spark.range(0).toDF("id")}, str(tmp_path / "other"))
    assert not list(tmp_path.glob("other*"))
    victim = next((tmp_path / "frozen" / "y").glob("part-*"))
    victim.unlink()
    assert not text.broken_files(spark, out, inventory).isEmpty()


def test_write_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None)], "b int, a string, c string")
    text.write_jsonl(df, str(tmp_path / "o"), single=True)
    files = list((tmp_path / "o").glob("part-*"))
    assert len(files) == 1 and files[0].read_text(encoding="utf-8") == '{"a":"é","b":1,"c":null}\n'


def test_splits(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "a int, split string")
    text.write_splits(df, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=test", "split=train"]
    for name in ("train", "test"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / "tmp" / name))
    target = tmp_path / "named"
    target.mkdir()
    for name in ("train", "test"):
        next((tmp_path / "tmp" / name).glob("part-*.parquet")).rename(target / f"{name}-0.parquet")
    rows = text.read_parquet_split(spark, str(target)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in rows} == {"train": 3, "test": 3}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t (a INTEGER, b TEXT, secret TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, f"b{k}", "s") for k in range(10)])
    db.commit()
    db.close()
    for parts in (1, 3):
        df = readers.read_sqlite(spark, path, "t", "a long, b string", parts)
        assert df.columns == ["a", "b"] and sorted(r.a for r in df.collect()) == list(range(10))


def test_arrow(spark, tmp_path):
    path = str(tmp_path / "x.arrow")
    table = pa.table({"name": ["a", "b"], "n": pa.array([1, 2], pa.int64())})
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
        writer.write_table(table)
    assert sorted((r.name, r.n) for r in readers.read_arrow(spark, path).collect()) == [("a", 1), ("a", 1), ("b", 2), ("b", 2)]


def test_zip(spark, tmp_path):
    path = str(tmp_path / "x.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("b/x.jsonl", '{"a":1}\n\n{"a":2}\n')
        z.writestr("a/y.txt", "hi")
        z.writestr("../evil.exe", "no")
        z.writestr("in.zip", "z")
    members = readers.zip_members(spark, path)
    assert [r.member for r in members.collect()] == ["../evil.exe", "a/y.txt", "b/x.jsonl", "in.zip"]
    assert [(r.line_no, r.line) for r in readers.zip_lines(spark, path, r"\.jsonl$").collect()] == [(1, '{"a":1}'), (3, '{"a":2}')]
    r = readers.zip_inventory(members, [".exe"]).first()
    assert (r.n_members, r.n_unsafe, r.n_forbidden, r.n_nested, r.n_encrypted) == (4, 1, 1, 1, 0)


def test_dump(spark, tmp_path):
    path = tmp_path / "d.sql.gz"
    lines = ["PRAGMA foreign_keys=OFF;", "BEGIN TRANSACTION;", "CREATE TABLE t(a);", "INSERT INTO t VALUES(1);", "INSERT INTO t VALUES(2);", "ATTACH 'x' AS y;", "COMMIT;"]
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    counts, bad = statement_counts(text.read_dump(spark, str(path)), "text")
    assert {r.statement: r.n for r in counts.collect()} == {"pragma": 1, "transaction": 2, "create": 1, "insert": 2, "dangerous": 1}
    assert [r.line_no for r in bad.collect()] == [6]


def test_files(spark, tmp_path):
    (tmp_path / "d" / ".git").mkdir(parents=True)
    (tmp_path / "d" / "a.py").write_text("x\ny")
    (tmp_path / "d" / "b.md").write_text("no")
    (tmp_path / "d" / ".git" / "c.py").write_text("no")
    assert [r.text for r in text.read_files(spark, str(tmp_path / "d"), "*.py").collect()] == ["x\ny"]
