"""Queries over all rows and whole texts, against plain Python, on texts whose fences, markers and identifiers stand late."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
FENCED = "before the fence there are more than forty characters\n```py\nx = 1\n```\nafter"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The documents, and some whose fences, markers and identifiers stand late."""
    path = str(tmp_path_factory.mktemp("whole"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    late = [(90001, FENCED, "de", "s", 1), (90002, "x " * 400 + "late_name", "fr", "s", 1), (90003, "y " * 100 + "Code excerpt:\n tail ", "es", "s", 1), (90004, "x " * 400 + "other_name", "fr", "s", 1)]
    rows = spark.createDataFrame(late, "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(rows.select(*[rows[c].cast(t).alias(c) for c, t in docs.dtypes])).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()


def run(spark, folder, name):
    from lodestrata.plans import catalog

    return catalog.queries()[name](spark, folder).collect()


def test_fences(spark, folder, docs):
    def plain(text):
        inside, out = False, []
        for x in text.split("\n"):
            if x.strip().startswith("```"):
                inside = not inside
            elif not inside:
                out.append(x)
        return "\n".join(out)

    want = {r.doc_id: plain("\t```\nhidden\n  ```\n" * (r.doc_id % 3 == 0) + r.text + "\n```c\nint main;\n```\nend") for r in docs}
    assert {r.doc_id: r.kept for r in run(spark, folder, "fenced_code_removal")} == want
    assert "x = 1" not in want[90001] and "after" in want[90001]


def test_markers(spark, folder, docs):
    from lodestrata.functions.text import CODE_MARKERS

    def plain(k, text):
        text = ["Code excerpt:\n\t" + text, text + "\nVulnerable excerpt:\na Source-code excerpt:\n\xa0b \r", text][k % 3]
        return next((text.split(m, 1)[1].strip() for m in CODE_MARKERS if m in text), None)

    want = {r.doc_id: plain(r.doc_id, r.text) for r in docs}
    assert {r.doc_id: r.code for r in run(spark, folder, "marked_code")} == want


def test_identifiers(spark, folder, docs):
    import re

    want = {r.doc_id: ",".join(sorted({x for x in re.findall(r"\b[A-Za-z_][A-Za-z0-9_]*\b", re.sub(r"[^\x00-\x7f]", " ", r.text), re.A) if len(x) >= 3} - {"the", "and", "for"})) for r in docs}
    assert {r.doc_id: r.identifiers for r in run(spark, folder, "identifier_extraction")} == want
    assert want[90002] == "late_name"


def test_instruction_ids(spark, folder, docs):
    import hashlib

    def plain(r):
        both = "\n\n".join(x for x in ((r.lang or "").strip(), r.text.strip()) if x)
        return f"legacy-alpaca-{r.doc_id:06d}-{hashlib.sha256(both.encode()).hexdigest()[:12]}"

    want = {r.doc_id: plain(r) for r in docs}
    assert {r.doc_id: r.id for r in run(spark, folder, "instruction_adapter")} == want
    assert want[90002][-12:] != want[90004][-12:]


def test_packets(spark, folder, docs):
    ids = [r.doc_id for r in docs]
    want = {k // 10 + 1: "\n".join(f"- [{k + i + 1}] {x}" for i, x in enumerate(ids[k : k + 10])) for k in range(0, len(ids), 10)}
    got = run(spark, folder, "review_packets")
    assert {r.packet: r.text for r in got} == want and sum(r.n for r in got) == len(ids)


def test_quota_split(spark, folder, docs):
    names = ["train"] * 40 + ["validation"] * 20 + ["test"] * 20
    want = {r.doc_id: names[k] if k < 80 else None for k, r in enumerate(docs)}
    assert {r.doc_id: r.split for r in run(spark, folder, "contiguous_quota_split")} == want
