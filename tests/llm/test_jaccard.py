"""Groups of near duplicates against all pairs of whole shingle sets."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from tests.llm import brute

ROWS = "doc_id long, text string"


def shingles(text: str | None) -> frozenset:
    words = (text or "").translate(brute.LOWER).encode().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts: list[str | None]) -> list[int]:
    """The least place that each text is linked to, over all pairs."""
    sets = [shingles(x) for x in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] == sets[b] or (shared and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared)):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return [top(k) for k in range(len(texts))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table(spark, sf):
    from lodestrata.llm.jaccard import keep_one_similar

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = sorted({rows[k][0] for k in groups([x for _, x in rows])})
    assert sorted(r.doc_id for r in keep_one_similar(docs).collect()) == want


def test_stage_joins_similar_texts(spark):
    """Words changed one by one: within 0.8 of a neighbour, beyond 2 bits, the ends of the chain far apart."""
    import corpus_pipeline
    from lodestrata.llm.near_dup import keep_one

    random.seed(5)
    words = [f"w{random.randrange(10**6)}" for _ in range(100)]
    rows = []
    for k in range(8):
        rows.append((k, " ".join(words)))
        words[10 * k + 5] = f"x{k}"
    docs = spark.createDataFrame([*rows, (50, "something else of quite other words altogether")], ROWS)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()) == [0, 50]
    assert keep_one(docs).count() > 2


def test_ids(spark):
    """Repeated and null ids, texts that differ in case and white space, null texts."""
    from lodestrata.llm.jaccard import keep_one_similar

    a, b, c = "One two three\nfour five six", "other words stand here in this one", "a third text without any id"
    rows = [(1, a), (1, b), (2, a.lower()), (3, b), (None, a), (None, c), (None, c), (4, None), (5, ""), (1, a)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in keep_one_similar(spark.createDataFrame(rows, ROWS)).collect())
    assert got == sorted([(False, 1, a), (False, 1, b), (True, 0, c), (False, 4, "")])
    assert keep_one_similar(spark.createDataFrame([], ROWS)).count() == 0
