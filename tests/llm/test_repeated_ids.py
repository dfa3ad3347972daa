"""Repeated ids: benchmark rows that share one, and documents whose texts differ."""

from __future__ import annotations

import pytest


@pytest.mark.parametrize("item", [7, None])
def test_items_of_two_lengths(spark, item):
    from lodestrata.llm.decontaminate import decontaminate

    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(item, " ".join(words[50:55])), (item, " ".join(words[10:20]))], "item_id long, text string")
    assert [(r.n_hit, r.contaminated) for r in decontaminate(docs, bench).collect()] == [(15, True)]


def test_keep_one_of_each_component(spark):
    """A doc_id with texts in two components names both, and each keeps a row."""
    from lodestrata.llm.near_dup import keep_one

    a, b = "one two three four five six", "other words that stand in this text"
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (1, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in keep_one(docs).collect()) == [(1, a), (1, b)]
