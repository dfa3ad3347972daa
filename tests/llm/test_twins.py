"""Queries of the subpackage against their SQL twins."""

from __future__ import annotations

import duckdb
import pytest

from lodestrata.llm import chat, queries
from tests.llm import test_contracts

SF = "/root/testdata/sf0.001"


def compare(got, cursor):
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = cursor.fetchall()
    order = sorted(names)
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(repr([r[names.index(c)] for c in order]) for r in want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compare(queries.queries()[name](spark, SF), duck.execute(queries.oracle_sql()[name]))


def test_quoting_twin(spark):
    """The supplied conversations quote nothing; these do."""
    more = [(7, 0, "user", "first\n\nsecond paragraph\nof two lines")]
    more += [(7, k, "user", ">" * (k % 3 + 1) + f" second   PARAGRAPH\n> of two lines\nAnn wrote:\n> first\nreply {k}\n> reply {k - 1}") for k in range(1, 9)]
    rows = test_contracts.TestChat.ROWS + more
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    compare(chat.format_conversations(df), duck.execute(chat.ORACLE))
