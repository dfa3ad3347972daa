"""Hooks for what the engine does not have itself: tokenizers and text generators, called in batches inside tasks.

A *factory* is a function without arguments that gives a callable; it is called once for each worker. Nothing whole
passes through the driver: rows go to Python in Arrow batches and come back as columns.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tokenizer = Callable[[list[str]], list[int]]
Message = dict[str, str]
Generator = Callable[[list[list[Message]]], list[str]]

_made: dict[str, Callable] = {}


def _once(factory: Callable[[], Callable], name: str) -> Callable:
    """What the factory gives, made once for each worker and call of a hook; what another call has made is let go."""
    if name not in _made:
        _made.clear()
        _made[name] = factory()
    return _made[name]


def with_token_counts(rows: DataFrame, text: str, factory: Callable[[], Tokenizer], name: str = "n_tokens") -> DataFrame:
    """``rows`` with the number of tokens of a column of texts; null has none, that is null."""
    label = uuid.uuid4().hex  # two factories may have one name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _once(factory, label)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = iter(count([x for x in texts if x is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else int(next(found)) for x in texts], pa.int64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(name, T.LongType())]))


def generated(chats: DataFrame, key: str, messages: str, factory: Callable[[], Generator], path: str, model_id: str, run_id: str, waves: int = 8, batch: int = 32, stop_after: int | None = None) -> DataFrame:
    """The answers to ``chats`` (key; messages: array<struct<role, content>>), one row for each, stored at ``path``.

    The chats are dealt to ``waves`` by the hash of their key, and each wave's answers are committed to ``path`` as one, so
    a run that is stopped loses one wave at most: a rerun answers only keys without an answer there, and tries
    those again that had an error. A batch that fails is repeated chat by chat, and a chat that fails has its error in its row
    (and no raw_output). An empty or repeated key fails the job before anything is answered. ``stop_after``: waves to run.
    """
    spark = chats.sparkSession
    source = chats.select(F.col(key).cast("string").alias("record_id"), F.col(messages).alias("messages"))
    bad = source.groupBy("record_id").count().where("record_id is null or record_id = '' or count > 1").limit(1).collect()
    if bad:
        raise ValueError(f"empty or repeated key: {bad[0]['record_id']!r}")
    label = uuid.uuid4().hex  # two factories may have one name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = _once(factory, label)

        def one(chats: list[list[Message]]) -> tuple[list[str | None], list[str | None]]:
            try:
                found = list(answer(chats))
                if len(found) != len(chats):
                    raise ValueError(f"{len(found)} answers to {len(chats)} chats")
                return found, [None] * len(chats)
            except Exception as error:  # noqa: BLE001  whatever a backend raises belongs to its row
                if len(chats) == 1:
                    return [None], [f"{type(error).__name__}: {error}"[:500]]
                parts = [one([c]) for c in chats]
                return [p[0][0] for p in parts], [p[1][0] for p in parts]

        for rows in batches:
            for low in range(0, rows.num_rows, batch):
                part = rows.slice(low, batch)
                chats, began = part.column("messages").to_pylist(), time.perf_counter()
                found, errors = one(chats)
                spent = round((time.perf_counter() - began) * 1000 / len(chats), 4)
                columns = [part.column("record_id"), pa.array(found, pa.string()), pa.array(errors, pa.string()), pa.array([spent] * len(chats)), pa.array([len(c or []) for c in chats], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["record_id", "raw_output", "error", "latency_ms", "prompt_message_count"])

    schema = "record_id string, raw_output string, error string, latency_ms double, prompt_message_count int"
    stored = f"{schema}, model_id string, run_id string, wave int"
    spark.createDataFrame([], stored).write.mode("append").parquet(path)
    for wave in range(waves if stop_after is None else min(waves, stop_after)):
        done = spark.read.schema(stored).parquet(path).where("error is null").select("record_id")
        todo = source.where(F.pmod(F.xxhash64("record_id"), F.lit(waves)) == wave).join(done, "record_id", "left_anti")
        answers = todo.mapInArrow(run, schema).select("*", F.lit(model_id).alias("model_id"), F.lit(run_id).alias("run_id"), F.lit(wave).alias("wave"))
        answers.write.mode("append").parquet(path)
    return answers_at(chats, path)


def answers_at(chats: DataFrame, path: str) -> DataFrame:
    """The stored answers, one row for each key: one without an error if there is one."""
    rows = chats.sparkSession.read.parquet(path)
    best = rows.groupBy("record_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "record_id"]), F.struct(F.col("error").isNotNull(), "error")).alias("r"))
    return best.select("record_id", "r.*")


def training_text(messages: Column) -> Column:
    """All messages of a chat as one text, for counting."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\n"), m["content"])), "\n")
