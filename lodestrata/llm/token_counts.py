"""Token counts of whole texts for a sentencepiece or tokenizers model, without keeping ids.

A text is split where no piece of the model can reach across: before runs of spaces and at line feeds. The
pieces of each distinct pre-token are counted once in a worker (the counts are remembered up to ``MEMO``
pre-tokens), joined to the document's pre-token frequencies, and summed. The join stays inside the task:
as most distinct pre-tokens of a corpus occur in few documents, a table of all of them would be larger
to shuffle than the texts.

The split is exact only if no piece holds a space behind another character, and none holds a line feed;
models for which that does not hold are run on whole texts. Defined cases: a null text counts as empty, with no
bytes and no tokens; a very long text is split into pre-tokens as a whole, so that its words are held at once; repeated rows are counted alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestrata.llm import textkit as K
from lodestrata.llm.storage import plain, table

LIMIT = 4096
MEMO = 500_000
_SPACE = "▁"


class PieceCounter:
    def __init__(self, path: str):
        self.memo: dict[str, int] = {}
        self.split = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            self.count = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
            return
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        plain_spaces = model.encode(" \n", out_type=str) == [2 * _SPACE, "<0x0A>"] and model.encode("a  a", out_type=str) == [_SPACE + "a", _SPACE, _SPACE + "a"]
        if plain_spaces and not any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
            self.split = re.compile(f"[ {_SPACE}]+[^ {_SPACE}\n]*|\n[^ {_SPACE}\n]*")

    def _learn(self, words: list[str]) -> None:
        # the model sets a space before each text: it stands for the first one of a pre-token, or is taken off again
        counts = self.count([w if w[0] == "\n" else w[1:] for w in words])
        self.memo.update((w, n - 1 if w[0] == "\n" else n or 1) for w, n in zip(words, counts))

    def totals(self, texts: list[str]) -> list[int]:
        if self.split is None:
            return self.count(texts)
        frequencies = [Counter(self.split.findall(" " + x)) if x else Counter() for x in texts]
        new = set().union(*frequencies) - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = set().union(*frequencies)
        self._learn(list(new))
        memo = self.memo
        return [sum(n * memo[w] for w, n in f.items()) for f in frequencies]


@lru_cache(maxsize=1)
def counter_of(path: str) -> PieceCounter:
    """One counter for all tasks of a worker, until it turns to another operator."""
    K.keep(__name__, counter_of.cache_clear)
    return PieceCounter(path)


def _count(path: str, limit: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                n = counter.totals(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row; one scan, no shuffle."""
    source = plain(docs, "doc_id", "text")
    return source.mapInArrow(_count(model_path, limit), T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean")]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
