"""Language identification by compression: the dictionary that makes a text smallest names its language.

One raw-content dictionary per language is filled from a bounded sample of labelled rows: the ``SAMPLE_ROWS``
different rows of each language with the least hash of id and text, until ``DICTIONARY_BYTES`` are reached. Every whole text, in lower case
and with one space for all between its letters (like the samples), is compressed with each dictionary in blocks of
``BLOCK_BYTES`` (so that what repeats in a long text does not outweigh the dictionary), and the blocks' sizes are
summed. A narrow margin between the two smallest sums marks the prediction as rejected. The cost of a text grows
with the number of languages, as each has a dictionary of its own.

Defined cases: a null text, or one without a letter (Unicode category L; numerals such as ``½`` are none), gives
``und`` with score 0 and is rejected. A very long text is judged block by block like any other. Ties go to the
language with more learned rows, then to the first by code point. With one learned language only, its score is 1; with none, all are
``und``. Null ``doc_id`` or lang are not learned from. Repeated rows are judged alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import textkit as K
from lodestrata.llm.storage import plain, stored, table

SAMPLE_ROWS = 1000
DICTIONARY_BYTES = 300_000
LEVEL = 9
BLOCK_BYTES = 500
#: A relative margin of this size gives a score of 1 - 1/e.
MARGIN_SCALE = 0.02
#: Predictions with a smaller relative margin are rejected.
MIN_MARGIN = 0.01

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    """A text's words in lower case, with one space between them, as UTF-8."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8")


def held_out(of: int, is_: int):
    """Whether crc32(doc_id as text) modulo ``of`` is ``is_``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == is_, F.lit(False))


def dictionaries(rows: DataFrame) -> dict[str, bytes]:
    """The dictionary of each language, from labelled rows (doc_id, text, lang), the most frequent language first.

    Rows are ranked without their texts; a bounded number of each language is then read.
    """
    known = rows.where("lang is not null and text is not null and doc_id is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return {}
    shares, chosen = {r["lang"]: min(1.0, 4 * SAMPLE_ROWS / r["n"]) for r in counts}, None
    while shares:
        # in a large language only hashes low enough to be among the least are ranked, so that no task sees all its rows
        share = F.broadcast(known.sparkSession.createDataFrame(list(shares.items()), "lang string, share double"))
        low = known.select("h", "lang").join(share, "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("share")).select("h", "lang").distinct()
        ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= SAMPLE_ROWS)
        ranked = stored(ranked, "ranked")
        found = {r["lang"]: r["count"] for r in ranked.groupBy("lang").count().collect()}
        # where rows repeat too few differ: rank a larger share of that language
        shares = {lang: min(1.0, 16 * x) for lang, x in shares.items() if x < 1 and found.get(lang, 0) < SAMPLE_ROWS}
        ranked = ranked.where(~F.col("lang").isin(list(shares)))
        chosen = ranked if chosen is None else chosen.unionAll(ranked)
    texts = known.select("h", "lang", "text").join(F.broadcast(chosen), ["h", "lang"])  # SAMPLE_ROWS rows for each language
    filled = texts.groupBy("lang", "rank").agg(F.min("text").alias("text"))  # one of repeated rows
    upto = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    needed = filled.withColumn("before", F.coalesce(upto, F.lit(0))).where(F.col("before") < DICTIONARY_BYTES)
    found: dict[str, bytes] = {r["lang"]: b"" for r in sorted(counts, key=lambda r: (-r["n"], r["lang"]))}
    # what no dictionary has room for stays where it is: a letter has one byte at least
    for r in needed.orderBy("lang", "rank").select("lang", F.substring(F.regexp_replace("text", r"[^\p{L}\p{M}]++", " "), 1, DICTIONARY_BYTES).alias("text")).collect():
        found[r["lang"]] = (found[r["lang"]] + letters(r["text"]) + b" ")[:DICTIONARY_BYTES]
    return found


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as Z

        self.models = []
        for lang, content in dictionaries.items():
            held = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.models.append((lang, Z.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not text or not self.models or not _LETTER.search(text):
            return "und", 0.0, True
        if len(self.models) == 1:
            return self.models[0][0], 1.0, False
        data = letters(text)
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        (least, k), (second, _) = sorted((sum(len(c.compress(x)) for x in blocks), k) for k, (_, c) in enumerate(self.models))[:2]
        lang, margin = self.models[k][0], (second - least) / second
        return lang, 1 - exp(-margin / MARGIN_SCALE), margin < MIN_MARGIN


def identify(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of ``docs``; ``learn``: labelled rows (doc_id, text, lang)."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries(plain(learn, "doc_id", "text", "lang")))

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(held.value)
        for batch in batches:
            found = [classifier.judge(x.as_py()) for x in batch.column("text")]
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "rejected"])

    source = plain(docs, "doc_id", "text")
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *T.StructType.fromDDL("lang_pred string, score double, rejected boolean")]))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(~held_out(4, 2)))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")
