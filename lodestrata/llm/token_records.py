"""Token ids in length-delimited binary record files, with a separate offset index.

File format: a shard is a run of frames; a frame is
``u64 length | u32 masked crc of the 8 length bytes | payload | u32 masked crc of the payload | 0x0A``, all
little-endian. The checksum is CRC-32 masked as ``(crc >> 15 | crc << 17) + 0xA282EAD8`` modulo 2**32. A payload
is ``u8 bytes per id | u16 length of the key, 65535 for none | key (the doc_id as text, UTF-8) | ids``.
The closing 0x0A is the separator that Spark's text sink writes after a row, so shards are written through
Spark's own commit protocol, to any store that Spark can write, and survive lost executors. The offset index
is a Parquet table of shard, record, offset, length, doc_id, n_tokens, ids_crc32, ``before`` (ids of the same
shard before the record): a shuffled read needs only the index and ranges of the shards.

Ids are in ascending order of doc_id over the shards' numbers: null ids come first, and rows with equal
doc_id are ordered by a hash of their text, then by the text. A null text is empty: its sequence is the end id alone. A very long
text is one record, whose ids are held whole. An empty table gives no shard and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import textkit as K
from lodestrata.llm.storage import join_checked, new_path, plain, table

END_ID = 0
#: Bytes of frames that are handed to the sink at once.
CHUNK_BYTES = 4_000_000
#: Chunks of a shard at most, so about 256 MB: a shard is read back as one value.
SHARD_CHUNKS = 64
#: Bytes of texts that are encoded at once.
ENCODE_BYTES = 8_000_000
#: Records of a shard that are handed on at once when it is read.
RECORDS = 20_000
#: Pre-tokens whose ids a worker remembers, at about 300 bytes each; beyond that it starts anew.
MEMO = 800_000
_MASK_DELTA = 0xA282EAD8

# The byte-level pattern over code points up to U+02C1, where "letter" and "number" are plain ranges. Texts with
# other characters (or with the separators U+001C to U+001F) are encoded whole.
_BEYOND = re.compile("[^\x00-\x1b\x20-ˁ]")
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ˁ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as bytes.

    Byte-level models split a text into pre-tokens before they merge, so each distinct pre-token is encoded
    once and remembered, and each distinct piece of the texts at hand is put together once. Models of any other kind, and texts with special tokens, are encoded whole.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind["pre_tokenizer"] or {}
        self.by_pre_token = kind["model"]["type"] == "BPE" and not kind["model"].get("dropout") and kind["normalizer"] is None and kind["truncation"] is None and kind["padding"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.special = [x["content"] for x in kind["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.most = memo
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of pieces that begin with a space
        self.opens[[i for piece, i in vocabulary.items() if piece[0] == "Ġ"]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode pre-tokens; those of a space and letters in long runs, where each begins with a piece that has the space."""
        runnable, rest = [], []
        for w in words:
            (runnable if w[0] == " " and w[1:].isalpha() else rest).append(w)
        runs = [runnable[k : k + 2000] for k in range(0, len(runnable), 2000)]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast(["".join(x) for x in runs], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * self.dtype.itemsize
            data, cuts = ids.tobytes(), cuts.tolist()
            assert len(cuts) == len(run) + 1
            self.memo.update((w, data[low:high]) for w, low, high in zip(run, cuts, cuts[1:]))
        for w, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.memo[w] = np.array(found.ids, self.dtype).tobytes()

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts by their pre-tokens. No pre-token reaches across a space before another character: each distinct piece between such places is looked up once."""
        raw = [x.encode("utf-8") for x in texts]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths
        if not len(data):
            return [b""] * len(texts)
        at, is_start = np.flatnonzero(data[:-1] == 0x20), np.zeros(len(data), bool)
        is_start[starts[lengths > 0]] = True
        after, wide = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        at = at[~(_SPACE[after] | (after == 0xC2) & ((wide == 0x85) | (wide == 0xA0)) | is_start[at + 1])]
        is_start[at] = True
        cuts = np.append(np.flatnonzero(is_start), len(data))
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        piece, words = coded.indices.to_numpy(), list(map(_PRE_TOKEN.findall, coded.dictionary.to_numpy(zero_copy_only=False)))
        self._learn(list(set().union(*words) - self.memo.keys()))
        ids = [b"".join(map(self.memo.__getitem__, x)) for x in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        n, first = sizes[piece], (np.cumsum(sizes) - sizes)[piece]
        before = np.append(0, np.cumsum(n))
        out = np.frombuffer(b"".join(ids), self.dtype)[np.repeat(first - before[:-1], n) + np.arange(before[-1])]
        edges = before[np.searchsorted(cuts, np.append(starts, len(data)))]
        return [out[low:high].tobytes() for low, high in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo.clear()
        split = [self.by_pre_token and not _BEYOND.search(x) and not any(mark in x for mark in self.special) for x in texts]
        joined = iter(self._joined([x for x, known in zip(texts, split) if known]))
        return [next(joined) if known else self._whole(x) for x, known in zip(texts, split)]


@lru_cache(maxsize=1)
def encoder_of(path: str, memo: int = MEMO) -> Encoder:
    """One encoder for all tasks of a worker, until it turns to another operator."""
    K.keep(__name__, encoder_of.cache_clear)
    return Encoder(path, memo)


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(key: str | None, ids: bytes, width: int) -> bytes:
    """A record without its closing separator."""
    name = b"" if key is None else key.encode("utf-8")
    payload = struct.pack("<BH", width, 0xFFFF if key is None else len(name)) + name + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def records(data: bytes | pa.Buffer) -> Iterator[tuple[int, int, str | None, np.ndarray]]:
    """Offset, frame length, key and ids of each record of a shard; raises if a checksum does not hold."""
    view, at = memoryview(data), 0
    while at < len(data):
        n = struct.unpack_from("<Q", data, at)[0]
        payload = view[at + 12 : at + 12 + n]
        if struct.unpack_from("<I", data, at + 8)[0] != masked_crc(view[at : at + 8]) or struct.unpack_from("<I", data, at + 12 + n)[0] != masked_crc(payload):
            raise ValueError(f"broken record at byte {at}")
        width, size = struct.unpack_from("<BH", payload)
        key = None if size == 0xFFFF else bytes(payload[3 : 3 + size]).decode("utf-8")
        yield at, n + 17, key, np.frombuffer(payload[3 + (0 if key is None else size) :], f"<u{width}")
        at += n + 17


def _write(path: str, memo: int, chunk: int):
    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, memo)
        end = np.array([END_ID], encoder.dtype).tobytes()
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for low, high in K.slices(batch.column("text"), ENCODE_BYTES):
                part = batch.slice(low, high - low)
                for key, ids in zip(part.column("key").to_pylist(), encoder.encode([x or "" for x in part.column("text").to_pylist()])):
                    held.append(frame(key, ids + end, encoder.dtype.itemsize))
                    size += len(held[-1])
                    if size > chunk:
                        yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], ["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], ["value"])

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, memo: int = MEMO) -> None:
    """Write the ids of all texts below ``path``, in ascending order of doc_id; shards of at most SHARD_CHUNKS chunks, one partition's in a row."""
    tie = F.xxhash64("text")  # so that even rows of one doc_id spread over partitions
    source = plain(docs, "doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    chunks = source.select(F.col("doc_id").cast("string").alias("key"), "text").mapInArrow(_write(tokenizer_path, memo, CHUNK_BYTES), "value binary")
    sink = chunks.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", SHARD_CHUNKS)
    sink.option("lineSep", "\n").option("compression", "none").text(path)


INDEX = "shard long, record long, offset long, length long, doc_id string, n_tokens long, ids_crc32 long, before long"


@K.released
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in INDEX.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            # between both is a UUID, of which a part may begin with c and a digit too
            part, number = re.search(r"part-(\d+).*-c(\d+)[^-]*$", batch.column("path")[k].as_py().rpartition("/")[2]).groups()
            shard = (int(part) << 24) + int(number)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            rows, before = [], 0
            for record, (at, n, key, ids) in enumerate(records(batch.column("content")[k].as_buffer())):
                rows.append((shard, record, at, n, key, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), before))
                before += len(ids)
                if len(rows) == RECORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read all shards back, check every frame, and store the offset index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    files.mapInArrow(_read, INDEX).write.option("compression", "zstd").parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in a random order that depends on ``seed`` alone: shard, offset, length of each record."""
    return index.select("shard", "offset", "length", "doc_id").orderBy(F.xxhash64(F.lit(seed), "shard", "record"), "shard", "record")


def token_records(docs: DataFrame, tokenizer_path: str, memo: int = MEMO) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files read back."""
    spark = docs.sparkSession
    shards, index_path = new_path(spark, "shards"), new_path(spark, "offsets")
    write_shards(docs, tokenizer_path, shards, memo)
    index = write_index(spark, shards, index_path)
    # one row a shard: the ids of all shards before it
    base = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return join_checked(index, base, "shard").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
