"""Archives in byte ranges: cut into parts, checked, and assembled again, each part by a task that streams it.

No file is ever a value: a task copies ``CHUNK`` bytes at a time through the file systems that Arrow knows. An assembled archive
is a folder of its parts in the order of their names, which a rename publishes at once; nothing is published if a check fails.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.sources.text import _fs

CHUNK = 8_000_000
PART = "path string, start long, end long, md5 string"
#: Bytes that one task adds to the MD5 of a whole archive.
STEP = 512_000_000


def _open(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _stream(path: str, start: int = 0, length: int | None = None) -> Iterator[bytes]:
    files, at = _open(path)
    with files.open_input_file(at) as source:
        source.seek(start)
        while length is None or length > 0:
            chunk = source.read(CHUNK if length is None else min(CHUNK, length))
            if not chunk:
                return
            if length is not None:
                length -= len(chunk)
            yield chunk


def _spread(rows: DataFrame) -> DataFrame:
    """A row to a task, about."""
    return rows.repartition(max(1, min(rows.count(), 10_000)), "start")


def _md5_library() -> ctypes.CDLL | None:
    """The library behind hashlib, whose MD5 can be left and taken up again; None if it isn't that one."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        return library if library.MD5_Init and library.MD5_Update and library.MD5_Final else None
    except (ImportError, AttributeError, OSError):
        return None


def md5_step(state: bytes | None, chunks: Iterator[bytes], last: bool) -> bytes:
    """The state of an MD5 after further bytes, or its digest after the last; ``state``: None at the start."""
    library = _md5_library()
    if library is None:
        if state is not None or not last:
            raise OSError("this Python's MD5 can't be taken up again")
        digest = hashlib.md5(usedforsecurity=False)
        for chunk in chunks:
            digest.update(chunk)
        return digest.digest()
    held, out = ctypes.create_string_buffer(state or b"", 256), ctypes.create_string_buffer(16)
    if state is None:
        library.MD5_Init(held)
    for chunk in chunks:
        library.MD5_Update(held, chunk, ctypes.c_size_t(len(chunk)))
    if last:
        library.MD5_Final(out, held)
    return out.raw if last else held.raw


def whole_md5(spark: SparkSession, files: list[tuple[str, int]]) -> str:
    """The MD5 of files (path, size) that follow each other: one task after another takes ``STEP`` bytes of them, and hands on the state."""
    length = STEP if _md5_library() else max(1, sum(size for _, size in files))
    groups, state, low = defaultdict(list), None, 0
    for path, size in files:
        for k in range(low // length, -(-(low + size) // length)):
            start, stop = max(low, k * length), min(low + size, (k + 1) * length)
            groups[k].append((path, start - low, stop - start))
        low += size
    steps = [groups[k] for k in sorted(groups)] or [[]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = md5_step(row["state"] if row["state"] is None else bytes(row["state"]), (chunk for path, start, n in map(dict.values, row["pieces"]) for chunk in _stream(path, start, n)), row["last"])
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["state"])

    for k, pieces in enumerate(steps):
        given = spark.createDataFrame([(state, pieces, k == len(steps) - 1)], "state binary, pieces array<struct<path:string,start:long,length:long>>, last boolean").coalesce(1)
        state = bytes(given.mapInArrow(run, "state binary").first()[0])
    return state.hex()


def cut(spark: SparkSession, path: str | list[tuple[str, int]], size: int, part_bytes: int, folder: str) -> DataFrame:
    """Copies a file of ``size`` bytes, or files (path, size) that follow each other, to parts below ``folder``, and returns them (PART), with their MD5."""
    files = [(path, size)] if isinstance(path, str) else path
    starts = spark.range(0, size, part_bytes).select(F.col("id").alias("start"), F.least(F.col("id") + part_bytes, F.lit(size)).alias("stop"))

    def bytes_of(start: int, stop: int) -> Iterator[bytes]:
        low = 0
        for name, n in files:
            if max(start, low) < min(stop, low + n):
                yield from _stream(name, max(start, low) - low, min(stop, low + n) - max(start, low))
            low += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in zip(batch.column("start").to_pylist(), batch.column("stop").to_pylist()):
                target, digest = f"{folder}/range-{start:020d}", hashlib.md5(usedforsecurity=False)
                system, at = _open(target)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(at) as sink:
                    for chunk in bytes_of(start, stop):
                        digest.update(chunk)
                        sink.write(chunk)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (target, start, stop - 1, digest.hexdigest())], ["path", "start", "end", "md5"])

    return _spread(starts).mapInArrow(run, PART)


def range_errors(parts: DataFrame, size: int) -> DataFrame:
    """start, error of parts (start, end) that do not follow each other from 0 to ``size`` without a gap or an overlap."""
    order = Window.partitionBy(F.lit(0)).orderBy("start", "end")  # one row for each part
    step = F.col("start") - F.coalesce(F.lag("end").over(order) + 1, F.lit(0))
    is_last = F.lead("start").over(order).isNull()
    marked = parts.select("start", "end", step.alias("step"), (is_last & (F.col("end") != size - 1)).alias("short"))
    found = F.array_compact(F.array(F.when(F.col("end") < F.col("start"), "empty_range"), F.when(F.col("step") > 0, "gap_before"), F.when(F.col("step") < 0, "overlap_before"), F.when(F.col("short"), "wrong_end")))
    none = parts.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(0).cast("long").alias("start"), F.lit("no_parts").alias("error"))
    return marked.select("start", F.explode(found).alias("error")).unionAll(none)


def assemble(parts: DataFrame, path: str, size: int, md5: str | None = None) -> DataFrame:
    """Checks the parts (PART; a null md5 is not checked) and publishes them as one archive at a new ``path``: start, error of what is wrong, empty if it is published.

    Ranges must be contiguous, and every part must have its bytes and its MD5; parts are read side by side. The MD5 of the whole
    can't be worked out side by side: tasks take steps of it one after another, if ``md5`` is given.
    """
    spark = parts.sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    parts = parts.select(*[x.split()[0] for x in PART.split(", ")])
    wrong = range_errors(parts, size).collect()  # at most two for each part
    staged = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                digest, n, error = hashlib.md5(usedforsecurity=False), 0, None
                try:
                    files, at = _open(f"{staged}/part-{row['start']:020d}")
                    files.create_dir(at.rpartition("/")[0], recursive=True)
                    with files.open_output_stream(at) as sink:  # a task that runs again writes the same
                        for chunk in _stream(row["path"]):
                            digest.update(chunk)
                            sink.write(chunk)
                            n += len(chunk)
                except FileNotFoundError:
                    error = "missing_part"
                if error is None and n != row["end"] - row["start"] + 1:
                    error = "wrong_size"
                elif error is None and row["md5"] and digest.hexdigest() != row["md5"].lower():
                    error = "wrong_md5"
                yield pa.RecordBatch.from_arrays([pa.array([row["start"]], pa.int64()), pa.array([error], pa.string())], ["start", "error"])

    try:
        if not wrong:
            wrong = _spread(parts).mapInArrow(copy, "start long, error string").where("error is not null").collect()
        if not wrong and md5:
            sizes = parts.select("start", F.col("end") - F.col("start") + 1).orderBy("start").collect()
            if whole_md5(spark, [(f"{staged}/part-{start:020d}", n) for start, n in sizes]) != md5.lower():
                wrong = [(0, "wrong_archive_md5")]
        if not wrong and not fs.rename(_fs(spark, staged)[0], target):
            raise OSError(f"could not publish {path}")
    finally:
        fs.delete(_fs(spark, staged)[0], True)
    return spark.createDataFrame([tuple(x) for x in wrong], "start long, error string")


def archive_bytes(path: str) -> Iterator[bytes]:
    """The bytes of an assembled archive, in order."""
    from pyarrow import fs

    files, at = _open(path)
    for info in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
        if info.base_name.startswith("part-"):
            with files.open_input_file(info.path) as source:
                while chunk := source.read(CHUNK):
                    yield chunk
