"""Python data sources for formats that Spark has no reader for: SQLite tables and Arrow IPC streams; ZIP members."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions.text import UNICODE_INK


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.parts = int(options.get("numpartitions", "1"))

    def _open(self):
        import sqlite3

        connection = sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)
        connection.execute("PRAGMA query_only = ON")
        allowed = {sqlite3.SQLITE_SELECT, sqlite3.SQLITE_READ, sqlite3.SQLITE_FUNCTION}
        connection.set_authorizer(lambda action, *_: sqlite3.SQLITE_OK if action in allowed else sqlite3.SQLITE_DENY)
        return connection

    def partitions(self):
        connection = self._open()
        low, high = connection.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        connection.close()
        if low is None or self.parts == 1:
            return [_Range(None, None)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(x, x + step) for x in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        connection = self._open()
        columns = ", ".join(f'"{c}"' for c in self.schema.fieldNames())
        where = "" if partition.low is None else f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
        yield from connection.execute(f'SELECT {columns} FROM "{self.table}"{where}')
        connection.close()


class SqliteSource(DataSource):
    """Read-only scan of a table's columns: options path, table, numPartitions (by row id). Give the schema: it is the allow-list."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema):
        return SqliteReader(self.options, schema)


class ArrowReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(self.path) as source:
            yield from pa.ipc.open_stream(source)


class ArrowSource(DataSource):
    """Arrow IPC stream, batch by batch: option path."""

    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.memory_map(self.options["path"]) as source:
            return from_arrow_schema(pa.ipc.open_stream(source).schema)

    def reader(self, schema):
        return ArrowReader(self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).options(path=path, table=table, numPartitions=partitions).load()


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrow_stream").option("path", path).load()


#: Bytes of members that are handed on at once.
MEMBER_BYTES = 16_000_000
ZIP_MEMBER = "archive string, member string, n_bytes long, n_compressed long, encrypted boolean, symlink boolean, content binary"


def _members(pattern: str | None, content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import zipfile

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in ZIP_MEMBER.split(", ")]
        rows: list[list] = []
        held = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, at = _opened(path)
                with files.open_input_file(at) as source, zipfile.ZipFile(source) as z:
                    for x in sorted(z.infolist(), key=lambda x: x.filename):
                        if x.is_dir() or pattern and not re.search(pattern, x.filename):
                            continue
                        body = z.read(x) if content and not x.flag_bits & 1 else None
                        rows.append([path, x.filename, x.file_size, x.compress_size, bool(x.flag_bits & 1), (x.external_attr >> 28) == 0xA, body])
                        held += len(body or b"")
                        if len(rows) == 1000 or held > MEMBER_BYTES:
                            yield emit()
                            rows, held = [], 0
        if rows:
            yield emit()

    return run


def _opened(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    if not path.startswith("file:") and ":/" in path:
        return fs.FileSystem.from_uri(path)
    at = path.removeprefix("file:")  # Spark writes file:/x or file:///x
    return fs.LocalFileSystem(), "/" + at.lstrip("/") if at.startswith("//") else at


def zip_members(spark: SparkSession, path: str, pattern: str | None = None, content: bool = True) -> DataFrame:
    """Members of ZIP archives in order of name, one row each; archives are never unpacked to disk.

    A task seeks in an archive: it holds its directory and one member, never the archive, and reads just the directory without ``content``.
    """
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(_members(pattern, content), ZIP_MEMBER)


def zip_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """member, line_no, line of text members."""
    text = zip_members(spark, path, pattern).select("member", F.decode("content", "UTF-8").alias("text"))
    lines = text.select("member", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(UNICODE_INK)).select("member", (F.col("line_no") + 1).alias("line_no"), "line")


def write_zips(members: DataFrame, folder: str) -> DataFrame:
    """Writes ``members`` (archive, member, content) as one ZIP file for each archive below ``folder``, each by a task: archive, path, n_members.

    Members come to the task in order and go to the file one by one, so it holds a few of them and the directory.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile
        from contextlib import ExitStack

        name, path, n, held = None, None, 0, ExitStack()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([path], pa.string()), pa.array([n], pa.int64())], ["archive", "path", "n_members"])

        with ExitStack() as all_held:
            for batch in batches:
                for k in range(batch.num_rows):
                    own = batch.column("archive")[k].as_py()
                    if n == 0 or own != name:
                        if n:
                            held.close()
                            yield told()
                        name, path, n = own, f"{folder}/{own}.zip", 0
                        files, at = _opened(path)
                        files.create_dir(at.rpartition("/")[0], recursive=True)
                        held = all_held.enter_context(ExitStack())
                        z = held.enter_context(zipfile.ZipFile(held.enter_context(files.open_output_stream(at)), "w", zipfile.ZIP_DEFLATED))
                    z.writestr(zipfile.ZipInfo(batch.column("member")[k].as_py()), batch.column("content")[k].as_py())
                    n += 1
            if n:
                held.close()
                yield told()

    rows = members.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member", "content")
    return rows.mapInArrow(write, "archive string, path string, n_members long")


def _suffix() -> Column:
    return F.lower(F.regexp_extract("member", r"(\.[A-Za-z0-9]+)$", 1))


def zip_suffixes(members: DataFrame) -> DataFrame:
    """suffix (in lower case, empty without one), n_members, n_bytes, n_compressed."""
    return members.groupBy(_suffix().alias("suffix")).agg(F.count("*").alias("n_members"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_compressed").alias("n_compressed"))


def zip_findings(members: DataFrame, forbidden: list[str]) -> DataFrame:
    """archive, member, finding: each member that is unsafe, encrypted, a symlink, forbidden by suffix, or an archive itself."""
    tests = {"unsafe": F.col("member").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\\"), "encrypted": F.col("encrypted"), "symlink": F.col("symlink"), "forbidden": _suffix().isin(forbidden), "nested": _suffix().isin(".zip", ".gz", ".tar", ".7z")}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]))
    return members.select("archive", "member", F.explode(found).alias("finding"))


def zip_inventory(members: DataFrame, forbidden: list[str]) -> DataFrame:
    """One row: members, sizes, ratio, and numbers of unsafe, encrypted, symlink, forbidden and nested members."""
    suffix = F.lower(F.regexp_extract("member", r"(\.[A-Za-z0-9]+)$", 1))
    unsafe = F.col("member").rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\\")
    return members.agg(
        F.count("*").alias("n_members"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_compressed").alias("n_compressed"),
        F.round(F.try_divide(F.sum("n_bytes").cast("double"), F.sum("n_compressed").cast("double")), 4).alias("ratio"),
        F.count_if(unsafe).alias("n_unsafe"), F.count_if("encrypted").alias("n_encrypted"), F.count_if("symlink").alias("n_symlinks"),
        F.count_if(suffix.isin(forbidden)).alias("n_forbidden"), F.count_if(suffix.isin(".zip", ".gz", ".tar", ".7z")).alias("n_nested"),
    )
