"""Readers and writers of line formats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.structures import is_json_object
from lodestrata.functions.text import UNICODE_INK


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).where(F.col("value").rlike(UNICODE_INK))


#: What ends a line for Python beside line feeds and carriage returns.
_OTHER_ENDS = "[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def numbered_lines(spark: SparkSession, path: str, python_ends: bool = True, only: Column | None = None) -> DataFrame:
    """file, line_no (from 1 in each file), value of all lines, or of those that ``only`` holds for, numbered among themselves.

    A large file is read in parts, by many tasks; rows come in any order.

    Lines end as ``splitlines`` of Python has it, or else at ``\\n`` only. A separator other than ``\\n`` or ``\\r`` at a file's
    very end opens an empty line. Lines are numbered inside each part of a file, and the parts' counts are summed: no line is shuffled for it.
    """
    source = spark.read.text(path) if python_ends else spark.read.option("lineSep", "\n").text(path)
    rows = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value")
    if python_ends:
        rows = rows.select("file", "part", F.explode(F.split("value", _OTHER_ENDS)).alias("value"))
    rows = (rows if only is None else rows.where(only)).withColumn("at", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # one row for each part of a file
    parts = parts.select(F.col("file").alias("f"), F.col("part").alias("p"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(parts, (F.col("file") == F.col("f")) & (F.col("part") == F.col("p"))).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def numbered_across(lines: DataFrame) -> DataFrame:
    """Lines as :func:`numbered_lines` has them, numbered on from file to file in the order of their paths."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file").agg(F.count("*").alias("n"))  # one row for each file
    offsets = counts.select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(F.broadcast(offsets), F.col("file") == F.col("f")).select("file", (F.col("line_no") + F.col("before")).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, python_ends: bool = False) -> DataFrame:
    """Strict JSON lines: lines of white space alone are skipped; a line that is no object fails the read and is named.

    Only ``\\n`` ends a line, so other line separators may stand inside strings; with ``python_ends`` all that end a line for
    Python do, and the error has the line's number.
    """
    lines, said = _lines(spark, path), F.lit("not a JSON object: ")
    if python_ends:
        lines = numbered_lines(spark, path).where(F.col("value").rlike(UNICODE_INK))
        said = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" is no JSON object: "))
    checked = F.when(is_json_object(F.col("value")), F.col("value")).otherwise(F.raise_error(F.concat(said, F.substring("value", 1, 200))))
    return lines.select(F.from_json(checked, schema).alias("r")).select("r.*")


def numbered_jsonl_errors(spark: SparkSession, path: str, python_ends: bool = True) -> DataFrame:
    """file, line_no, value of the lines that are no JSON objects."""
    return numbered_lines(spark, path, python_ends).where(F.col("value").rlike(UNICODE_INK) & ~is_json_object(F.col("value")))


def quarantined_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records of the lines that are objects, and the other lines."""
    lines = _lines(spark, path)
    good = lines.where(is_json_object(F.col("value"))).select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, lines.where(~is_json_object(F.col("value")))


def read_json_or_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array (``.json``) or JSON lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path) if path.endswith(".json") else read_jsonl(spark, path, schema)


PREDICTION = "record_id string, model_id string, run_id string, raw_output string, latency_ms double, generated_at string, metadata string"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions; a required field that is missing or empty fails the read."""
    rows = read_jsonl(spark, path, PREDICTION)
    for name in ("record_id", "model_id", "run_id", "raw_output"):
        rows = rows.withColumn(name, F.when(F.length(name) > 0, F.col(name)).otherwise(F.raise_error(F.lit(f"prediction without {name}"))))
    return rows


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines with keys in alphabetical order; one file if asked for."""
    lines = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    (lines.coalesce(1) if single else lines).write.option("lineSep", "\n").text(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """CSV with quoted line ends, of which only the named columns are kept."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False).csv(path).select(*columns)


def read_csv_splits(spark: SparkSession, path: str, schema: str, columns: list[str], splits: dict[str, str]) -> DataFrame:
    """As :func:`read_csv`, with ``split`` from a map of file names; a file that the map does not name fails the read."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    known = F.create_map(*[F.lit(x) for pair in splits.items() for x in pair])
    told = F.coalesce(F.try_element_at(known, name), F.raise_error(F.concat(F.lit("no split for file "), name)).cast("string"))
    rows = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False).csv(path)
    return rows.select(*columns, told.alias("split"))


def write_single(text: DataFrame, path: str) -> None:
    """One row's only column as one text file at ``path``, published by a rename."""
    spark = text.sparkSession
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    text.coalesce(1).write.option("lineSep", "\n").text(staged)
    at, fs = _fs(spark, f"{staged}/part-*")
    target = _fs(spark, path)[0]
    fs.mkdirs(target.getParent())
    if not fs.rename(fs.globStatus(at)[0].getPath(), target):
        raise OSError(f"could not publish {path}")
    fs.delete(_fs(spark, staged)[0], True)


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row frame as a JSON file with sorted keys, nulls included."""
    write_single(row.select(F.to_json(F.struct(*sorted(row.columns)), {"ignoreNullFields": "false"}).alias("value")), path)


def write_export(sets: dict[str, DataFrame], columns: dict[str, str], path: str) -> None:
    """Each training set as JSON lines in ``<name>.jsonl`` below ``path``, and ``dataset_info.json``, which names each set's file and what its columns are for.

    ``columns``: for each part of a prompt the column that holds it.
    """
    spark = next(iter(sets.values())).sparkSession
    for name, rows in sets.items():
        write_jsonl(rows.select(*columns.values()), f"{path}/{name}.jsonl")
    entry = lambda name: F.struct(F.struct(*[F.lit(v).alias(k) for k, v in sorted(columns.items())]).alias("columns"), F.lit(f"{name}.jsonl").alias("file_name")).alias(name)
    write_summary(spark.range(1).select(*[entry(name) for name in sets]), f"{path}/dataset_info.json")


def read_line_pairs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each two adjoining lines of a file are one entity: file, pair, first, second. A file with an odd tail fails the read."""
    rows = numbered_lines(spark, path, only=F.col("value").rlike(UNICODE_INK)).withColumn("at", F.col("line_no") - 1)
    paired = rows.groupBy("file", F.floor(F.col("at") / 2).alias("pair")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("lines"))
    both = F.when(F.size("lines") == 2, F.col("lines")).otherwise(F.raise_error(F.concat(F.lit("unpaired line in pair "), F.col("pair").cast("string"))))
    return paired.select("file", "pair", both.alias("lines")).select("file", "pair", F.from_json(F.col("lines")[0]["value"], schema).alias("first"), F.from_json(F.col("lines")[1]["value"], schema).alias("second"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """line_no, text of a text dump, gzipped or not."""
    return numbered_lines(spark, path, python_ends=False).select("line_no", F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, text of whole files by name pattern, hidden folders left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(~F.col("path").rlike(r"/\.[^/]+/"))


def read_parquet_split(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with ``split`` from the file's name before its first hyphen."""
    rows = spark.read.parquet(path)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), "^([^-]+)-", 1).alias("split"))


def write_parquet(df: DataFrame, path: str) -> None:
    """zstd Parquet; refuses an empty table."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.write.option("compression", "zstd").parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each split."""
    lines = df.select(split, F.to_json(F.struct(*sorted(c for c in df.columns if c != split)), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.partitionBy(split).option("lineSep", "\n").text(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def hash_inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256, n_bytes of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", path.rstrip("/").rpartition("/")[2] + "/", -1)
    return files.select(name.alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def broken_files(spark: SparkSession, path: str, inventory: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed against an inventory; empty if all hold."""
    now = hash_inventory(spark, path).select("file", F.col("sha256").alias("now"))
    return now.join(inventory.select("file", "sha256"), "file", "full_outer").where(~F.col("now").eqNullSafe(F.col("sha256")))


def freeze(frames: dict[str, DataFrame], path: str) -> DataFrame:
    """Write all frames below a new ``path`` at once: into a temporary folder, then renamed. Refuses to overwrite.

    Returns the inventory of the files, which is kept beside them in ``_inventory``.
    """
    spark = next(iter(frames.values())).sparkSession
    target, fs = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    try:
        for name, df in frames.items():
            write_parquet(df, f"{staged}/{name}")
        hash_inventory(spark, staged).write.parquet(f"{staged}/_inventory")
        if not fs.rename(_fs(spark, staged)[0], target):
            raise OSError(f"could not publish {path}")
    except BaseException:
        fs.delete(_fs(spark, staged)[0], True)
        raise
    return spark.read.parquet(f"{path.rstrip('/')}/_inventory")
