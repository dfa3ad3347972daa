"""Queries: every reader and writer, by what is read back of what was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from lodestrata.plans import cases as C
from lodestrata.plans.registry import query, table
from lodestrata.sources import readers as R
from lodestrata.sources import text as X


def _folder(spark) -> str:
    """A new folder in the shared one that the cluster names; a temporary one only where none is named, on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="formats-")
    path = f"{base.rstrip('/')}/formats-{uuid.uuid4().hex}"
    at, fs = X._fs(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _local(path: str) -> str:
    """The path for Python's own writers, which make SQLite, Arrow and ZIP files here; Spark can't."""
    return path.removeprefix("file://")


@query("SELECT doc_id, quality::INTEGER AS quality, toxic::INTEGER AS toxic FROM labels")
def jsonl_round_trip(spark, d):
    path = _folder(spark)
    X.write_jsonl(table(spark, d, "labels"), f"{path}/x")
    return X.read_jsonl(spark, f"{path}/x", "doc_id long, quality int, toxic int")


@query("SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE '[' || s_suppkey || ']' END AS other FROM supplier WHERE s_suppkey % 3 < 2")
def jsonl_quarantine(spark, d):
    """Objects, arrays and lines of white space (tabs, carriage returns, no-break spaces) in turn."""
    path, k = _folder(spark), F.col("s_suppkey").cast("string")
    line = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"k":'), k, F.lit("}\r"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("["), k, F.lit("]"))).otherwise(" \t\xa0\r")
    table(spark, d, "supplier").select(line.alias("value")).write.option("lineSep", "\n").text(f"{path}/x")
    good, other = X.quarantined_jsonl(spark, f"{path}/x", "k long")
    return good.select("k", F.lit(None).cast("string").alias("other")).unionAll(other.select(F.regexp_extract("value", "[0-9]+", 0).cast("long").alias("k"), F.col("value").alias("other")))


@query(f"WITH {C.SQL} SELECT doc_id::VARCHAR AS record_id, sha256(raw_output) AS raw_sha256, latency_ms FROM p")
def predictions_round_trip(spark, d):
    path = _folder(spark)
    rows = C.predictions(spark, d).select(F.col("doc_id").cast("string").alias("record_id"), "model_id", F.lit("r").alias("run_id"), "raw_output", "latency_ms")
    X.write_jsonl(rows, f"{path}/x")
    return X.read_predictions(spark, f"{path}/x").select("record_id", F.sha2("raw_output", 256).alias("raw_sha256"), "latency_ms")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_array_round_trip(spark, d):
    path = _folder(spark)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("value")).write.text(f"{path}/x.json")
    return X.read_json_or_jsonl(spark, f"{path}/x.json", "n_nationkey long, n_name string")


@query(f"SELECT doc_id, CASE WHEN {C.sql_draw(5, 'doc_id', 10)} < 8 THEN 'train' ELSE 'test' END AS split FROM documents")
def splits_round_trip(spark, d):
    path = _folder(spark)
    rows = table(spark, d, "documents").select("doc_id", F.when(C.draw(5, "doc_id", 10) < 8, "train").otherwise("test").alias("split"))
    X.write_splits(rows, f"{path}/x")
    lines = spark.read.text(f"{path}/x")  # the folders' names are the split
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "split")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, CASE WHEN r_regionkey < 3 THEN 'train' ELSE 'test' END AS split FROM region")
def split_named_files(spark, d):
    """The split is read from the files' names."""
    path, rows = _folder(spark), table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"))
    for split, keep in (("train", "r_regionkey < 3"), ("test", "r_regionkey >= 3")):
        X.write_parquet(rows.where(keep).coalesce(1), f"{path}/{split}")
        at, fs = X._fs(spark, f"{path}/{split}/part-*")
        fs.mkdirs(X._fs(spark, f"{path}/all")[0])
        fs.rename(fs.globStatus(at)[0].getPath(), X._fs(spark, f"{path}/all/{split}-00000.parquet")[0])
    return X.read_parquet_split(spark, f"{path}/all")


@query("SELECT page_id, md5(html) AS html_md5 FROM pages")
def csv_round_trip(spark, d):
    """Texts with quotes and line ends; carriage returns are left out, as CSV readers take them for line ends."""
    path = _folder(spark)
    table(spark, d, "pages").select("page_id", "url", "html").write.options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/x")
    return X.read_csv(spark, f"{path}/x", "page_id long, url string, html string", ["page_id", "html"]).select("page_id", F.md5("html").alias("html_md5"))


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def line_pairs_round_trip(spark, d):
    """Two adjoining lines make an entity: one has its key, the other its name."""
    path = _folder(spark)
    both = F.concat(F.lit('{"k":'), F.col("n_nationkey").cast("string"), F.lit('}\n\n{"name":"'), F.col("n_name"), F.lit('"}'))
    table(spark, d, "nation").select(both.alias("value")).coalesce(1).write.text(f"{path}/x")
    return X.read_line_pairs(spark, f"{path}/x", "k long, name string").select("first.k", "second.name")


@query("SELECT s_suppkey + 2 AS line_no, 'insert' AS statement FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS s_suppkey FROM supplier) UNION ALL SELECT 1, 'pragma' UNION ALL SELECT 2, 'create'")
def gzip_dump_lines(spark, d):
    from lodestrata.operators.audit import statement_class

    path = _folder(spark)
    head = spark.createDataFrame([(-2, "PRAGMA foreign_keys=OFF;"), (-1, "CREATE TABLE t (a);")], "k long, value string")
    rows = head.unionAll(table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.concat(F.lit("INSERT INTO t VALUES ("), F.col("s_suppkey").cast("string"), F.lit(");")).alias("value")))
    rows.coalesce(1).sortWithinPartitions("k").select("value").write.option("compression", "gzip").text(f"{path}/x")
    return X.read_dump(spark, f"{path}/x").select("line_no", statement_class(F.col("text")).alias("statement"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS text FROM nation WHERE n_nationkey % 2 = 0")
def whole_files(spark, d):
    """Files by pattern; those in hidden folders are left out."""
    path = _folder(spark)
    names = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    names.where("n_nationkey % 2 = 0").write.partitionBy("n_nationkey").text(f"{path}/x/shown")
    names.where("n_nationkey % 2 = 1").write.partitionBy("n_nationkey").text(f"{path}/x/.hidden")
    files = X.read_files(spark, f"{path}/x", "*.txt")
    return files.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long").alias("n_nationkey"), F.regexp_replace("text", "\n", "").alias("text"))


@query("SELECT (SELECT count(*) FROM nation) AS n_nations, (SELECT count(*) FROM region) AS n_regions, 0::BIGINT AS n_broken, 1::BIGINT AS n_broken_after")
def frozen_folder(spark, d):
    """Written at once, verified, and verified again after a file has gone."""
    path = _folder(spark)
    inventory = X.freeze({"nation": table(spark, d, "nation").coalesce(1), "region": table(spark, d, "region").coalesce(1)}, f"{path}/x")
    data = inventory.where(~F.col("file").startswith("_") & F.col("file").rlike(r"(^|/)part-"))
    counts = [spark.read.parquet(f"{path}/x/{t}").count() for t in ("nation", "region")]
    now = lambda: X.hash_inventory(spark, f"{path}/x").where(~F.col("file").startswith("_") & F.col("file").rlike(r"(^|/)part-"))
    broken = lambda: now().select("file", F.col("sha256").alias("now")).join(data, "file", "full_outer").where(~F.col("now").eqNullSafe(F.col("sha256"))).count()
    before = broken()
    at, fs = X._fs(spark, f"{path}/x/region/part-*")
    fs.delete(fs.globStatus(at)[0].getPath(), False)
    return spark.createDataFrame([(*counts, before, broken())], "n_nations long, n_regions long, n_broken long, n_broken_after long")


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name FROM supplier")
def sqlite_scan(spark, d):
    import sqlite3

    path = _local(_folder(spark))
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit("hidden").alias("other")).collect()  # a small table, for a file of another format
    connection = sqlite3.connect(f"{path}/x.db")
    connection.execute("CREATE TABLE s (s_suppkey INTEGER, s_name TEXT, other TEXT)")
    connection.executemany("INSERT INTO s VALUES (?, ?, ?)", map(tuple, rows))
    connection.commit()
    connection.close()
    return R.read_sqlite(spark, f"{path}/x.db", "s", "s_suppkey long, s_name string", 3)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def arrow_stream_scan(spark, d):
    import pyarrow as pa

    path = _local(_folder(spark))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").toArrow()
    with pa.ipc.new_stream(f"{path}/x.arrow", rows.schema) as sink:
        sink.write_table(rows, 10)
    return R.read_arrow(spark, f"{path}/x.arrow")


@query("SELECT 'r' || r_regionkey || '.txt' AS member, 1 AS line_no, r_name AS line FROM region UNION ALL SELECT 'r' || r_regionkey || '.txt', 3, 'end' FROM region")
def zip_member_lines(spark, d):
    """The regions as members of one archive, beside one that is no text; a task writes it."""
    path = _folder(spark)
    regions = table(spark, d, "region")
    texts = regions.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".txt")).alias("member"), F.concat("r_name", F.lit("\n\t\nend")).cast("binary").alias("content"))
    members = texts.unionAll(spark.createDataFrame([("image.png", b"\0")], "member string, content binary")).withColumn("archive", F.lit("x"))
    R.write_zips(members, f"{path}/zips").write.parquet(f"{path}/written")
    return R.zip_lines(spark, f"{path}/zips/x.zip", r"\.txt$")


_ZIPPED = """z AS (SELECT doc_id, 'z' || doc_id % 7 AS archive, CASE WHEN doc_id % 50 = 0 THEN '../' ELSE coalesce(lang, 'none') || '/' END || 'd' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.c' WHEN 2 THEN '.exe' WHEN 3 THEN '.zip' ELSE '' END AS member, text FROM documents WHERE text IS NOT NULL)"""


def _zipped(spark, d):
    """The documents in seven archives, some with names that are looked for."""
    k = F.col("doc_id")
    suffix = F.when(k % 5 == 0, ".TXT").when(k % 5 == 1, ".c").when(k % 5 == 2, ".exe").when(k % 5 == 3, ".zip").otherwise("")
    member = F.concat(F.when(k % 50 == 0, "../").otherwise(F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"))), F.lit("d"), k.cast("string"), suffix)
    rows = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("z"), (k % 7).cast("string")).alias("archive"), member.alias("member"), F.col("text").cast("binary").alias("content"))
    path = _folder(spark)
    R.write_zips(rows, f"{path}/zips").write.parquet(f"{path}/written")
    return R.zip_members(spark, f"{path}/zips", content=False)


@query(
    f"""WITH {_ZIPPED} SELECT count(*) AS n_members, count(*) FILTER (doc_id % 50 = 0) AS n_unsafe, 0::BIGINT AS n_encrypted, 0::BIGINT AS n_symlinks, count(*) FILTER (doc_id % 5 = 2) AS n_forbidden, count(*) FILTER (doc_id % 5 = 3) AS n_nested, sum(strlen(text))::BIGINT AS n_bytes FROM z"""
)
def zip_audit(spark, d):
    found = R.zip_inventory(_zipped(spark, d), [".exe"])
    return found.select("n_members", "n_unsafe", "n_encrypted", "n_symlinks", "n_forbidden", "n_nested", "n_bytes")


@query(f"WITH {_ZIPPED} SELECT CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.c' WHEN 2 THEN '.exe' WHEN 3 THEN '.zip' ELSE '' END AS suffix, count(*) AS n_members, sum(strlen(text))::BIGINT AS n_bytes FROM z GROUP BY 1")
def zip_suffix_histogram(spark, d):
    return R.zip_suffixes(_zipped(spark, d)).drop("n_compressed")


@query(f"WITH {_ZIPPED} SELECT archive, member, 'unsafe' AS finding FROM z WHERE doc_id % 50 = 0 UNION ALL SELECT archive, member, 'forbidden' FROM z WHERE doc_id % 5 = 2 UNION ALL SELECT archive, member, 'nested' FROM z WHERE doc_id % 5 = 3")
def zip_member_findings(spark, d):
    return R.zip_findings(_zipped(spark, d), [".exe"]).select(F.regexp_extract("archive", r"([^/]+)\.zip$", 1).alias("archive"), "member", "finding")


@query("SELECT page_id, md5(html) AS html_md5, CASE page_id % 2 WHEN 0 THEN 'train' ELSE 'test' END AS split FROM pages")
def csv_split_map(spark, d):
    """Files of even and of odd pages, told apart by a map of their names."""
    path = _folder(spark)
    pages = table(spark, d, "pages").select("page_id", "html")
    fs, splits = X._fs(spark, path)[1], {}
    fs.mkdirs(X._fs(spark, f"{path}/all")[0])
    for k, (name, split) in enumerate((("even", "train"), ("odd", "test"))):
        # many files, each of bounded size: a file with quoted line ends is read by one task
        pages.where(F.col("page_id") % 2 == k).write.options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxRecordsPerFile=10_000).csv(f"{path}/{name}")
        for n, found in enumerate(fs.globStatus(X._fs(spark, f"{path}/{name}/part-*")[0])):
            splits[f"{name}-{n:06d}.csv"] = split
            if not fs.rename(found.getPath(), X._fs(spark, f"{path}/all/{name}-{n:06d}.csv")[0]):
                raise OSError(f"could not rename {found.getPath()}")
    rows = X.read_csv_splits(spark, f"{path}/all", "page_id long, html string", ["page_id", "html"], splits)
    return rows.select("page_id", F.md5("html").alias("html_md5"), "split")


@query("SELECT 'a' AS name, count(*) AS n, sum(quality)::BIGINT AS good, NULL::VARCHAR AS note FROM labels")
def summary_round_trip(spark, d):
    path = _folder(spark)
    row = table(spark, d, "labels").agg(F.lit("a").alias("name"), F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"), F.lit(None).cast("string").alias("note"))
    X.write_summary(row, f"{path}/summary.json")
    return X.read_jsonl(spark, f"{path}/summary.json", "name string, n long, good long, note string")


@query(
    """WITH m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations), p AS (SELECT conv_id FROM m GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0)
SELECT name, name || '.jsonl' AS file_name, 'instruction' AS prompt, 'input' AS query, 'output' AS response, 'system' AS system, (SELECT count(*) FROM p WHERE (conv_id % 2 = 0) = (name = 'train')) AS n FROM (VALUES ('train'), ('validation')) t(name)"""
)
def export_description(spark, d):
    """Two training sets with their description, which says where to find each: the rows of what it names are counted."""
    from lodestrata.operators.records import instruction_rows

    path = f"{_folder(spark)}/export"
    rows = instruction_rows(table(spark, d, "conversations"))
    X.write_export({"train": rows.where("conv_id % 2 = 0"), "validation": rows.where("conv_id % 2 = 1")}, {"prompt": "instruction", "query": "input", "response": "output", "system": "system"}, path)
    entry = "struct<columns:struct<prompt:string,query:string,response:string,system:string>,file_name:string>"
    told = X.read_jsonl(spark, f"{path}/dataset_info.json", f"train {entry}, validation {entry}").first()
    out = [(name, told[name].file_name, *told[name].columns, X.read_jsonl(spark, f"{path}/{told[name].file_name}", "instruction string, output string").count()) for name in ("train", "validation")]
    return spark.createDataFrame(out, "name string, file_name string, prompt string, query string, response string, system string, n long")


_SEPARATORS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\r\n"]


@query(
    """WITH t AS (SELECT doc_id, text || """
    + "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN " + " || ".join(f"chr({ord(c)})" for c in x) for k, x in enumerate(_SEPARATORS)) + r""" END || 'end' AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), 1) AS i FROM t)
SELECT row_number() OVER (ORDER BY doc_id, i) AS line_no, sha256(line) AS line_sha256 FROM l""".replace("\\\\", "\\")
)
def numbered_line_ends(spark, d):
    """Whole texts in files that follow each other, which are read in many parts; each text has another line end that Python knows."""
    path = _folder(spark)
    ends = F.element_at(F.array(*map(F.lit, _SEPARATORS)), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat("text", ends, F.lit("end")).alias("value"))
    rows.orderBy("doc_id").select("value").write.option("lineSep", "\n").text(f"{path}/x")  # parts in order, by their names too
    return X.numbered_across(X.numbered_lines(spark, f"{path}/x")).select("line_no", F.sha2("value", 256).alias("line_sha256"))


@query(
    """WITH n AS (SELECT sum(strlen(text) + 1)::BIGINT AS size FROM documents WHERE text IS NOT NULL), w AS (SELECT size, ceil(size / 100000.0)::BIGINT AS parts FROM n)
SELECT 'whole' AS archive, size, parts, '' AS errors FROM w UNION ALL SELECT 'gap', size, parts - 1, '100000:gap_before' FROM w UNION ALL SELECT 'overlap', size, parts + 1, '50000:overlap_before,100000:overlap_before' FROM w
UNION ALL SELECT 'wrong_hash', size, parts, '100000:wrong_md5' FROM w UNION ALL SELECT 'wrong_archive_hash', size, parts, '0:wrong_archive_md5' FROM w UNION ALL SELECT 'missing', size, parts, '0:missing_part' FROM w UNION ALL SELECT 'short', size + 1, parts, (parts - 1) * 100000 || ':wrong_end' FROM w"""
)
def archive_ranges(spark, d):
    """The whole table as files that follow each other, cut into ranges and assembled: once whole, and with each fault."""
    from lodestrata.sources import ranges as G

    path = _folder(spark)
    table(spark, d, "documents").where("text is not null").select(F.col("text").alias("value")).write.option("lineSep", "\n").text(f"{path}/x")
    at, fs = X._fs(spark, f"{path}/x/part-*")
    files = [(x.getPath().toString(), x.getLen()) for x in fs.globStatus(at)]  # in order of their names
    size = sum(n for _, n in files)
    G.cut(spark, files, size, 100_000, f"{path}/ranges").write.parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    digest = G.whole_md5(spark, files)
    second = F.col("start") == 100_000
    more = parts.where(second).withColumn("start", F.lit(50_000).cast("long"))
    cases = {
        "whole": (parts, size, digest),
        "gap": (parts.where("start != 0"), size, None),
        "overlap": (parts.unionAll(more.withColumn("end", F.lit(149_999).cast("long"))), size, None),
        "wrong_hash": (parts.withColumn("md5", F.when(second, "0").otherwise(F.col("md5"))), size, None),
        "wrong_archive_hash": (parts, size, "0" * 32),
        "missing": (parts.withColumn("path", F.when(F.col("start") == 0, F.concat("path", F.lit("-none"))).otherwise(F.col("path"))), size, None),
        "short": (parts, size + 1, None),
    }
    rows = []
    for name, (given, n, md5) in cases.items():
        wrong = sorted(tuple(r) for r in G.assemble(given, f"{path}/archive-{name}", n, md5).collect())
        rows.append((name, n, given.count(), ",".join(f"{a}:{b}" for a, b in wrong)))
    return spark.createDataFrame(rows, "archive string, size long, parts long, errors string")
