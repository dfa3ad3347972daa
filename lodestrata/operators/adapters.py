"""Sources of the corpus as canonical records, and raw rows of labelled functions and patches as catalog rows.

An adapter never copies an answer, a fix or a write-up into the expected output: they only count towards risk and signals.
Rows from which nothing can be made (no code, no question, nothing but white space) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.hashing import sha
from lodestrata.operators.records import MAX_CODE, canonical

QUESTION_LIMIT, ANSWER_LIMIT = 1600, 2200
#: The signals of a raw row that a catalog has as columns.
SIGNALS = "dataset target cwe cve project repository commit_id patch_group_id function_id content_sha256 near_duplicate_sha256 paired_content_sha256 pair_changed pair_verified has_patch pair_type evidence_level label_confidence".split()


def _text(x: Column) -> Column:
    return T.stripped(F.coalesce(x.cast("string"), F.lit("")))


def _id(prefix: str, index: Column, content: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(index.cast("string"), 6, "0"), F.lit("-"), sha(content, 12))


def _signals(**values: Column | str) -> Column:
    pairs = [y for k, v in values.items() for y in (F.lit(k), F.lit(v) if isinstance(v, str) else v.cast("string"))]
    return F.create_map(*pairs)


def _hits(text: Column) -> Column:
    return F.array_join(T.named_hits(text, T.SUSPICIOUS), ",")


def patch_pair_records(rows: DataFrame, index: str, before: str, after: str, source: str) -> DataFrame:
    """record: the vulnerable side of a patch, with hashes of both; of the fixed side only that there is one."""
    old, new = _text(F.col(before)), _text(F.col(after))
    context = F.concat(F.lit("Vulnerable function excerpt. A fixed version is known: "), F.when(new != "", "True").otherwise("False"), F.lit(".\n\nVulnerable excerpt:\n"), T.truncated(old, MAX_CODE))
    signals = _signals(has_fixed_pair=new != "", suspicious_signal_names=_hits(old), vulnerable_excerpt_sha256=F.sha2(old, 256), fixed_excerpt_sha256=F.when(new != "", F.sha2(new, 256)))
    record = canonical(_id("patch", F.col(index), old), F.lit(source), F.lit("explain vulnerable code context"), context, signals, F.lit("high"), F.lit("train"))
    return rows.where(old != "").select(F.col(index), record.alias("record"))


def question_answer_records(rows: DataFrame, index: str, question: str, answer: str, source: str) -> DataFrame:
    """record: a question and a bounded excerpt of its answer as context."""
    q, a = _text(F.col(question)), _text(F.col(answer))
    both = F.concat(q, F.lit("\n\n"), a)
    context = F.concat(F.lit("Question:\n"), T.truncated(q, QUESTION_LIMIT, space=T.PYTHON_SPACE), F.lit("\n\nAnswer excerpt:\n"), T.truncated(a, ANSWER_LIMIT, space=T.PYTHON_SPACE))
    signals = _signals(dataset=source, question_sha256=F.sha2(q, 256), answer_sha256=F.sha2(a, 256), answer_redacted_from_target="true", suspicious_signal_names=_hits(both))
    record = canonical(_id("qa", F.col(index), F.concat(F.lit(source), q, a)), F.lit(source), F.lit("summarize as defensive guidance"), context, signals, T.risk_of(both), F.lit("train"))
    return rows.where((q != "") & (a != "")).select(F.col(index), record.alias("record"))


def writeup_records(files: DataFrame, index: str, path: str, content: str, source: str) -> DataFrame:
    """record: title, path and a redacted excerpt of a write-up; without a heading the file's name is the title."""
    text, at = F.col(content), F.col(path)
    stem = F.regexp_replace(F.substring_index(at, "/", -1), r"(?<=.)\.[^.]*$", "")
    title = F.col("_title")
    context = F.concat(F.lit("Title: "), title, F.lit("\nRelative path: "), at, F.lit("\n\nRedacted excerpt:\n"), T.writeup_excerpt(text))
    signals = _signals(title=title, relative_path=at, content_sha256=F.sha2(text, 256), suspicious_signal_names=_hits(text), full_writeup_redacted_from_target="true")
    record = canonical(_id("writeup", F.col(index), F.concat(at, text)), F.lit(source), F.lit("summarize write-up metadata"), context, signals, T.risk_of(text), F.lit("train"))
    titled = files.where(~T.is_blank(text)).withColumn("_title", T.once(T.markdown_title(text), lambda x: F.when(x == "", stem).otherwise(x)))
    return titled.select(F.col(index), record.alias("record"))


def source_file_records(files: DataFrame, index: str, path: str, content: str, source: str) -> DataFrame:
    """record: an excerpt of a source file with its static signals; any signal makes its risk medium, else it is low."""
    text, at = F.col(content), F.col(path)
    context = F.concat(F.lit("Relative path: "), at, F.lit("\n\nCode excerpt:\n"), T.truncated(text, MAX_CODE))
    signals = _signals(relative_path=at, suspicious_signal_names=_hits(text), line_count=F.size(T.lines_of(text)), code_excerpt_sha256=F.sha2(text, 256))
    risk = F.when(_hits(text) != "", "medium").otherwise("low")
    record = canonical(_id("source", F.col(index), F.concat(at, text)), F.lit(source), F.lit("summarize static signals"), context, signals, risk, F.lit("train"))
    return files.where(~T.is_blank(text)).select(F.col(index), record.alias("record"))


def _catalog(rows: DataFrame, index: str, record_id: Column, code: Column, **signals: Column | str) -> DataFrame:
    """index, record_id, code and all SIGNALS, empty where the source has none."""
    own = {"content_sha256": F.sha2(code, 256), "near_duplicate_sha256": F.sha2(T.near_normal(code), 256)} | signals
    columns = [own[k].cast("string") if isinstance(own.get(k), Column) else F.lit(own.get(k, "")) for k in SIGNALS]
    return rows.select(F.col(index), record_id.alias("record_id"), code.alias("code"), *[F.coalesce(c, F.lit("")).alias(k) for c, k in zip(columns, SIGNALS)])


def _group(project: Column, commit: Column, *more: Column) -> Column:
    return F.when(commit != "", F.concat_ws(":", project, commit, *more)).otherwise("")


def labelled_raw_rows(rows: DataFrame, index: str, dataset: str, code: str, target: str, cwe: str, project: str, commit: str) -> DataFrame:
    """Catalog rows of single labelled functions."""
    text, at, of = _text(F.col(code)), _text(F.col(commit)), _text(F.col(project))
    name = F.concat(F.lit(f"raw-{dataset}-"), F.lpad(F.col(index).cast("string"), 6, "0"), F.lit("-"), sha(text, 12))
    return _catalog(rows, index, name, text, dataset=dataset, target=F.col(target), cwe=_text(F.col(cwe)), project=of, repository=of, commit_id=at, patch_group_id=_group(of, at), function_id=F.sha2(text, 256), label_confidence=F.when(F.col(target) == 1, "dataset_positive").otherwise("benchmark_negative"))


def patch_raw_rows(rows: DataFrame, index: str, dataset: str, before: str, after: str, target: str, patch: str, cwe: str, project: str, commit: str, file: str, stripped: bool = False) -> DataFrame:
    """Catalog rows of patches: the state before, and that after if the pair is verified (a positive that a patch with a weakness changes).

    ``stripped``: both states are already as they are to be compared, and their ends stay as they are.
    """
    at, of, kinds = (_text(F.col(c)) for c in (commit, project, cwe))
    old, new = (F.coalesce(F.col(c), F.lit("")) if stripped else _text(F.col(c)) for c in (before, after))
    verified = (F.col(target) == 1) & (old != "") & (new != "") & (old != new) & (_text(F.col(patch)) != "") & (kinds != "")
    sides = F.array(F.struct(F.lit(False).alias("fixed"), old.alias("code"), new.alias("other")), F.struct(F.lit(True).alias("fixed"), new.alias("code"), old.alias("other")))
    held = rows.select("*", F.coalesce(verified, F.lit(False)).alias("_ok"), F.explode(sides).alias("_s")).where(~F.col("_s.fixed") | F.col("_ok"))
    fixed, text, ok, positive = F.col("_s.fixed"), F.col("_s.code"), F.col("_ok"), F.col(target) == 1
    name = F.concat(F.lit(f"raw-{dataset}-"), F.lpad(F.col(index).cast("string"), 6, "0"), F.when(fixed, "-fixed-").otherwise("-"), sha(text, 12))
    confidence = F.when(fixed, "verified_fixed_after").when(positive, "patch_localized_positive").otherwise("benchmark_negative")
    return _catalog(
        held, index, name, text, dataset=dataset, target=F.when(fixed, 0).otherwise(F.col(target)), cwe=kinds, project=of, repository=of, commit_id=at, patch_group_id=_group(of, at), function_id=F.concat(_text(F.col(file)), F.lit(":"), F.sha2(text, 256)),
        paired_content_sha256=F.when(F.col("_s.other") != "", F.sha2("_s.other", 256)), pair_changed=(old != "") & (new != "") & (old != new), pair_verified=ok, has_patch=_text(F.col(patch)) != "",
        pair_type=F.when(fixed, "fixed_after").when(ok, "vulnerable_before").otherwise("unpaired"), evidence_level=F.when(ok, "patch_localized").otherwise("dataset_label"), label_confidence=confidence,
    )


def paired_raw_rows(rows: DataFrame, pair: str, dataset: str, code: str, target: str, cwe: str, project: str, commit: str, cve: str) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of both sides of pairs (rows with one value of ``pair``), and pair, reason of those that are none.

    A pair has two rows with labels 1 and 0. If the provenance of its sides (project, commit, CVE) differs both stay, each
    on its own and unverified. Both sides meet in an aggregation by pair, so a pair need not be in one partition.
    """
    side = F.struct(F.col(target).alias("target"), *[_text(F.col(c)).alias(n) for c, n in ((code, "code"), (cwe, "cwe"), (project, "project"), (commit, "commit"), (cve, "cve"))])
    found = rows.groupBy(pair).agg(F.count("*").alias("n"), F.min(F.when(F.col(target) == 1, side)).alias("one"), F.min(F.when(F.col(target) == 0, side)).alias("zero"))
    whole = (F.col("n") == 2) & F.col("one").isNotNull() & F.col("zero").isNotNull()
    reason = F.when(F.col("n") != 2, "pair_must_contain_exactly_two_rows").otherwise("pair_must_contain_labels_1_and_0")
    same = (F.col("one.project") == F.col("zero.project")) & (F.col("one.commit") == F.col("zero.commit")) & (F.col("one.cve") == F.col("zero.cve"))
    both = F.array(F.struct(F.col("one").alias("own"), F.col("zero").alias("other")), F.struct(F.col("zero").alias("own"), F.col("one").alias("other")))
    held = found.where(whole).select(pair, same.alias("_same"), F.explode(both).alias("_s")).select(pair, "_same", "_s.own", F.col("_s.other.code").alias("_other"))
    text, label, ok, own = F.col("own.code"), F.col("own.target").cast("string"), F.col("_same"), F.col("own.target") == 1
    name = F.concat(F.lit(f"raw-{dataset}-"), F.lpad(F.col(pair).cast("string"), 6, "0"), F.lit("-"), label, F.lit("-"), sha(text, 12))
    number = F.col(pair).cast("string")
    group = F.concat_ws(":", "own.project", "own.commit", F.when(ok, F.concat(F.lit("pair-"), number)).otherwise(F.concat(F.lit("unverified-"), number, F.lit("-"), label)))
    out = _catalog(
        held, pair, name, text, dataset=dataset, target=F.col("own.target"), cwe=F.col("own.cwe"), cve=F.col("own.cve"), project=F.col("own.project"), repository=F.col("own.project"), commit_id=F.col("own.commit"), patch_group_id=group, function_id=F.sha2(text, 256),
        paired_content_sha256=F.when(ok, F.sha2("_other", 256)), pair_changed=ok & (text != F.col("_other")), pair_verified=ok, has_patch=ok, pair_type=F.when(~ok, "unpaired").when(own, "vulnerable_before").otherwise("fixed_after"),
        evidence_level=F.when(ok, "patch_localized").otherwise("dataset_label"), label_confidence=F.when(~ok, "pair_mismatch").when(own, "paired_positive").otherwise("paired_fixed_after"),
    )
    return out, found.where(~whole).select(pair, reason.alias("reason"))
