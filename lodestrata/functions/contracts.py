"""The JSON contracts of records and model outputs, as schemas for :mod:`lodestrata.functions.json_schema`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.json_schema import ERRORS, errors_of, strings_of
from lodestrata.functions.structures import once

# Names and words that conforming texts use.
RISK_LEVELS = ["low", "medium", "high", "critical", "unknown"]
CONFIDENCE_LEVELS = ["low", "medium", "high"]
SPLITS = ["train", "validation", "test", "fixture"]
SAFETY_LEVELS = ["metadata_only", "synthetic", "redacted", "restricted"]
ASSESSMENTS = ["present", "not_observed", "uncertain"]


def text(least: int = 1, most: int | None = None, pattern: str | None = None) -> dict:
    rules = {"type": "string", "minLength": least or None, "maxLength": most, "pattern": pattern}
    return {k: v for k, v in rules.items() if v is not None}


def one_of(names: list[str]) -> dict:
    return {"type": "string", "enum": names}


def list_of(items: dict, **rules) -> dict:
    return {"type": "array", "items": items, **rules}


def closed(optional: tuple[str, ...] = (), **members: dict) -> dict:
    """An object with just these members, all of them required but the optional ones."""
    return {"type": "object", "additionalProperties": False, "required": [k for k in members if k not in optional], "properties": members}


def when(member: str, values: list[str], then: dict) -> dict:
    """What holds if a member has one of some values."""
    return {"if": {"properties": {member: {"enum": values}}, "required": [member]}, "then": {"properties": then}}


OUTPUT = closed(
    summary=text(),
    behavior_explanation=text(),
    risk_level=one_of(RISK_LEVELS),
    malware_like_behaviors=list_of(closed(behavior=text(), evidence=text(), confidence=one_of(CONFIDENCE_LEVELS))),
    attack_mapping=list_of(closed(tactic=text(), technique_id=text(), technique_name=text(), evidence=text())),
    recommendations=list_of(text()),
    limitations=list_of(text()),
)


def record(source_types: list[str]) -> dict:
    """A canonical record whose source has one of these types."""
    maybe = {"type": ["string", "null"]}
    return closed(
        id=text(),
        source=closed(type=one_of(source_types), name=text(), url=maybe, license_or_terms=maybe, retrieved_at={**maybe, "pattern": r"^\d{4}-\d{2}-\d{2}$"}),
        input=closed(task=text(), context=text(), signals={"type": "object"}),
        expected_output=OUTPUT,
        metadata=closed(split=one_of(SPLITS), safety_level=one_of(SAFETY_LEVELS), contains_executable_payload={"type": "boolean"}, notes=list_of(text(0))),
    )


def evidence_spans(version: str) -> dict:
    """An assessment with at most 8 different spans: one at least if it is certain, none if not."""
    out = closed(schema_version={"const": version}, assessment=one_of(ASSESSMENTS), evidence_spans=list_of(text(1, 1000), maxItems=8, uniqueItems=True), confidence=one_of(CONFIDENCE_LEVELS))
    return {**out, "allOf": [when("assessment", ASSESSMENTS[:2], {"evidence_spans": {"minItems": 1}}), when("assessment", ASSESSMENTS[2:], {"evidence_spans": {"maxItems": 0}})]}


def evidence_lines(version: str) -> dict:
    """One to eight different line ranges."""
    line = {"type": "integer", "minimum": 1}
    return closed(schema_version={"const": version}, evidence_ranges=list_of(closed(start_line=line, end_line=line), minItems=1, maxItems=8, uniqueItems=True), confidence=one_of(CONFIDENCE_LEVELS))


def assessed() -> dict:
    """The short form that gates judge: an assessment, its basis, and numbers of lines; it may have more members."""
    out = closed(assessment=one_of(ASSESSMENTS), basis=text(1, pattern=r"\S"), evidence=list_of({"type": "integer"}))
    return {**out, "additionalProperties": True}


def _unsafe(found: Column) -> Column:
    """One error for each pattern of unsafe guidance in a text's strings."""
    text = F.array_join(F.coalesce(found, F.array().cast("array<string>")), "\n")
    one = lambda whole, p: F.when(whole.rlike(f"(?i){p}"), F.struct(F.lit("<root>").alias("path"), F.lit("unsafe").alias("rule"), F.lit(p).alias("detail")))
    every = lambda whole: F.array_compact(F.array(*[one(whole, p) for p in T.UNSAFE_GUIDANCE]))
    # few texts have any; all patterns begin at a word's edge, which is looked for once
    some = r"(?i)\b(?:" + "|".join(p.removeprefix(r"\b") for p in T.UNSAFE_GUIDANCE) + ")"
    return once(text, lambda whole: F.when(whole.rlike(some), every(whole)).otherwise(F.array().cast(ERRORS)))


def output_errors(raw: Column, schema: dict = OUTPUT) -> Column:
    """Errors of a model output: its contract, and unsafe guidance in any of its strings."""
    return once(raw, lambda text: F.concat(errors_of(text, schema), _unsafe(strings_of(text))))


def record_errors(raw: Column, schema: dict) -> Column:
    """Errors of a canonical record: its contract, no payload, and no unsafe guidance in the expected output."""
    entry = F.struct(F.lit("metadata.contains_executable_payload").alias("path"), F.lit("payload").alias("rule"), F.lit("").alias("detail"))
    held = lambda payload: F.when(F.coalesce(~payload.isin("false", "0", "", "[]", "{}"), F.lit(False)), F.array(entry)).otherwise(F.array().cast(ERRORS))
    of = lambda text, path: F.get_json_object(text, path)
    return once(raw, lambda text: F.concat(errors_of(text, schema), held(of(text, "$.metadata.contains_executable_payload")), _unsafe(once(of(text, "$.expected_output"), strings_of))))
