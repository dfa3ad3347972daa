"""JSON Schemas as Column expressions: every error of a value, with its path, rule and detail.

A schema is compiled to expressions over VARIANT once, when a plan is built. Known are ``type``, ``enum``, ``const``,
``minLength``, ``maxLength``, ``pattern``, ``minimum``, ``maximum``, ``required``, ``properties``, ``additionalProperties``
(false), ``items``, ``minItems``, ``maxItems``, ``uniqueItems``, and ``allOf`` of schemas or of ``if``, ``then``, ``else``. As in the
standard, a rule concerns values of its own type only, and all rules are judged: one value can have several errors.
A path is keys and places from 0 on, joined by dots; that of the whole value is ``<root>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.structures import is_json_object, once

ERRORS = "array<struct<path:string,rule:string,detail:string>>"
_KINDS = {"string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "array": ["ARRAY"], "object": ["OBJECT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}
_KNOWN = {"type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "allOf", "if", "then", "else"}
ROOT = "<root>"
_NOTES = {"$schema", "$id", "title", "description"}


def _none() -> Column:
    return F.array().cast(ERRORS)


def _column(path: Column | str) -> Column:
    return F.lit(path) if isinstance(path, str) else path


def _error(failed: Column, path: Column | str, rule: str, detail: Column | None = None) -> Column:
    entry = F.struct(_column(path).alias("path"), F.lit(rule).alias("rule"), (F.lit("") if detail is None else detail).alias("detail"))
    return F.when(F.coalesce(failed, F.lit(False)), F.array(entry)).otherwise(_none())


def _part(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _is(kind: Column, value: Column, name: str) -> Column:
    if name == "integer":  # 2.0 is one
        return kind.isin(*_KINDS["number"]) & (F.coalesce(_part(value, "double") % 1, F.lit(1.0)) == 0)
    return kind.isin(*_KINDS[name])


def _equals(kind: Column, value: Column, wanted: object) -> Column:
    if isinstance(wanted, str):
        return (kind == "STRING") & (_part(value, "string") == wanted)
    if isinstance(wanted, bool) or wanted is None:
        return kind.isin("BOOLEAN", "VOID") & (F.to_json(value) == {True: "true", False: "false", None: "null"}[wanted])
    return kind.isin(*_KINDS["number"]) & (_part(value, "double") == float(wanted))


def _below(path: Column | str, part: Column | str) -> Column | str:
    """A path is a text until a place in an array is part of it."""
    if isinstance(path, str) and path == ROOT:
        return part
    if isinstance(path, str) and isinstance(part, str):
        return f"{path}.{part}"
    return F.concat(_column(path), F.lit("."), _column(part))


def _errors(schema: dict, value: Column, path: Column | str) -> Column:
    """Errors of a variant; null (an absent member) has none."""
    if unknown := schema.keys() - _KNOWN - _NOTES:
        raise ValueError(f"schema rules that are not known: {', '.join(sorted(unknown))}")
    shape = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return once(value, lambda v: F.when(v.isNull(), _none()).otherwise(once(shape(v), lambda kind: _rules(schema, v, kind, path))))


def _rules(schema: dict, value: Column, kind: Column, path: Column | str) -> Column:
    found: list[Column] = []
    add = lambda failed, rule, detail=None: found.append(_error(failed, path, rule, detail))
    every = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        add(~every([_is(kind, value, x) for x in names]), "type")
    if "enum" in schema:
        add(~every([_equals(kind, value, x) for x in schema["enum"]]), "enum")
    if "const" in schema:
        add(~_equals(kind, value, schema["const"]), "const")

    text, number = _part(value, "string"), _part(value, "double")
    is_text, is_number, is_object = kind == "STRING", kind.isin(*_KINDS["number"]), kind == "OBJECT"
    if "minLength" in schema:
        add(is_text & (F.length(text) < schema["minLength"]), "minLength")
    if "maxLength" in schema:
        add(is_text & (F.length(text) > schema["maxLength"]), "maxLength")
    if "pattern" in schema:
        add(is_text & ~text.rlike(f"(?dU){schema['pattern']}"), "pattern")
    if "minimum" in schema:
        add(is_number & (number < schema["minimum"]), "minimum")
    if "maximum" in schema:
        add(is_number & (number > schema["maximum"]), "maximum")

    if {"items", "minItems", "maxItems", "uniqueItems"} & schema.keys():
        found.append(F.when(kind == "ARRAY", once(_part(value, "array<variant>"), lambda x: _item_rules(schema, x, path))).otherwise(_none()))
    for key in schema.get("required", []):
        add(is_object & F.try_variant_get(value, f"$['{key}']", "variant").isNull(), "required", F.lit(key))
    if schema.get("additionalProperties") is False:
        own = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        extra = F.array_sort(F.array_except(F.map_keys(_part(value, "map<string,variant>")), own))
        found.append(F.when(is_object, once(extra, lambda x: _error(F.size(x) > 0, path, "additionalProperties", F.array_join(x, ",")))).otherwise(_none()))
    for key, rules in schema.get("properties", {}).items():
        member = F.when(is_object, F.try_variant_get(value, f"$['{key}']", "variant"))
        found.append(_errors(rules, member, _below(path, key)))

    for rules in [*schema.get("allOf", []), *([{k: schema[k] for k in ("if", "then", "else") if k in schema}] if "if" in schema else [])]:
        if "if" in rules:
            holds = F.size(_errors(rules["if"], value, path)) == 0
            found.append(F.when(holds, _errors(rules.get("then", {}), value, path)).otherwise(_errors(rules.get("else", {}), value, path)))
            rules = {k: v for k, v in rules.items() if k not in ("if", "then", "else")}
        if rules:
            found.append(_errors(rules, value, path))
    return F.concat(*found) if found else _none()


def _item_rules(schema: dict, items: Column, path: Column | str) -> Column:
    found = []
    if "minItems" in schema:
        found.append(_error(F.size(items) < schema["minItems"], path, "minItems"))
    if "maxItems" in schema:
        found.append(_error(F.size(items) > schema["maxItems"], path, "maxItems"))
    if schema.get("uniqueItems"):
        found.append(_error(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items), path, "uniqueItems"))
    if schema.get("items"):
        found.append(F.flatten(F.transform(items, lambda x, k: _errors(schema["items"], x, _below(path, k.cast("string"))))))
    return F.concat(*found) if found else _none()


def errors_of(text: Column, schema: dict) -> Column:
    """Sorted errors (path, rule, detail) of a JSON object; one of rule ``parse`` if the text is none, null included."""
    found = lambda value: F.array_sort(F.array_distinct(_errors(schema, value, ROOT)))
    parsed = lambda t, value: F.when(is_json_object(t, value), found(value)).otherwise(_error(F.lit(True), ROOT, "parse"))
    return once(text, lambda t: once(F.try_parse_json(t), lambda value: parsed(t, value)))


def conforms(text: Column, schema: dict) -> Column:
    return F.size(errors_of(text, schema)) == 0


def strings_of(text: Column) -> Column:
    """All strings that are values, at any depth of a JSON text, in its order; keys are none."""
    # keys are matched too, so that no match begins inside one; they end with their colon
    quoted = F.filter(F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?'), F.lit(0)), lambda x: x.endswith('"'))
    return F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
