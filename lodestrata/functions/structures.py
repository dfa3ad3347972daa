"""JSON, line ranges, arrays of roles: rules inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import UNICODE_INK, once

REQUIRED_OUTPUT = ["summary", "behavior_explanation", "risk_level", "malware_like_behaviors", "attack_mapping", "recommendations", "limitations"]


def is_json_object(text: Column, parsed: Column | None = None) -> Column:
    """Whether ``text`` is strictly one JSON object. ``parsed``: its variant, if that is at hand.

    The parsers stop after the first value and ignore what follows, so the text must also parse as the one
    element of an array and as a member of an object: no trailing text can close both.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    member = F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text) if parsed is None else parsed).like("OBJECT%") & alone & member, F.lit(False))


def completeness(text: Column, required: list[str] = REQUIRED_OUTPUT) -> Column:
    """Share of required keys that a JSON object has."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.when(is_json_object(text), F.size(F.array_intersect(keys, F.array(*map(F.lit, required)))) / len(required)).otherwise(0.0)


def merged_ranges(ranges: Column, most: int = 8) -> Column:
    """Ranges (a, b) in order, those that touch or overlap joined; over ``most`` of them left fails the job."""
    kind = "array<struct<a:int,b:int>>"
    checked = lambda x: F.when(F.size(x) <= most, x).otherwise(F.raise_error(F.lit(f"more than {most} line ranges")))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["a"] <= F.try_element_at(acc, F.lit(-1))["b"] + 1),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(acc, F.lit(-1))["b"], x["b"]).alias("b")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(F.array_distinct(ranges)), F.array().cast(kind), step, checked)


def lines_of(ranges: Column) -> Column:
    """Distinct line numbers in ranges (a, b)."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r["a"], r["b"])))))


def span_lines(text: Column, span: Column) -> Column:
    """First and last line that a substring covers; null if it does not occur."""
    at = F.instr(text, span)
    first = F.length(F.substring(text, F.lit(1), at - 1)) - F.length(F.replace(F.substring(text, F.lit(1), at - 1), F.lit("\n"), F.lit(""))) + 1
    more = F.length(span) - F.length(F.replace(span, F.lit("\n"), F.lit("")))
    return F.when(at > 0, F.struct(first.cast("int").alias("a"), (first + more).cast("int").alias("b")))


def range_texts(text: Column, ranges: Column) -> Column:
    """Distinct non-blank texts of line ranges."""
    lines = F.split(text, "\n")
    found = F.transform(ranges, lambda r: F.array_join(F.slice(lines, r["a"], r["b"] - r["a"] + 1), "\n"))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(UNICODE_INK)))


def grounded(text: Column, spans: Column) -> Column:
    """Whether every span occurs in the text."""
    return F.forall(spans, lambda s: F.contains(text, s))


def least_confidence(levels: Column) -> Column:
    """The lowest of low, medium, high; low without any."""
    order = F.array_min(F.transform(levels, lambda x: F.when(x == "high", 2).when(x == "medium", 1).otherwise(0)))
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.coalesce(order, F.lit(0)) + 1).cast("int"))


def overlap_scores(expected: Column, actual: Column) -> dict[str, Column]:
    """Precision, recall, f1 and number of hallucinated members of two sets; both empty: 1, 1, 1, 0."""
    expected, actual = F.array_distinct(expected), F.array_distinct(actual)
    both, n, m = F.size(F.array_intersect(expected, actual)), F.size(actual), F.size(expected)
    p = F.when((n == 0) & (m == 0), 1.0).when(n == 0, 0.0).otherwise(both / F.greatest(n, F.lit(1)))
    r = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(both / F.greatest(m, F.lit(1)))
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-300)))
    return {"precision": p, "recall": r, "f1": f, "hallucinated": F.when(n == 0, 0).otherwise(n - both).cast("long")}


def composite_score(parsed: Column, schema_valid: Column, complete: Column, safe: Column, risk_match: Column, attack_f1: Column, disciplined: Column) -> Column:
    """35 points for the contract, 20 safety, 15 risk, 20 mapping, 10 evidence."""
    bonus = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    return F.round(bonus(parsed, 10) + bonus(schema_valid, 15) + 10 * complete + bonus(safe, 20) + bonus(risk_match, 15) + 20 * attack_f1 + bonus(disciplined, 10), 4)


def decision(risk_level: Column, usable: Column) -> Column:
    """True, false, or null (abstention)."""
    return F.when(usable & risk_level.isin("high", "critical"), True).when(usable & (risk_level == "low"), False)


# The verb that links a role to a sink, and the roles of which an assessment needs one linked.
ROLE_VERBS = {"source": "flows_to", "control": "constrains", "bound": "bounds", "remediation": "remediates"}
REQUIRED_ROLES = {"present": ["source", "control", "bound"], "not_observed": ["control", "bound", "remediation"]}


def role_graph_errors(assessment: Column, nodes: Column, edges: Column, text: Column | Callable[[Column], Column]) -> Column:
    """Errors of a finding: evidence nodes (id, role, span) in a text, and edges (source, target, verb) between them.

    ``text``: the text that holds the spans, or a test of whether a span was supplied.

    Ids are unique, spans occur in the text, edges link known nodes and end at a sink by the verb of their source's
    role, a sink is among the nodes, and an assessment that is no abstention has a role it requires linked to a sink.
    """
    supplied = text if callable(text) and not isinstance(text, Column) else (lambda span: F.contains(text, span))
    ids = F.transform(nodes, lambda n: n["id"])
    role = lambda i: F.element_at(F.filter(nodes, lambda n: n["id"] == i), -1)["role"]
    known = lambda e: F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"])
    verb = lambda r: F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_VERBS.items() for x in pair]), r)
    linked = F.filter(edges, known)
    told = F.transform(linked, lambda e: F.struct(role(e["source"]).alias("source"), role(e["target"]).alias("target"), e["verb"].alias("verb")))
    fits = lambda x: F.coalesce(verb(x["source"]) == x["verb"], F.lit(False))

    def errors(told: Column) -> Column:
        needed = F.lit(False)
        for name, roles in REQUIRED_ROLES.items():
            needed = needed | ((assessment == name) & ~F.exists(told, lambda x: fits(x) & (x["target"] == "sink") & x["source"].isin(roles)))
        found = {
            "no_evidence": assessment.isin(*REQUIRED_ROLES) & (F.size(nodes) == 0),
            "duplicate_node_id": F.size(F.array_distinct(ids)) != F.size(ids),
            "span_not_grounded": ~F.forall(nodes, lambda n: F.coalesce(supplied(n["span"]), F.lit(False))),
            "unresolved_edge": F.size(linked) != F.size(edges),
            "edge_ends_at_no_sink": F.exists(told, lambda x: x["target"] != "sink"),
            "verb_does_not_fit_role": ~F.forall(told, fits),
            "no_sink": (F.size(nodes) > 0) & ~F.exists(nodes, lambda n: n["role"] == "sink"),
            "no_required_role_linked": (F.size(nodes) > 0) & needed,
        }
        return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]))

    return F.element_at(F.transform(F.array(told), errors), 1)


def role_output_errors(output: Column, scope: Column, functions: Column) -> Column:
    """Errors of a whole output (scope, assessment, findings) against the record that it is about.

    ``scope``: the record's struct, every field of which the output's scope must repeat; ``functions``: function_id, pseudo_c, and arrays
    assembly and static_feature. A finding names a function and a representation of it: a span must stand in the code, or be one of
    the supplied lines or features. Errors of finding k begin with ``findings.<k>:``.
    """
    assessment, findings = output["assessment"], F.coalesce(output["findings"], F.array())
    fields = F.json_object_keys(F.to_json(scope, {"ignoreNullFields": "false"}))
    values = lambda x: F.from_json(F.to_json(x, {"ignoreNullFields": "false"}), "map<string,string>")
    wrong = F.transform(F.filter(fields, lambda k: ~F.try_element_at(values(output["scope"]), k).eqNullSafe(F.try_element_at(values(scope), k))), lambda k: F.concat(F.lit("scope."), k))
    none = F.when(assessment.isin(*REQUIRED_ROLES) & (F.size(findings) == 0), F.array(F.lit("findings:missing"))).otherwise(F.array().cast("array<string>"))

    def of(finding: Column, k: Column) -> Column:
        function = F.try_element_at(F.filter(functions, lambda x: x["function_id"] == finding["function_id"]), F.lit(1))
        kind = finding["representation"]
        grounded = lambda span: F.when(kind == "pseudo_c", F.contains(function["pseudo_c"], span)).when(kind == "assembly", F.array_contains(function["assembly"], span)).when(kind == "static_feature", F.array_contains(function["static_feature"], span))
        found = role_graph_errors(assessment, finding["nodes"], finding["edges"], grounded)
        told = F.when(function.isNull(), F.array(F.lit("unknown_function"))).when(~kind.isin("pseudo_c", "assembly", "static_feature"), F.array(F.lit("unknown_representation"))).otherwise(found)
        return F.transform(told, lambda e: F.concat(F.lit("findings."), k.cast("string"), F.lit(":"), e))

    return F.concat(wrong, none, F.flatten(F.transform(findings, of)))


def fixed_length(values: Column, n: int) -> Column:
    """Whether an array has ``n`` numbers and no null."""
    return F.coalesce((F.size(values) == n) & F.forall(values, lambda x: x.isNotNull()), F.lit(False))


def shares(values: Column) -> Column:
    """Values divided by their sum, as they are if it is not above 0."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return once(values, lambda v: once(total(v), lambda t: F.transform(v, lambda x: F.when(t > 0, x.cast("double") / t).otherwise(x.cast("double")))))


def padded(values: Column, n: int) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


def placed(layout: list[tuple[str, int]]) -> dict[str, tuple[int, int]]:
    """Where each part of a feature layout (name, length) begins, and where it ends."""
    out, at = {}, 0
    for name, length in layout:
        out[name] = (at, at + length)
        at += length
    return out


def features_by_layout(parts: dict[str, Column], layout: list[tuple[str, int]], total: int) -> Column:
    """Array of ``total`` doubles: the parts at the places of a layout, zeros behind them.

    A part that has not exactly its length, or holds a null, fails the job with its name; so does a layout beyond ``total``.
    """
    if layout and placed(layout)[layout[-1][0]][1] > total:
        raise ValueError(f"the layout is longer than {total}")

    def whole(name: str, length: int) -> Column:
        wrong = lambda v: F.raise_error(F.concat(F.lit(f"{name}: {length} values are wanted, there are "), F.coalesce(F.size(v), F.lit(0)).cast("string")))
        return once(parts[name].cast("array<double>"), lambda v: F.when(fixed_length(v, length), v).otherwise(wrong(v).cast("array<double>")))

    checked = [whole(name, length) for name, length in layout]
    return padded(F.concat(*checked), total)


def by_vocabulary(counts: Column, names: list[str]) -> Column:
    """The values of a map at the places of known names; 0 where a name is absent, other names are left out."""
    return F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at(counts, n).cast("double"), F.lit(0.0)))


def relative_to(values: Column, total: Column) -> Column:
    """Values divided by a total, as they are if it is not above 0."""
    return F.transform(values, lambda x: F.when(total > 0, x.cast("double") / total).otherwise(x.cast("double")))
