"""Training targets from pairs of decompiled functions: a vulnerable side and a fixed one, with evidence that is linked to a sink.

Rules are rows of :func:`rules_table` (part, weakness, place, needs, lacks, points). A weakness' rules are joined to its rows as
one array, and each line of a function gets the points of the first rule that fits: no shuffle of lines, and no plan that
grows with the number of rules. Roles are linked to the sink by the identifiers that their lines share with it. A pair that
can't have a target is quarantined with a reason.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import weakness_rules as W
from lodestrata.functions.structures import ROLE_VERBS
from lodestrata.operators.versions import fingerprint

_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_RULE = "struct<place:int,needs:array<string>,lacks:array<string>,points:int>"
_ROLES = "array<struct<role:string,place:int>>"


def rules_table(spark: SparkSession) -> DataFrame:
    """part, weakness, place, needs, lacks, points: all rules, in order within a part."""
    every = sorted({c for names in [*W.TARGETS, *(r[0] for r in W.VISIBLE)] for c in names.split()})
    rows = []

    def add(part: str, names: str, points: int, patterns: tuple[str, ...]) -> None:
        needs, lacks = ([("(?i)" + p.removeprefix("!")) for p in patterns if p.startswith("!") == negated] for negated in (False, True))
        rows.extend((part, c, len(rows), needs, lacks, points) for c in (every if names == "*" else names.split()))

    for names, pattern in W.TARGETS.items():
        add("target", names, 1, (pattern,))
    add("target", W.COPYING, 1, (W.COPY,))
    for part, table in (("operation", W.OPERATIONS), ("test", W.TESTS), ("control", W.CONTROLS)):
        for names, points, *patterns in table:
            add(part, names, points, tuple(patterns))
    for part, table in (("visible", W.VISIBLE), ("sink", W.SINKS)):
        for names, *patterns in table:
            add(part, names, 1, tuple(patterns))
    return spark.createDataFrame(rows, "part string, weakness string, place int, needs array<string>, lacks array<string>, points int")


def with_rules(rows: DataFrame, weakness: str, rules: DataFrame) -> DataFrame:
    """``rows`` with ``rules``: a map from part to the rules of the row's weakness, in order; null without any."""
    listed = rules.groupBy("weakness", "part").agg(F.array_sort(F.collect_list(F.struct("place", "needs", "lacks", "points"))).alias("r"))
    by_weakness = listed.groupBy("weakness").agg(F.map_from_entries(F.collect_list(F.struct("part", "r"))).alias("rules"))
    return rows.join(F.broadcast(by_weakness.withColumnRenamed("weakness", "_w")), F.col(weakness) == F.col("_w"), "left").drop("_w")  # a few dozen rows


def _part(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("rules"), F.lit(name)), F.array().cast(f"array<{_RULE}>"))


def _fits(rule: Column, text: Column) -> Column:
    return F.forall(rule["needs"], lambda p: F.rlike(text, p)) & ~F.exists(rule["lacks"], lambda p: F.rlike(text, p))


def _any(part: str, text: Column) -> Column:
    return F.exists(_part(part), lambda r: _fits(r, text))


def _points(part: str, text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(_part(part), lambda r: _fits(r, text)), F.lit(1))["points"], F.lit(0))


def like(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def without_comments(code: Column) -> Column:
    return F.regexp_replace(code, r"(?s)/\*.*?\*/", "")


def _lines(code: Column) -> Column:
    return F.transform(F.split(code, _LINE_ENDS), T.stripped)


def statements_of(code: Column, keep_do: bool = True) -> Column:
    """Distinct lines that state something, in order: those that end in ``;``, hold an operation, or begin a branch."""
    starts = W.BRANCH if keep_do else r"(?-i)^(?:if|for|while) \("
    return F.array_distinct(F.filter(_lines(code), lambda x: (x != "") & ~x.isin("{", "}") & (x.endswith(";") | like(x, W.OPERATION) | like(x, starts))))


def identifiers_of(line: Column) -> Column:
    """Names that stay the same between compilers: no types, no loop counters, no printing functions."""
    found = F.array_distinct(F.regexp_extract_all(line, F.lit(r"\b[A-Za-z_]\w*\b"), F.lit(0)))
    return F.filter(found, lambda x: ~F.lower(x).isin(*W.NO_NAMES) & ~x.rlike(r"(?i)^(?:i(?:_\d+)?|undefined\d*|print.*)$"))


def visible_relation(code: Column) -> Column:
    """Whether a code shows the relation of its weakness (column ``rules``, see :func:`with_rules`); without a rule of its own, any operation of it."""
    text = without_comments(code)
    return F.coalesce(F.when(F.size(_part("visible")) > 0, _any("visible", text)).otherwise(_any("target", text)), F.lit(False))


def scored_lines(statements: Column, other: Column) -> Column:
    """place, line, names, operation, control (0 where the other side has the line too), shared, declares, branches of each statement."""

    def scored(x: Column, i: Column) -> Column:
        shared = F.array_contains(other, x)
        operation = F.when(_any("target", x), _points("operation", x)).otherwise(_points("test", x))
        return F.struct(
            i.alias("place"), x.alias("line"), identifiers_of(x).alias("names"), operation.alias("operation"), F.when(shared, 0).otherwise(_points("control", x)).alias("control"),
            shared.alias("shared"), like(x, W.DECLARATION).alias("declares"), like(x, W.BRANCH).alias("branches"), like(x, W.IF).alias("tests"), _any("sink", x).alias("preferred"),
        )

    return F.transform(statements, scored)


def sink_of(lines: Column) -> Column:
    """The line that a weakness' roles are linked to: of the preferred ones, else of all operations, the one of most points."""
    found = F.filter(lines, lambda x: (x["operation"] > 0) & ~x["declares"] & ~x["branches"])
    rank = lambda x: F.struct((~x["preferred"]).alias("a"), (-x["operation"]).alias("b"), x["place"].alias("c"), x.alias("x"))
    return F.array_min(F.transform(found, rank))["x"]


_Test = Callable[[Column], Column]


def _first(lines: Column, test: _Test) -> Column:
    return F.try_element_at(F.filter(lines, test), F.lit(1))["place"]


def _last(lines: Column, test: _Test, n: int) -> Column:
    found = F.transform(F.filter(lines, test), lambda x: x["place"])
    return F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), F.lit(n))


def _role(name: str | Column, *places: Column) -> Column:
    """The role at all these places; none if any is null."""
    name = F.lit(name) if isinstance(name, str) else name
    there = reduce(lambda a, b: a & b, [p.isNotNull() for p in places])
    return F.when(there, F.array(*[F.struct(name.alias("role"), p.cast("int").alias("place")) for p in places])).otherwise(F.array()).cast(_ROLES)


def _roles(name: str, places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(F.lit(name).alias("role"), p.cast("int").alias("place"))).cast(_ROLES)


def _all(*roles: Column) -> Column:
    """All of these roles, or none if one has no place."""
    whole = reduce(lambda a, b: a & b, [F.size(r) > 0 for r in roles])
    return F.when(whole, F.concat(*roles)).otherwise(F.array().cast(_ROLES))


def _else(*roles: Column) -> Column:
    """The first of these that has a place."""
    return reduce(lambda a, b: F.when(F.size(a) > 0, a).otherwise(b), roles)


def linked_roles(weakness: Column, lines: Column, sink: Column, positive: Column) -> Column:
    """(role, place) of the lines that a weakness' own rules link to its sink, in order; empty if they find none."""
    shares = lambda x: F.arrays_overlap(x["names"], sink["names"])
    first = lambda pattern, test=lambda x: F.lit(True): _first(lines, lambda x: like(x["line"], pattern) & shares(x) & test(x))
    either = lambda present, fixed: F.when(positive, present).otherwise(fixed)
    strong = _first(lines, lambda x: (x["control"] >= W.STRONG) & (x["place"] != sink["place"]))
    mended = _role("remediation", strong)

    call = F.regexp_extract(sink["line"], r"\b\w+\s*\(\s*([A-Za-z_]\w*)\s*,", 1)
    target = F.when(call != "", call).otherwise(F.regexp_extract(sink["line"], r"\b([A-Za-z_]\w*)\s*\[[^\]]+\]\s*=", 1))
    sized = lambda name: F.concat(F.lit(r"(?i)\b"), name, F.lit(r"\s*\[\s*(?:0x[0-9a-f]+|\d+)\s*\]"))
    made = F.concat(F.lit(r"(?i)\b"), target, F.lit(r"\b\s*=\s*(?:\([^)]*\)\s*)?(?:malloc|calloc|realloc|new\b)[^;]*"))
    capacity = F.when(target != "", _first(lines, lambda x: F.rlike(x["line"], sized(target)) | F.rlike(x["line"], made)))

    offset = either(_role("bound", first(W.NEGATIVE)), _role("control", first(r"(?:>=\s*0|>\s*0|<\s*(?:0x[0-9a-f]+|\d+))")))

    copied = F.regexp_extract(sink["line"], r"(?i)\b(?:memcpy|memmove|strncpy|wcsncpy)\s*\(\s*[^,]+,\s*([A-Za-z_]\w*)", 1)
    chooses = F.concat(F.lit(r"(?i)\b"), copied, F.lit(r"\s*=\s*([A-Za-z_]\w*(?:Buffer)?)\s*;"))
    choice = F.try_element_at(F.filter(lines, lambda x: (copied != "") & F.rlike(x["line"], chooses)), F.lit(1))
    chosen = F.try_element_at(F.regexp_extract_all(choice["line"], chooses, F.lit(1)), F.lit(1))
    selection = _all(_role(F.when(positive, "source").otherwise("remediation"), choice["place"]), _role("bound", _first(lines, lambda x: F.rlike(x["line"], sized(chosen)))))

    literal_format = F.when(like(sink["line"], r"\b\w*printf\s*\(\s*(?:[^,]+,\s*)?L?" + W.LITERAL), sink["place"])
    literal_copy = first(r"(?:strcpy|strncpy|wcscpy|wcsncpy)\s*\([^;]*L?" + W.LITERAL)
    format_ = either(_role("source", first(r"(?:fgets|fgetws|recv|read|scanf)\s*\(")), _else(_role("remediation", literal_format), _role("remediation", literal_copy)))

    external = _roles("source", _last(lines, lambda x: like(x["line"], W.READS) & shares(x), 2))
    assigned = lambda x: F.exists(sink["names"], lambda n: F.rlike(x["line"], F.concat(F.lit("^"), n, F.lit(r"\s*="))))
    assignment = _roles("source", _last(lines, lambda x: assigned(x) & ~x["line"].rlike(r"=\s*0\s*;"), 1))
    numeric = either(_else(external, assignment), _role("control", first(r"(?:<|>|<=|>=|==|!=)", lambda x: x["tests"])))

    converts = lambda x: like(x["line"], r"=\s*\((?:u?char|u?short|u?int|u?long|size_t)\)") | like(x["line"], r"^(?:data|size|length)\s*=\s*-\s*(?:0x[0-9a-f]+|\d+)") | like(x["line"], r"(?:fscanf|scanf|recv|read|atoi|strto\w*)\s*\(")
    conversion = either(_roles("source", _last(lines, lambda x: ~x["shared"] & shares(x) & converts(x), 2)), mended)

    left = lambda x: identifiers_of(F.substring_index(x["line"], "=", 1))
    write = _first(lines, lambda x: (x["place"] != sink["place"]) & F.contains(x["line"], F.lit("=")) & F.arrays_overlap(left(x), sink["names"]))
    loop = lambda upto: F.try_element_at(F.filter(lines, lambda x: x["line"].rlike(r"^(?:for|while) \(") & (x["place"] < upto)), F.lit(-1))["place"]
    filled = F.when(loop(write) != loop(sink["place"]), _all(_role(F.when(positive, "source").otherwise("remediation"), write), _role("bound", loop(write), loop(sink["place"])))).otherwise(F.array().cast(_ROLES))

    allocator = first(W.ALLOCATES)
    unchecked = either(_role("source", allocator), _all(_role("control", first(r"(?:==|!=)\s*(?:NULL|0)\b", lambda x: x["tests"])), _role("remediation", allocator)))

    own = {
        ("CWE-121", "CWE-122"): _role(F.when(positive, "bound").otherwise("remediation"), capacity),
        ("CWE-124", "CWE-127"): offset,
        ("CWE-126",): selection,
        ("CWE-134",): format_,
        ("CWE-190", "CWE-191"): numeric,
        ("CWE-194", "CWE-195"): conversion,
        ("CWE-457",): filled,
        ("CWE-690",): unchecked,
    }
    out = F.when(positive, F.array().cast(_ROLES)).otherwise(mended)
    for names, roles in own.items():
        out = F.when(weakness.isin(*names), roles).otherwise(out)
    return out


def general_role(lines: Column, sink: Column, positive: Column) -> Column:
    """Where a weakness' own rules find nothing: the line that shares most names with the sink, or controls it most."""

    def ranked(x: Column) -> Column:
        common = F.size(F.array_intersect(x["names"], sink["names"]))
        weight = common * 20 + F.when(x["shared"], 0).otherwise(10) + x["control"]
        return F.struct((-weight).alias("a"), x["place"].alias("b"), x.alias("x"), ((common > 0) | (x["control"] >= W.STRONG)).alias("fits"))

    found = F.filter(F.transform(F.filter(lines, lambda x: (x["place"] != sink["place"]) & ~x["declares"]), ranked), lambda r: r["fits"])
    best = F.array_min(found)["x"]
    name = F.when(best["tests"], "control").when(positive, "source").otherwise("remediation")
    return F.when(positive | (best["control"] >= W.STRONG), _role(name, best["place"])).otherwise(F.array().cast(_ROLES))


def _sides(pairs: DataFrame, weakness: str, scope: list[str], keep_do: bool) -> DataFrame:
    """One row for each side of each pair: side, assessment, positive, code, other_code, same_scope, lines, rules and the pair's columns."""
    same = reduce(lambda a, b: a & b, [F.col(f"present_{c}").eqNullSafe(F.col(f"fixed_{c}")) for c in scope], F.lit(True))
    parted = with_rules(pairs, weakness, rules_table(pairs.sparkSession)).withColumn("same_scope", same).withColumn("seen", visible_relation(F.coalesce("present_code", F.lit(""))))
    side = lambda name, told, code, other: F.struct(F.lit(name).alias("side"), F.lit(told).alias("assessment"), F.coalesce(code, F.lit("")).alias("code"), F.coalesce(other, F.lit("")).alias("other_code"))
    both = F.array(side("present", "present", F.col("present_code"), F.col("fixed_code")), side("fixed", "not_observed", F.col("fixed_code"), F.col("present_code")))
    rows = parted.withColumn("s", F.explode(both)).select(*parted.columns, "s.*").withColumn("positive", F.col("side") == "present")
    clean = without_comments if keep_do else (lambda c: c)
    found = statements_of(clean(F.col("code")), keep_do)
    if not keep_do:
        found = F.filter(found, lambda x: ~x.startswith("/*"))
    other = statements_of(clean(F.col("other_code")), keep_do) if keep_do else F.filter(_lines(F.col("other_code")), lambda x: (x != "") & ~x.isin("{", "}"))
    return rows.withColumn("statements", found).withColumn("lines", scored_lines(F.col("statements"), other))


def _first_reason(tests: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in tests], F.lit(None).cast("string"))


def role_targets(pairs: DataFrame, key: str, weakness: str, contract: str, scope: list[str]) -> DataFrame:
    """key, side, assessment, evidence, relations, reason: targets whose roles are linked to a sink (``v2`` and the strict contracts).

    ``pairs``: key, weakness, present_code, fixed_code, and ``present_``, ``fixed_`` columns of each name in ``scope``, which must agree. A
    strict contract has weaknesses with rules of their own only. Both sides of a pair are kept or neither is.
    """
    rows = _sides(pairs, weakness, scope, True).withColumn("sink", sink_of(F.col("lines")))
    own = linked_roles(F.col(weakness), F.col("lines"), F.col("sink"), F.col("positive"))
    roles = own if contract != "v2" else _else(own, general_role(F.col("lines"), F.col("sink"), F.col("positive")))
    rows = rows.withColumn("roles", F.when(F.col("sink").isNotNull(), roles).otherwise(F.array().cast(_ROLES)))
    tests = [(~F.col(weakness).isin(W.STRICT), "no_strict_rules")] if contract != "v2" else []
    for name, more in W.QUARANTINED.items():
        if contract in W.QUARANTINED and W.CONTRACTS.index(name) <= W.CONTRACTS.index(contract):
            tests.append((F.col(weakness).isin(more), "quarantined_after_review" if name == contract else "quarantined_before"))
    tests += [
        (~F.col("same_scope"), "scopes_differ"),
        (~F.col("seen"), "no_observable_relation"),
        (F.size("statements") == 0, "no_statements"),
        (F.col("sink").isNull(), "no_sink"),
        (F.size("roles") == 0, "no_role_linked_to_sink"),
    ]
    return _finished(rows, key, _first_reason(tests), F.concat(F.transform("roles", lambda r: F.struct(r["role"].alias("role"), F.element_at(F.col("statements"), r["place"] + 1).alias("span"))), F.array(F.struct(F.lit("sink").alias("role"), F.col("sink.line").alias("span")))))


def _finished(rows: DataFrame, key: str, reason: Column, evidence: Column) -> DataFrame:
    """Numbers the evidence, links it to the first sink, and leaves out both sides of a pair if one has a reason."""
    told = rows.select(key, "side", "assessment", reason.alias("reason"), F.array_distinct(evidence).alias("e"))
    number = lambda x, i: F.size(F.filter(F.slice(F.col("e"), F.lit(1), i + 1), lambda y: y["role"] == x["role"]))
    numbered = F.transform("e", lambda x, i: F.struct(F.concat(x["role"], F.lit("-"), number(x, i).cast("string")).alias("id"), x["role"].alias("role"), x["span"].alias("span")))
    verbs = F.create_map(*[F.lit(x) for pair in ROLE_VERBS.items() for x in pair])
    told = told.withColumn("evidence", numbered)
    relations = F.transform(F.filter("evidence", lambda x: x["role"].isin(*ROLE_VERBS)), lambda x: F.struct(x["id"].alias("source"), F.lit("sink-1").alias("target"), F.try_element_at(verbs, x["role"]).alias("verb")))
    told = told.withColumn("relations", relations)
    sides = F.collect_list(F.struct("side", "assessment", "evidence", "relations", "reason"))
    paired = told.groupBy(key).agg(sides.alias("sides")).withColumn("reason", F.array_min(F.transform("sides", lambda s: F.when(s["reason"].isNotNull(), F.concat(F.when(s["side"] == "present", "0").otherwise("1"), s["reason"])))))
    kept = paired.select(key, F.substring("reason", 2, 100).alias("reason"), F.explode("sides").alias("s"))
    whole = F.col("reason").isNull()
    return kept.select(key, "s.side", "s.assessment", F.when(whole, F.col("s.evidence")).alias("evidence"), F.when(whole, F.col("s.relations")).alias("relations"), "reason")


def ranked_targets(pairs: DataFrame, key: str, weakness: str, scope: list[str], most: int = 4) -> DataFrame:
    """key, side, assessment, evidence, relations, reason: targets of the ``v1`` contract, ``most`` lines of each side by rank.

    On the vulnerable side lines rank by the points of their operation, and 12 more if the other side has them not. The fixed side
    shows its strongest control and an operation that it limits; without such a pair it is quarantined.
    """
    rows = _sides(pairs, weakness, scope, False)
    lines, w = F.col("lines"), F.col(weakness)
    best = F.array_max(F.transform(lines, lambda x: x["operation"]))
    least = reduce(lambda a, b: F.when(w == b[0], b[1]).otherwise(a), W.LEAST_POINTS.items(), F.lit(10))
    score = lambda x: x["operation"] + F.when((x["operation"] > 0) & ~x["shared"], 12).otherwise(0)
    by_score = F.transform(F.filter(lines, lambda x: score(x) > 0), lambda x: F.struct((-score(x)).alias("a"), (~like(x["line"], W.OPERATION)).alias("b"), x["place"].alias("c"), x["line"].alias("line")))
    present = F.transform(F.slice(F.array_sort(by_score), 1, most), lambda x: x["line"])

    order = lambda points: lambda x: F.struct((-x[points]).alias("a"), x["place"].alias("b"), x["line"].alias("line"))
    texts = lambda found: F.transform(found, lambda x: x["line"])
    controls = texts(F.array_sort(F.transform(F.filter(lines, lambda x: x["control"] >= W.STRONG), order("control"))))
    contrasts = texts(F.array_sort(F.transform(F.filter(lines, lambda x: (x["operation"] >= 16) & ~x["shared"]), order("operation"))))
    leading = F.slice(F.when(F.size(controls) > 0, controls).otherwise(contrasts), 1, 1)
    seen = lambda pattern: F.slice(texts(F.filter(lines, lambda x: like(x["line"], pattern))), 1, 1)
    strong, some = F.size(controls) > 0, F.size(leading) > 0
    memory = seen("(?:" + W.COPY + r"|\w+\s*\[[^\]]+\]\s*=\s*\w+\s*\[[^\]]+\])")
    needs = [  # weaknesses, whether a control is needed, operations of which one of each must be seen
        (["CWE-121", "CWE-122"], strong, [memory]),
        (["CWE-124", "CWE-126", "CWE-127"], some, [memory]),
        (["CWE-23", "CWE-36"], strong, [seen(r"(?:fopen|open|remove|rename|realpath|(?:filebuf|ifstream|ofstream)::open)\s*\(")]),
        (["CWE-78"], strong, [seen(r"(?:system|popen|exec\w*|winexec|createprocess)\s*\(")]),
        (["CWE-134"], strong, [seen(r"\b\w*printf\s*\(")]),
        (["CWE-401", "CWE-590", "CWE-762"], strong, [seen(W.ALLOCATES), seen(W.RELEASES)]),
        (["CWE-457"], strong, [seen(r"(?:print\w*line|\w*printf|memcpy|memmove)\s*\(")]),
        (["CWE-400", "CWE-606", "CWE-789"], strong, [seen(r"(?:u?sleep|while\s*\(|for\s*\(|malloc|calloc|operator_new|new\b)")]),
    ]
    none = F.array().cast("array<string>")
    fixed = F.when(some, leading).otherwise(none)
    for names, needed, operations in needs:
        whole = reduce(lambda a, b: a & (F.size(b) > 0), operations, needed)
        fixed = F.when(w.isin(names), F.when(whole, F.concat(leading, *operations)).otherwise(none)).otherwise(fixed)
    fixed = F.when(F.size(fixed) > 0, F.slice(F.array_distinct(F.concat(fixed, controls)), 1, most)).otherwise(none)
    rows = rows.withColumn("spans", F.when(F.col("positive"), present).otherwise(fixed))
    reason = _first_reason([
        (~F.col("same_scope"), "scopes_differ"), (~F.col("seen"), "no_observable_relation"), (F.size("statements") == 0, "no_statements"),
        (F.col("positive") & (F.coalesce(best, F.lit(0)) < least), "no_operation"), (F.size("spans") == 0, "no_remediation"),
    ])
    return _finished(rows, key, reason, F.transform("spans", lambda x: F.struct(F.lit("line").alias("role"), x.alias("span"))))


def by_content(pairs: DataFrame, key: str, columns: list[str], work: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """key and what ``work`` (of rows and the name of their key) finds for the row's ``columns``, worked out once for all rows that agree in them.

    The distinct rows are spread by a hash of their content, however few parts the table is read in.
    """
    marked = pairs.withColumn("_content", fingerprint(columns))
    found = work(marked.select("_content", *columns).distinct(), "_content")
    return marked.select(key, "_content").join(found, "_content").drop("_content")


def line_scores(pairs: DataFrame, key: str, weakness: str) -> DataFrame:
    """key, side, lines (see :func:`scored_lines`) of both sides of each pair."""
    of = lambda rows, k: _sides(rows, weakness, [], True).select(k, "side", "lines")
    return by_content(pairs, key, [weakness, "present_code", "fixed_code"], of)


def targets(pairs: DataFrame, key: str, weakness: str, contract: str, scope: list[str]) -> DataFrame:
    """The targets of a contract by its name: ``v1``, ``v2``, ``v2-strict`` and its later versions. ``key`` is that of one pair."""
    if contract not in W.CONTRACTS:
        raise ValueError(f"unknown contract: {contract}")
    columns = [weakness, "present_code", "fixed_code", *[f"{side}_{c}" for c in scope for side in ("present", "fixed")]]
    return by_content(pairs, key, columns, lambda rows, k: ranked_targets(rows, k, weakness, scope) if contract == "v1" else role_targets(rows, k, weakness, contract, scope))
