"""Queries: rules of weaknesses and targets of pairs, on functions whose sizes come from the supplied parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lodestrata.functions import weakness_rules as W
from lodestrata.operators import targets as G
from lodestrata.plans.registry import query, table

#: weakness, vulnerable function, fixed function; {n} and {m} become sizes of the row.
CASES = [
    ("CWE-121", "void f(void)\n{\n/* memcpy(x); */\n  char buffer [{n}];\n  memcpy(buffer,source,{m});\n}", "{\n  char buffer [{n}];\n  memcpy(buffer,source,sizeof(buffer));\n}"),
    ("CWE-122", "  data = (char *)malloc({n});\n  strcpy(data,source);", "  data = (char *)malloc({m});\n  strcpy(data,source);"),
    ("CWE-124", "  data = buffer + -8;\n  memcpy(data,source,{n});", "  if (index >= 0) {\n  data = dataGoodBuffer;\n  memcpy(buffer + index,source,{n});\n}"),
    ("CWE-126", "  char dataBadBuffer [{n}];\n  char dest [{m}];\n  data = dataBadBuffer;\n  memcpy(dest,data,{m});", "  char dataGoodBuffer [{m}];\n  data = dataGoodBuffer;\n  memcpy(dest,data,{m});"),
    ("CWE-127", "  data = dataBuffer - 8;\n  strcpy(dest,data);\n  printLine(dest);", "  if (data >= 0) {\n  strcpy(dest,data);\n  printLine(dest);\n}"),
    ("CWE-134", '  fgets(data,{n},stdin);\n  printf(data);', '  fgets(data,{n},stdin);\n  printf("%s",data);'),
    ("CWE-190", '  fscanf(stdin,"%d",&data);\n  result = data + {n};\n  printIntLine(result);', '  fscanf(stdin,"%d",&data);\n  if (data < {m}) {\n  result = data + {n};\n}'),
    ("CWE-191", "  data = -{n};\n  result = data - 1;", "  data = -{n};\n  if (data > 0) {\n  result = data - 1;\n}"),
    ("CWE-195", "  data = (int)input;\n  memcpy(dest,source,(ulong)data);", "  data = {n};\n  memcpy(dest,source,(ulong)data);"),
    ("CWE-457", "  for (i = 0; i < {n}; i = i + 1) {\n  data[i] = source;\n}\n  while (i_1 < {m}) {\n  printIntLine(data[i_1]);\n}", "  for (i = 0; i < {m}; i = i + 1) {\n  data[i] = 5;\n}\n  while (i_1 < {m}) {\n  printIntLine(data[i_1]);\n}"),
    ("CWE-690", "  data = (int *)malloc({n});\n  data[0] = 5;", "  data = (int *)malloc({n});\n  if (data != 0) {\n  data[0] = 5;\n}"),
    ("CWE-78", "  fgets(data,{n},stdin);\n  system(data);", '  data = "ls";\n  system(data);'),
    ("CWE-401", "  data = calloc({n},1);\n  printLine(data);", "  data = calloc({n},1);\n  free(data);"),
    ("CWE-369", "  printIntLine({n});", "  printIntLine({m});"),
    ("CWE-789", "  data = rand();\n  p = malloc(data);\n  *p = {n};", "  data = rand();\n  if (data < 100) {\n  p = malloc(data);\n}"),
    ("CWE-000", "  x = {n};", "  x = {m};"),
    ("CWE-121", "  char buffer [{n}];\n  memcpy(other,source,{m});", "  char buffer [{n}];\n  count = {m};"),
    ("CWE-23", '  fgets(data,{n},stdin);\n  strcat(path,data);\n  f = fopen(path,"r");', '  strcat(path,"file.txt");\n  f = fopen(path,"r");'),
    ("CWE-606", "  fgets(data,{n},stdin);\n  while (i < n) {\n  i++;\n}", "  n = atoi(data);\n  if (n < 100) {\n  while (i < n) {\n}"),
    ("CWE-762", "  data = malloc({n});\n  operator_delete(data);", "  data = malloc({n});\n  free(data);"),
]


def _sql_text(text: str) -> str:
    return "replace(replace('" + text.replace("'", "''") + "', '{n}', p_size::VARCHAR), '{m}', (p_size + 7)::VARCHAR)"


_CASE_ROWS = ", ".join(f"({k}, '{w}')" for k, (w, _, _) in enumerate(CASES))
_PAIRS = f"""q AS (SELECT p_partkey, (p_partkey % {len(CASES)})::INTEGER AS c, p_size, p_partkey % 61 <> 0 AS same_scope FROM part),
pairs AS (SELECT p_partkey, c, same_scope, CASE c {' '.join(f"WHEN {k} THEN '{w}'" for k, (w, _, _) in enumerate(CASES))} END AS weakness,
  CASE c {' '.join(f"WHEN {k} THEN {_sql_text(a)}" for k, (_, a, _) in enumerate(CASES))} END AS present_code, CASE c {' '.join(f"WHEN {k} THEN {_sql_text(b)}" for k, (_, _, b) in enumerate(CASES))} END AS fixed_code FROM q)"""


def _pairs(spark, d):
    rows = spark.createDataFrame([(k, *case) for k, case in enumerate(CASES)], "c int, weakness string, present string, fixed string")
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(CASES)).cast("int").alias("c"), F.col("p_size").alias("n"))
    sized = lambda text: F.replace(F.replace(text, F.lit("{n}"), F.col("n").cast("string")), F.lit("{m}"), (F.col("n") + 7).cast("string"))
    variant = F.when(F.col("p_partkey") % 61 != 0, "gcc").otherwise("clang")
    joined = parts.join(F.broadcast(rows), "c")  # twenty rows
    return joined.select("p_partkey", "weakness", sized(F.col("present")).alias("present_code"), sized(F.col("fixed")).alias("fixed_code"), F.lit("gcc").alias("present_compiler"), variant.alias("fixed_compiler"))


def _rule_rows() -> str:
    """The rules as SQL values: part, weakness, place, needs, lacks, points."""
    every = sorted({c for names in [*W.TARGETS, *(r[0] for r in W.VISIBLE)] for c in names.split()})
    out: list[str] = []
    quoted = lambda ps: "[" + ", ".join("'(?i)" + p.replace("'", "''") + "'" for p in ps) + "]::VARCHAR[]"
    parts = [("target", [(k, 1, v) for k, v in W.TARGETS.items()] + [(W.COPYING, 1, W.COPY)]), ("operation", W.OPERATIONS), ("test", W.TESTS), ("control", W.CONTROLS), ("visible", [(r[0], 1, *r[1:]) for r in W.VISIBLE])]
    for part, rules in parts:
        for place, (names, points, *patterns) in enumerate(rules):
            needs, lacks = [p for p in patterns if p[0] != "!"], [p[1:] for p in patterns if p[0] == "!"]
            out += [f"('{part}', '{c}', {place}, {quoted(needs)}, {quoted(lacks)}, {points})" for c in (every if names == "*" else names.split())]
    return ", ".join(out)


_RULES = f"rules AS (SELECT * FROM (VALUES {_rule_rows()}) t(part, weakness, place, needs, lacks, points))"
_FITS = "len(list_filter(needs, lambda p: NOT regexp_matches({0}, p))) = 0 AND len(list_filter(lacks, lambda p: regexp_matches({0}, p))) = 0"


@query(
    f"""WITH {_PAIRS}, {_RULES}, sides AS (SELECT p_partkey, 'present' AS side, weakness, regexp_replace(present_code, '(?s)/\\*.*?\\*/', '', 'g') AS code FROM pairs UNION ALL SELECT p_partkey, 'fixed', weakness, regexp_replace(fixed_code, '(?s)/\\*.*?\\*/', '', 'g') FROM pairs)
SELECT p_partkey, side, coalesce((SELECT bool_or({_FITS.format('code')}) FROM rules r WHERE r.weakness = s.weakness AND r.part = 'visible'), (SELECT bool_or({_FITS.format('code')}) FROM rules r WHERE r.weakness = s.weakness AND r.part = 'target'), false) AS visible FROM sides s"""
)
def weakness_visibility(spark, d):
    rows = G.with_rules(_pairs(spark, d), "weakness", G.rules_table(spark))
    both = F.array(F.struct(F.lit("present").alias("side"), F.col("present_code").alias("code")), F.struct(F.lit("fixed").alias("side"), F.col("fixed_code").alias("code")))
    return rows.select("p_partkey", "rules", F.explode(both).alias("s")).select("p_partkey", "s.side", G.visible_relation(F.col("s.code")).alias("visible"))


@query(
    rf"""WITH {_PAIRS}, {_RULES}, sides AS (SELECT p_partkey, 'present' AS side, weakness, present_code AS code, fixed_code AS other FROM pairs UNION ALL SELECT p_partkey, 'fixed', weakness, fixed_code, present_code FROM pairs),
l AS (SELECT p_partkey, side, weakness, list_transform(string_split(regexp_replace(code, '(?s)/\*.*?\*/', '', 'g'), chr(10)), lambda x: trim(x)) AS xs, list_transform(string_split(regexp_replace(other, '(?s)/\*.*?\*/', '', 'g'), chr(10)), lambda x: trim(x)) AS ys FROM sides),
x AS (SELECT p_partkey, side, weakness, ys, unnest(xs) AS line, generate_subscripts(xs, 1) AS i FROM l),
u AS (SELECT p_partkey, side, weakness, line, min(i) AS i, bool_or(list_contains(ys, line)) AS shared FROM x WHERE line NOT IN ('', '{{', '}}') AND (line LIKE '%;' OR regexp_matches(line, '(?i){W.OPERATION.replace("'", "''")}') OR regexp_matches(line, '^(?:if|for|while) \(|^do \{{')) GROUP BY ALL),
s AS (SELECT u.*, r.part, r.place, r.points FROM u LEFT JOIN rules r ON r.weakness = u.weakness AND r.part IN ('target', 'operation', 'test', 'control') AND {_FITS.format('line')}),
a AS (SELECT p_partkey, side, i, line, shared, count(*) FILTER (part = 'target') > 0 AS aimed, arg_min(points, place) FILTER (part = 'operation') AS op, arg_min(points, place) FILTER (part = 'test') AS te, arg_min(points, place) FILTER (part = 'control') AS ct FROM s GROUP BY ALL)
SELECT p_partkey, side, (row_number() OVER (PARTITION BY p_partkey, side ORDER BY i) - 1)::INTEGER AS place, line, coalesce(CASE WHEN aimed THEN op ELSE te END, 0)::INTEGER AS operation, CASE WHEN shared THEN 0 ELSE coalesce(ct, 0) END::INTEGER AS control FROM a"""
)
def weakness_line_scores(spark, d):
    rows = G.line_scores(_pairs(spark, d), "p_partkey", "weakness")
    return rows.select("p_partkey", "side", F.explode("lines").alias("x")).select("p_partkey", "side", "x.place", "x.line", "x.operation", "x.control")


#: What each case's sides show under a contract, or why the pair is quarantined; a strict contract is stated where it differs from the one before.
STATED = {
    "v1": {
        0: ('line-1 memcpy(buffer,source,{m}); | line-2 char buffer [{n}];', 'line-1 memcpy(buffer,source,sizeof(buffer));'),
        1: ('line-1 strcpy(data,source); | line-2 data = (char *)malloc({n});', 'line-1 data = (char *)malloc({m}); | line-2 strcpy(data,source);'),
        2: ('line-1 data = buffer + -8; | line-2 memcpy(data,source,{n});', 'line-1 data = dataGoodBuffer; | line-2 memcpy(buffer + index,source,{n}); | line-3 if (index >= 0) {'),
        3: ('line-1 data = dataBadBuffer; | line-2 memcpy(dest,data,{m}); | line-3 char dataBadBuffer [{n}]; | line-4 char dest [{m}];', 'line-1 data = dataGoodBuffer; | line-2 memcpy(dest,data,{m});'),
        4: 'no_operation',
        5: ('line-1 printf(data);', 'line-1 printf("%s",data);'),
        6: ('line-1 result = data + {n};', 'line-1 if (data < {m}) {'),
        7: ('line-1 data = -{n}; | line-2 result = data - 1;', 'line-1 if (data > 0) {'),
        8: ('line-1 data = (int)input; | line-2 memcpy(dest,source,(ulong)data);', 'line-1 data = {n};'),
        9: ('line-1 printIntLine(data[i_1]); | line-2 data[i] = source;', 'line-1 data[i] = 5; | line-2 printIntLine(data[i_1]);'),
        10: 'no_remediation',
        11: ('line-1 system(data);', 'line-1 data = "ls"; | line-2 system(data);'),
        12: ('line-1 data = calloc({n},1);', 'line-1 free(data); | line-2 data = calloc({n},1);'),
        13: 'no_observable_relation',
        14: ('line-1 p = malloc(data);', 'line-1 if (data < 100) { | line-2 p = malloc(data);'),
        15: 'no_observable_relation',
        16: 'no_remediation',
        17: ('line-1 fgets(data,{n},stdin); | line-2 strcat(path,data); | line-3 f = fopen(path,"r");', 'line-1 strcat(path,"file.txt"); | line-2 f = fopen(path,"r");'),
        18: ('line-1 fgets(data,{n},stdin); | line-2 while (i < n) {', 'line-1 if (n < 100) { | line-2 while (i < n) {'),
        19: ('line-1 operator_delete(data); | line-2 data = malloc({n});', 'line-1 free(data); | line-2 data = malloc({n});'),
    },
    "v2": {
        0: ('bound-1 char buffer [{n}]; | sink-1 memcpy(buffer,source,{m});', 'remediation-1 char buffer [{n}]; | sink-1 memcpy(buffer,source,sizeof(buffer));'),
        1: ('bound-1 data = (char *)malloc({n}); | sink-1 strcpy(data,source);', 'remediation-1 data = (char *)malloc({m}); | sink-1 strcpy(data,source);'),
        2: ('bound-1 data = buffer + -8; | sink-1 memcpy(data,source,{n});', 'control-1 if (index >= 0) { | sink-1 memcpy(buffer + index,source,{n});'),
        3: ('source-1 data = dataBadBuffer; | bound-1 char dataBadBuffer [{n}]; | sink-1 memcpy(dest,data,{m});', 'remediation-1 data = dataGoodBuffer; | bound-1 char dataGoodBuffer [{m}]; | sink-1 memcpy(dest,data,{m});'),
        4: ('bound-1 data = dataBuffer - 8; | sink-1 strcpy(dest,data);', 'control-1 if (data >= 0) { | sink-1 strcpy(dest,data);'),
        5: ('source-1 fgets(data,{n},stdin); | sink-1 printf(data);', 'remediation-1 printf("%s",data); | sink-1 printf("%s",data);'),
        6: ('source-1 fscanf(stdin,"%d",&data); | sink-1 result = data + {n};', 'control-1 if (data < {m}) { | sink-1 result = data + {n};'),
        7: ('source-1 data = -{n}; | sink-1 data = -{n};', 'control-1 if (data > 0) { | sink-1 data = -{n};'),
        8: ('source-1 data = (int)input; | sink-1 memcpy(dest,source,(ulong)data);', 'remediation-1 data = {n}; | sink-1 memcpy(dest,source,(ulong)data);'),
        9: ('source-1 data[i] = source; | bound-1 for (i = 0; i < {n}; i = i + 1) { | bound-2 while (i_1 < {m}) { | sink-1 printIntLine(data[i_1]);', 'remediation-1 data[i] = 5; | bound-1 for (i = 0; i < {m}; i = i + 1) { | bound-2 while (i_1 < {m}) { | sink-1 printIntLine(data[i_1]);'),
        10: ('source-1 data = (int *)malloc({n}); | sink-1 data = (int *)malloc({n});', 'control-1 if (data != 0) { | remediation-1 data = (int *)malloc({n}); | sink-1 data = (int *)malloc({n});'),
        11: ('source-1 fgets(data,{n},stdin); | sink-1 system(data);', 'remediation-1 data = "ls"; | sink-1 system(data);'),
        12: ('source-1 printLine(data); | sink-1 data = calloc({n},1);', 'remediation-1 free(data); | sink-1 data = calloc({n},1);'),
        13: 'no_observable_relation',
        14: ('source-1 *p = {n}; | sink-1 p = malloc(data);', 'remediation-1 if (data < 100) { | sink-1 p = malloc(data);'),
        15: 'no_observable_relation',
        16: 'no_role_linked_to_sink',
        17: ('source-1 strcat(path,data); | sink-1 f = fopen(path,"r");', 'remediation-1 strcat(path,"file.txt"); | sink-1 f = fopen(path,"r");'),
        18: 'no_role_linked_to_sink',
        19: ('source-1 operator_delete(data); | sink-1 data = malloc({n});', 'remediation-1 free(data); | sink-1 data = malloc({n});'),
    },
    "v2-strict": {
        11: 'no_strict_rules',
        12: 'no_strict_rules',
        13: 'no_strict_rules',
        14: 'no_strict_rules',
        15: 'no_strict_rules',
        17: 'no_strict_rules',
        18: 'no_strict_rules',
        19: 'no_strict_rules',
    },
    "v2-strict-v5": {
        0: 'quarantined_after_review',
        2: 'quarantined_before',
        4: 'quarantined_before',
        9: 'quarantined_before',
        10: 'quarantined_before',
        16: 'quarantined_after_review',
    },
}


def _stated(contract: str, k: int) -> str | tuple[str, str]:
    found = STATED[contract]
    if k in found:
        return found[k]
    return _stated({"v2-strict-v5": "v2-strict", "v2-strict": "v2"}[contract], k)


def _stated_rows() -> str:
    out = []
    for contract in STATED:
        for k in range(len(CASES)):
            told = _stated(contract, k)
            reason, sides = (told, (None, None)) if isinstance(told, str) else (None, told)
            first = reason is not None and reason.startswith(("no_strict", "quarantined"))
            for side, evidence in zip(("present", "fixed"), sides):
                links = 0 if evidence is None or contract == "v1" else evidence.count(" | ")
                quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
                out.append(f"('{contract}', {k}, '{side}', {quoted(reason)}, {quoted(evidence)}, {links}, {str(first).lower()})")
    return ", ".join(out)


@query(
    f"""WITH {_PAIRS}, s AS (SELECT * FROM (VALUES {_stated_rows()}) t(contract, c, side, reason, evidence, links, leads)),
j AS (SELECT contract, p_partkey, side, CASE WHEN leads THEN reason WHEN NOT same_scope THEN 'scopes_differ' ELSE reason END AS reason, replace(replace(evidence, '{{n}}', p_size::VARCHAR), '{{m}}', (p_size + 7)::VARCHAR) AS evidence, links FROM pairs JOIN s USING (c) JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey))
SELECT contract, p_partkey, side, reason, CASE WHEN reason IS NULL THEN evidence END AS evidence, CASE WHEN reason IS NULL THEN links ELSE 0 END::INTEGER AS n_relations FROM j"""
)
def pair_targets(spark, d):
    pairs, out = _pairs(spark, d), []
    for contract in STATED:
        found = G.targets(pairs, "p_partkey", "weakness", contract, ["compiler"])
        told = F.array_join(F.transform("evidence", lambda e: F.concat(e["id"], F.lit(" "), e["span"])), " | ")
        out.append(found.select(F.lit(contract).alias("contract"), "p_partkey", "side", "reason", told.alias("evidence"), F.greatest(F.size("relations"), F.lit(0)).alias("n_relations")))
    return reduce(lambda a, b: a.unionAll(b), out)
