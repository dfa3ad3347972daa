"""Query: annotations of C functions, in files made for each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import annotations as A
from lodestrata.plans.registry import query, table

#: {k} becomes the supplier's number. Marks stand in comments of both kinds, over lines, and in strings, where they are none.
_FILE = """/* FIX: above all functions } */
void CWE_bad_{k}(char *data)
{
    char badBuffer[{k}];
    const char *s = "/* FIX: no comment */ { bad";
    /* POTENTIAL FLAW: copies
     * more than fits */
    memcpy(badBuffer, data,
           {k} + 1); // } not an end
    use('"', badBuffer);
}
static void goodG2B(void) {
    // FIX: a size that fits
    int good_size = {k};
    /* FIX: checked first */ if (good_size > 0 /* { */) {
        run(good_size, "; bad}");
    }
    /* POTENTIAL FLAW: the same call as before */
    run(good_size, 1);
}
void helper_bad(void) {
#ifdef X
    /* FIX: in one path only */ a();
#endif
}
void plain(void) { b(); }
"""


_ROWS = [
    ("CWE_bad_{k}", "tells_label", None, None, None, None, None),
    ("goodG2B", "tells_label", None, None, None, None, None),
    ("helper_bad", "conditional_preprocessor", None, None, None, None, None),
    ("plain", "no_annotation", None, None, None, None, None),
    ("work_bad", None, "flaw", "copies more than fits", 6, 7, "memcpy(candidate_symbol_1, data,\n           {k} + 1);"),
    ("work_good", None, "fix", "a size that fits", 3, 3, "int candidate_symbol_1 = {k};"),
    ("work_good", None, "fix", "checked first", 4, 4, "if (candidate_symbol_1 > 0 ) {"),
    ("work_good", None, "flaw", "the same call as before", 8, 8, "run(candidate_symbol_1, \"; { }\");"),
]
_FILE += """void work_bad(char *data)
{
    char badBuffer[{k}];
    /* POTENTIAL FLAW: copies
     * more than fits */
    memcpy(badBuffer, data,
           {k} + 1); // } not an end
}
void work_good(void) {
    // FIX: a size that fits
    int goodSize = {k};
    /* FIX: checked first */ if (goodSize > 0 /* { */) {
        run(goodSize);
    }
    /* POTENTIAL FLAW: the same call as before */ // and more
    run(goodSize, "; { }");
}
"""


def _stated(row: tuple) -> str:
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "replace('" + x.replace("'", "''") + "', '{k}', s_suppkey::VARCHAR)"
    name, reason, kind, description, first, last, span = row
    return f"SELECT s_suppkey, {text(name)} AS name, {text(reason)} AS reason, {text(kind)} AS kind, {text(description)} AS description, {first or 0}::INTEGER AS first_line, {last or 0}::INTEGER AS last_line, {text(span)} AS span FROM supplier"


@query(" UNION ALL ".join(map(_stated, _ROWS)))
def annotation_spans(spark, d):
    files = table(spark, d, "supplier").select("s_suppkey", F.replace(F.lit(_FILE), F.lit("{k}"), F.col("s_suppkey").cast("string")).alias("text"))
    return A.annotated_functions(files, "s_suppkey", "text").drop("code").na.fill(0, ["first_line", "last_line"])
