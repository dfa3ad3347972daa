"""Annotated C functions: what their FLAW and FIX comments point at, in code from which all that tells the label is gone."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.curation import c_functions

#: One pass over a function: comments, literals and names; what stands between them is code too.
_TOKEN = re.compile(r"(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<literal>\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)|(?P<name>[^\W\d]\w*)", re.S)
# The marks of annotations, and the words that tell a label.
_MARKS = {"flaw": re.compile(r"^.*?POTENTIAL\s+FLAW\s*:\s*", re.I | re.S), "fix": re.compile(r"^.*?\bFIX\s*:\s*", re.I | re.S)}
_TELLING = re.compile(r"good|bad", re.I)
_CONDITIONAL = re.compile(r"^[ \t]*#[ \t]*(?:if|ifdef|ifndef|elif|else|endif)\b", re.M)
FUNCTION_NAME, OTHER_NAME = "sample_function", "candidate_symbol_"

ANNOTATED = "name string, code string, reason string, kind string, description string, first_line int, last_line int, span string"


@dataclass
class Annotation:
    kind: str
    description: str
    at: int  # where, in the cleaned code, what it points at begins


def renamed(code: str, name: str) -> dict[str, str]:
    """New names for the function and for every other name that tells its label, numbered as they are met."""
    told = dict.fromkeys(w for w in re.findall(r"\b[^\W\d]\w*\b", code) if _TELLING.search(w) and w != name)
    return {name: FUNCTION_NAME} | {w: f"{OTHER_NAME}{k}" for k, w in enumerate(told, 1)}


def cleaned(code: str, names: dict[str, str]) -> tuple[str, list[Annotation]]:
    """The code without comments and with new names, line by line where it was; and the annotations in its comments."""
    out: list[str] = []
    found: list[Annotation] = []
    size = end = 0

    def add(text: str) -> None:
        nonlocal size
        out.append(text)
        size += len(text)

    for token in _TOKEN.finditer(code):
        add(code[end : token.start()])
        end = token.end()
        if token["comment"]:
            add("\n" * token["comment"].count("\n"))
            for kind, mark in _MARKS.items():
                if mark.search(token["comment"]):
                    told = re.sub(r"\s*\*/\s*\Z", "", mark.sub("", token["comment"]))
                    found.append(Annotation(kind, re.sub(r"\s*\n\s*\*?\s*|\s+", " ", told).strip(), size))
                    break
        else:
            add(names.get(token["name"], token["name"]) if token["name"] else token["literal"])
    add(code[end:])
    return "".join(out), found


def following(code: str, at: int) -> tuple[int, int] | None:
    """Where the statement, or the head of a block, that begins at or after a place begins and ends. Literals hide what they hold."""
    start = next((k for k in range(at, len(code)) if not code[k].isspace()), None)
    if start is None:
        return None
    depth = 0
    for token in re.finditer(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[(){};]", code[start:]):
        sign = token[0]
        depth += (sign == "(") - (sign == ")")
        if depth <= 0 and sign in ";{}":
            return start, start + (token.start() if sign == "}" else token.end())
    return start, len(code)


def annotated(file: str) -> Iterator[tuple]:
    """Rows of ANNOTATED for each function of a file; one without kind where it has no annotation or a reason to be left out."""
    for name, _, _, body in c_functions(file):
        code, marks = cleaned(body, renamed(body, name))
        reason = "conditional_preprocessor" if _CONDITIONAL.search(body) else "tells_label" if _TELLING.search(code) else None if marks else "no_annotation"
        text = "\n".join(line.rstrip() for line in code.split("\n"))
        if reason:
            yield name, text, reason, None, None, None, None, None
            continue
        for mark in marks:
            place = following(code, mark.at)
            lines = (None, None, None) if place is None else (code.count("\n", 0, place[0]) + 1, code.count("\n", 0, place[1] - 1) + 1, code[slice(*place)])
            yield name, text, None, mark.kind, mark.description, *lines


def annotated_functions(files: DataFrame, key: str, text: str) -> DataFrame:
    """key and the columns of ANNOTATED: a row for each FLAW or FIX comment of each function, with the lines of the statement after it.

    Lines count from 1 at the function's first. Comments, strings and characters are told apart in one pass, so marks
    inside strings are none, and braces or names inside comments count for nothing. A function is left out, with its reason, if
    it has conditional directives (paths that exclude each other), if its code still tells the label, or if it has no annotation.
    """
    source = files.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        names = [x.split()[0] for x in ANNOTATED.split(", ")]
        for batch in batches:
            rows = [(k, *row) for k, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in annotated(file or "")]
            columns = list(zip(*rows)) if rows else [[] for _ in range(9)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], [key, *names])

    return source.mapInArrow(run, T.StructType([T.StructField(key, source.schema["_key"].dataType), *T.StructType.fromDDL(ANNOTATED)]))
