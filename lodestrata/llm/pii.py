"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans; checksum validators (Luhn for card numbers, modulo 97 for bank account
numbers), range checks and, for secrets, the variety of their characters confirm them; words nearby, before or
after, raise or lower a span's score. The base kinds email, ip, card and phone keep every confirmed span whatever
its score. The added kinds iban, ssn, key (access keys of known forms) and secret (what a password, token or key is
set to) are kept from a score of ``MIN_SCORE`` on.

The patterns are written so that matching takes linear time: a run of characters is entered at its start only,
and taken possessively where nothing behind it could make it give back.

Defined cases: a null or empty text has no span; a very long one is searched whole, in linear time. Offsets count code points, ends are exclusive. Spans of one
kind don't overlap; spans of different kinds may. Repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.storage import plain, table

#: Lowest score of a span of an added kind.
MIN_SCORE = 0.5
#: Code points before a span and after it, up to the next one of its kind, in which context words are sought.
CONTEXT = 40
#: Matches whose offsets are summed up in one go.
BLOCK = 1000

_LOCAL = "[A-Za-z0-9._%+-]"
_NAMED = r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)[\x22']?\x20{0,3}[=:]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass Luhn's check."""
    values = F.transform(F.reverse(F.split(_digits(text), "")), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), x.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether ``text``, an account number, passes the modulo-97 check."""
    compact = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))
    values = F.transform(F.split(moved, ""), lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55))
    return F.aggregate(values, F.lit(0), lambda a, x: F.when(x < 10, a * 10 + x).otherwise(a * 100 + x) % 97) == 1


def _holds(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | text.contains(x)
    return out


def _varied(text: Column) -> Column:
    """Whether a secret has enough different characters to be one; a line of dots or zeros has not."""
    return F.size(F.array_distinct(F.split(text, ""))) >= 6


def _digits_between(low: int, high: int):
    return lambda text: F.length(_digits(text)).between(low, high)


class Kind:
    """A kind of span: guard (cheap test for texts that can hold one), pattern, check, score, context words."""

    def __init__(self, name, guard, pattern, check, score, words, base=False):
        self.name, self.guard, self.pattern, self.check, self.score, self.words, self.base = name, guard, pattern, check, score, words, base


KINDS = [
    Kind("email", lambda t: t.contains("@"), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x: F.lit(True), 0.9, "e-?mail|mail|contact|write", base=True),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda x: x.rlike(rf"^(?:{_OCTET}(?:\.|$)){{4}}$"), 0.6, "ip|address|host|server|login", base=True),
    Kind("card", lambda t: t.rlike(r"(?:[0-9][\x20-]?+){14}"), r"[0-9](?:[\x20-]?+[0-9])++", lambda x: _digits_between(14, 19)(x) & luhn(x), 0.8, "card|visa|credit|debit|payment|account", base=True),
    Kind("phone", lambda t: t.contains("+"), r"\+[0-9][\x20().0-9-]+[0-9]", _digits_between(10, 15), 0.7, "phone|tel|call|mobile|fax|number", base=True),
    Kind("iban", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?+[A-Z0-9]{4}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", mod97, 0.8, "iban|bank|account|transfer|konto"),
    Kind("key", lambda t: _holds(t, "AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghu_", "xoxa-", "xoxb-", "xoxp-"), r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{20,}+)(?![A-Za-z0-9_])", lambda x: _varied(x), 0.8, "key|token|access|secret|credential"),
    Kind("secret", lambda t: t.rlike(f"[=:](?<={_NAMED})"), rf"(?<={_NAMED}\x20{{0,3}}[\x22']?)[^\s\x22',;<>]{{8,}}+", lambda x: _varied(x) & x.rlike("[0-9]") & x.rlike("[A-Za-z]"), 0.6, "login|user|secret|credential|private"),
    Kind("ssn", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda x: F.lit(True), 0.3, "ssn|social|security|tax|insurance"),
]
_AGAINST = "example|sample|version|invoice|order|isbn|test"

SPAN = "array<struct<start: long, rank: int, end: long, kind: string, text: string, score: double>>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def proposals(text: Column, pattern: str) -> Column:
    """Each match of ``pattern``: start, text, and the gaps between it and the matches before and after.

    A start is the total length of what stands before; it is summed in blocks, so that many matches in one
    text don't copy ever longer lists.
    """
    empty = F.array().cast("array<struct<start: bigint, text: string, gap: string, after: string>>")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = (a["at"] + F.length(x["gap"])).cast("bigint")
        return F.struct(
            (start + F.length(x["text"])).cast("bigint").alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), x["text"].alias("text"), x["gap"].alias("gap"), x["after"].alias("after")))).alias("out")
        )

    def join(a: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: F.struct((a["at"] + x["start"]).alias("start"), x["text"].alias("text"), x["gap"].alias("gap"), x["after"].alias("after")))
        return F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], moved).alias("out"))

    def located(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)), begin, step))
        return F.when(F.size(pairs) > 0, F.aggregate(blocks, begin, join)["out"]).otherwise(empty)

    # one gap more than matches: zip_with pads the last with null, which the filter takes off
    def paired(gaps: Column) -> Column:
        before = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("text")))
        return F.zip_with(before, F.slice(gaps, F.lit(2), F.size(gaps)), lambda x, g: F.struct(x["gap"].alias("gap"), x["text"].alias("text"), g.alias("after")))

    return bound(F.filter(bound(F.split(text, pattern, -1), paired), lambda x: x["text"].isNotNull()), located)


def spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind."""
    rank = next(k for k, x in enumerate(KINDS) if x is kind)

    def judged(x: Column) -> Column:
        context = F.lower(F.concat_ws("\n", F.substring(x["gap"], -CONTEXT, CONTEXT), F.substring(x["after"], 1, CONTEXT)))
        score = F.lit(kind.score) + F.when(context.rlike(rf"\b(?:{kind.words})\b"), 0.3).otherwise(0.0) - F.when(context.rlike(rf"\b(?:{_AGAINST})\b"), 0.3).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["text"])).cast("bigint").alias("end"), F.lit(kind.name).alias("kind"), x["text"].alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 2))).alias("score")
        )

    confirmed = F.transform(F.filter(proposals(text, kind.pattern), lambda x: kind.check(x["text"])), judged)
    if not kind.base:
        confirmed = F.filter(confirmed, lambda x: x["score"] >= MIN_SCORE)
    return F.when(kind.guard(text), confirmed.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, and for each kind an array column of its spans (start, rank, end, kind, text, score)."""
    text = F.coalesce("text", F.lit(""))
    return plain(docs, "doc_id", "text").select("doc_id", *[spans(text, x).alias(x.name) for x in KINDS])


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans by start and kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base, every = [x.name for x in KINDS if x.base], F.concat(*[x.name for x in KINDS])
    return found.select(
        "doc_id",
        *[F.size(x).cast("long").alias(f"n_{x}") for x in base],
        F.sha2(listed(F.concat(*base)), 256).alias("base_sha256"),
        listed(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
        F.array_join(F.transform(F.array_sort(every), lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )
