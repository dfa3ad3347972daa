"""Record builders and label-blind projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from lodestrata.functions import text as T
from lodestrata.functions.hashing import sha
from lodestrata.operators.ranks import key_rank

# The prompts, of which a draw chooses one.
PROMPT_VARIANTS = [
    "Assess whether {scope} is present in the supplied source-code excerpt.",
    "Review the supplied function for {scope} and report only code-visible evidence.",
    "Determine whether the supplied code exhibits {scope} without relying on provenance.",
    "Perform an evidence-grounded defensive review of the excerpt scoped to {scope}.",
]
# Limits of a record's context and code, and its splits.
MAX_CONTEXT, MAX_CODE = 6000, 4000
TRAINING_SPLITS = ["train", "validation"]


def first_failure(rules: list[tuple[str, Column]], passed: str = "eligible") -> Column:
    """Name of the first rule that holds; ``passed`` if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules], F.lit(passed))


def chat(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """Messages in order: system, user and, for training, assistant."""
    parts = [("system", system), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in parts])


def instruction_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, system, instruction, input, output: each conversation's first message of each role, if user and assistant speak."""
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    found = conversations.groupBy("conv_id").agg(first("system").alias("system"), first("user").alias("instruction"), first("assistant").alias("output"))
    return found.where("instruction is not null and output is not null").select("conv_id", F.coalesce("system", F.lit("")).alias("system"), "instruction", F.lit("").alias("input"), "output")


def challenge(df: DataFrame, role: str, answer: str, keys: list[str]) -> DataFrame:
    """What a model may see: keys of rows that are not answers, and nothing of the gold."""
    return df.where(F.col(role) != answer).select(*keys)


def gold(df: DataFrame, role: str, answer: str, keys: list[str], text: str, name: str) -> DataFrame:
    return df.where(F.col(role) == answer).select(*keys, F.sha2(text, 256).alias(name))


def prompt(scope: Column, draw: Column) -> Column:
    """A prompt on the scope in one of the variants, chosen by a draw."""
    chosen = F.element_at(F.array(*map(F.lit, PROMPT_VARIANTS)), (draw % len(PROMPT_VARIANTS) + 1).cast("int"))
    return F.replace(chosen, F.lit("{scope}"), scope)


def accepted_index(df: DataFrame, source: str, order: str, accepted: Column) -> DataFrame:
    """Accepted rows with ``accepted_index``: how many of their source were accepted before."""
    return key_rank(df.where(accepted), source, order, "accepted_index").withColumn("accepted_index", (F.col("accepted_index") - 1).cast("int"))


def compacted(values: Column, limit: int) -> Column:
    """Distinct non-blank strings in order, ``limit`` of them at most."""
    return F.slice(F.array_distinct(F.filter(values, lambda x: x.rlike(T.UNICODE_INK))), 1, limit)


def without_fields(value: Column, kind: K.DataType, forbidden: list[str]) -> Column:
    """A nested value without the members and map keys that are forbidden, compared in lower case, at any depth."""
    if isinstance(kind, K.StructType):
        kept = [f for f in kind.fields if f.name.lower() not in forbidden]
        return F.when(value.isNotNull(), F.struct(*[without_fields(value[f.name], f.dataType, forbidden).alias(f.name) for f in kept]))
    if isinstance(kind, K.ArrayType):
        return F.transform(value, lambda x: without_fields(x, kind.elementType, forbidden))
    if isinstance(kind, K.MapType):
        kept = F.map_filter(value, lambda k, v: ~F.lower(k).isin(forbidden))
        return F.transform_values(kept, lambda k, v: without_fields(v, kind.valueType, forbidden))
    return value


def without_keys(signals: Column, forbidden: list[str]) -> Column:
    """A map without the forbidden keys, compared in lower case."""
    return F.map_filter(signals, lambda k, v: ~F.lower(k).isin(forbidden))


def canonical(record_id: Column, source: Column, task: Column, context: Column, signals: Column, risk: Column, split: Column) -> Column:
    """A canonical record: context redacted, cleaned and cut, in that order; redactions are counted among the signals."""

    def of(whole: Column) -> Column:
        n = T.redactions(whole)
        marks = F.when(n > 0, F.map_concat(signals, F.create_map(F.lit("redacted_secret_like_assignments"), n.cast("string")))).otherwise(signals)
        cut = T.once(T.cleaned(T.redacted(whole)), lambda x: T.truncated(x, MAX_CONTEXT))
        return F.struct(
            record_id.alias("id"),
            F.struct(source.alias("name"), F.lit(None).cast("string").alias("url")).alias("source"),
            F.struct(task.alias("task"), cut.alias("context"), marks.alias("signals")).alias("input"),
            F.struct(risk.alias("risk_level"), F.array().cast("array<string>").alias("attack_mapping")).alias("expected_output"),
            F.struct(split.alias("split"), F.lit("redacted").alias("safety_level"), F.lit(False).alias("contains_executable_payload")).alias("metadata"),
        )

    # a plain struct would be taken apart, and its context worked out anew for each field that is read
    return T.once(context, of)


def instruction_to_canonical(instruction: Column, given: Column, output: Column, index: Column) -> Column:
    """A canonical record from an instruction row. Its output only counts towards the risk; it is never copied."""
    instruction, given, output = (T.stripped(F.coalesce(x, F.lit(""))) for x in (instruction, given, output))
    both = F.array_join(F.filter(F.array(instruction, given), lambda x: x != ""), "\n\n")
    context = F.concat(F.lit("Instruction:\n"), instruction, F.lit("\n\nInput excerpt:\n"), T.truncated(given, MAX_CODE))
    names = F.array_join(T.named_hits(given, T.SUSPICIOUS), ",")
    signals = F.create_map(F.lit("legacy_format"), F.lit("alpaca"), F.lit("suspicious_signal_names"), names)
    name = F.concat(F.lit("legacy-alpaca-"), F.lpad(index.cast("string"), 6, "0"), F.lit("-"), sha(both, 12))
    return canonical(name, F.lit("instruction rows"), F.lit("summarize"), context, signals, T.risk_of(F.concat_ws(" ", instruction, given, output)), F.lit("train"))


def labelled_code_to_canonical(code: Column, target: Column, project: Column, record_id: Column) -> Column:
    """A canonical record from a labelled function."""
    context = F.concat(F.lit("Code excerpt:\n"), T.truncated(code, MAX_CODE))
    signals = F.create_map(F.lit("target"), target.cast("string"), F.lit("project"), project)
    return canonical(record_id, project, F.lit("assess"), context, signals, F.when(target == 1, "high").otherwise("low"), F.lit("train"))


def question_and_answer(messages: DataFrame, key: str) -> DataFrame:
    """key, question, answer: the first user and assistant messages; keys that lack one are left out."""
    found = instruction_rows(messages.withColumnRenamed(key, "conv_id"))
    return found.select(F.col("conv_id").alias(key), F.col("instruction").alias("question"), F.col("output").alias("answer"))


def training_reason(record: Column, expected: Column) -> Column:
    """Why a canonical record can't be trained on: the first rule it breaks; ``eligible`` if none."""
    context, meta = record["input"]["context"], record["metadata"]
    return first_failure(
        [
            ("schema", record["id"].isNull() | T.is_blank(context)),
            ("executable_payload", meta["contains_executable_payload"]),
            ("credentials", T.has_credentials(context) | T.has_credentials(expected)),
            ("unsafe_guidance", T.any_match(expected, T.UNSAFE_GUIDANCE)),
            ("restricted", meta["safety_level"] == "restricted"),
            ("held_out_split", ~meta["split"].isin(TRAINING_SPLITS)),
        ]
    )
