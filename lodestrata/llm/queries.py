"""Queries of this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import chat, collocations, decontaminate, hard_negatives, mixing
from lodestrata.llm.chat import op10_chat
from lodestrata.llm.collocations import op12_collocations
from lodestrata.llm.decontaminate import op2_decontaminate
from lodestrata.llm.hard_negatives import op13_hard_negatives
from lodestrata.llm.language import op6_language
from lodestrata.llm.language_model import op11_language_model
from lodestrata.llm.mixing import op7_mixing
from lodestrata.llm.near_dup import op4_simhash
from lodestrata.llm.pii import op9_pii
from lodestrata.llm.quality import op1_quality
from lodestrata.llm.token_counts import op8_token_counts
from lodestrata.llm.token_records import op3_token_records
from lodestrata.llm.toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality, op2_decontaminate, op3_token_records, op4_simhash, op5_toxicity, op6_language, op7_mixing, op8_token_counts, op9_pii, op10_chat, op11_language_model, op12_collocations, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE, "op7_mixing": mixing.ORACLE, "op10_chat": chat.ORACLE, "op12_collocations": collocations.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
