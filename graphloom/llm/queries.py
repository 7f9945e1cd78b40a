"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from graphloom.llm.decontaminate import op10_decontaminate
from graphloom.llm.fingerprint import op4_fingerprint
from graphloom.llm.language_model import op8_language_model
from graphloom.llm.licenses import op9_licenses
from graphloom.llm.packing import op6_packing
from graphloom.llm.pii import op2_pii
from graphloom.llm.secrets import op5_secrets
from graphloom.llm.simhash import op1_simhash
from graphloom.llm.tokens import op7_token_counts
from graphloom.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_fingerprint": op4_fingerprint,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_language_model": op8_language_model,
    "op9_licenses": op9_licenses,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {}
