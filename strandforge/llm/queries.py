"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, jaccard, langid, pii, secrets, toxicity, warc


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
        "op3_language_id": langid.op3_language_id,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_warc": warc.op5_warc,
        "op6_byte_level_bpe": bpe.op6_byte_level_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_pii_surrogates": pii.op8_pii_surrogates,
        "op9_secret_scans": secrets.op9_secret_scans,
        "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_benchmark_decontamination": decontaminate.OP2_SQL,
        "op4_chat_formatting": chat.OP4_SQL,
        "op5_warc": warc.OP5_SQL,
    }
