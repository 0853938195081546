"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tallymark.llm import oracles
from tallymark.llm.decontamination import op2_decontamination
from tallymark.llm.language_fusion import op6_language
from tallymark.llm.quality_mcd import op3_quality
from tallymark.llm.secret_scan import op4_secret_scan
from tallymark.llm.sentencepiece_codec import op5_sentencepiece
from tallymark.llm.simhash_vptree import op9_simhash
from tallymark.llm.suffix_dedup import op10_suffix_dedup
from tallymark.llm.token_counts import op7_token_counts
from tallymark.llm.toxicity_chain import op8_toxicity
from tallymark.llm.url_templates import op1_url_templates


def queries() -> dict:
    return {
        "op1_url_templates": op1_url_templates,
        "op2_decontamination": op2_decontamination,
        "op3_quality": op3_quality,
        "op4_secret_scan": op4_secret_scan,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_language": op6_language,
        "op7_token_counts": op7_token_counts,
        "op8_toxicity": op8_toxicity,
        "op9_simhash": op9_simhash,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
