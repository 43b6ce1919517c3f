"""The queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from formlake.llm import collocations, decontamination, embedding_dedup, exact_dedup, fixity, line_dedup, sentencepiece_codec, sharding, simhash_dedup, substring_dedup, token_alignment, token_counts, toxicity

SQL: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op3_warc_fixity": fixity.OP3_SQL,
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
    "op13_exact_dedup": exact_dedup.OP13_SQL,
}


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_warc_fixity": fixity.op3_warc_fixity,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_sharding": sharding.op6_sharding,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_simhash": simhash_dedup.op10_simhash,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_phrase_collocations": collocations.op12_phrase_collocations,
        "op13_exact_dedup": exact_dedup.op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
