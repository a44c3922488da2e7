"""Registry of the corpus operators' queries and their SQL."""

from __future__ import annotations

from evidmill.llm import attention_lm, conversation_repair, decontaminate, embed_dedup, hard_negatives, html_extract, ngram_join, packing, pii, quality_rules, spm_codec, token_count, weak_classifier


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": embed_dedup.op1_embedding_near_dedup,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
        "op4_quality_classifier": weak_classifier.op4_quality_classifier,
        "op5_html_extraction": html_extract.op5_html_extraction,
        "op6_lm_scoring": attention_lm.op6_lm_scoring,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_sentencepiece": spm_codec.op8_sentencepiece,
        "op9_pii": pii.op9_pii,
        "op10_token_counts": token_count.op10_token_counts,
        "op11_benchmark_decontamination": decontaminate.op11_benchmark_decontamination,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": embed_dedup.OP1_SQL,
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op3_ngram_jaccard_join": ngram_join.OP3_SQL,
        "op9_pii": pii.OP9_SQL,
        "op11_benchmark_decontamination": decontaminate.OP11_SQL,
        "op12_conversation_repair": conversation_repair.OP12_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
