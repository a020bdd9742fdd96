"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tilewright.llm import decontamination, kneser_ney, language_id, line_dedup, minhash_dedup, quality_rules, secret_scan, sentencepiece_codec, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_language_id": language_id.query,
        "op2_sentencepiece": sentencepiece_codec.query,
        "op3_secret_scan": secret_scan.query,
        "op4_toxicity": toxicity.query,
        "op5_line_dedup": line_dedup.query,
        "op6_minhash_dedup": minhash_dedup.query,
        "op7_token_counts": token_counts.query,
        "op8_quality_rules": quality_rules.query,
        "op9_decontamination": decontamination.query,
        "op10_kneser_ney": kneser_ney.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_dedup": minhash_dedup.SQL, "op5_line_dedup": line_dedup.SQL, "op3_secret_scan": secret_scan.SQL, "op8_quality_rules": quality_rules.SQL}
