"""The twelve operators' queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from ctxspark.llm import bloom_lm, bpe, crf_quality, divergence, embedding_dedup, mixing, quality_rules, sharding, simhash, substring, token_file, word_pieces


def queries() -> dict:
    return {
        "op1_linear_longest_match": word_pieces.op1_linear_longest_match,
        "op2_substring_cms": substring.op2_substring_cms,
        "op3_temperature_mixing": mixing.op3_temperature_mixing,
        "op4_bpe_transducer": bpe.op4_bpe_transducer,
        "op5_host_rules": quality_rules.op5_host_rules,
        "op6_bounded_ring": sharding.op6_bounded_ring,
        "op7_rotated_codes": embedding_dedup.op7_rotated_codes,
        "op8_line_crf": crf_quality.op8_line_crf,
        "op9_bloom_lm": bloom_lm.op9_bloom_lm,
        "op10_simhash_bktree": simhash.op10_simhash_bktree,
        "op11_huffman_ids": token_file.op11_huffman_ids,
        "op12_source_divergence": divergence.op12_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_cms": substring.OP2_SQL,
        "op3_temperature_mixing": mixing.OP3_SQL,
        "op5_host_rules": quality_rules.OP5_SQL,
        "op7_rotated_codes": embedding_dedup.OP7_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
