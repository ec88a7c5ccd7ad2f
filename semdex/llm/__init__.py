"""Operators of a training-data pipeline, registered as opN_<name>."""

from semdex.llm import (chat, collocations, exact_dedup, hard_negatives, language_id, mixing, near_join, packing, quality,
                        rules, sharding, toxicity, warc)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_chat_format": chat.op2_chat_format,
    "op3_mixing": mixing.op3_mixing,
    "op4_warc": warc.op4_warc,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_packing": packing.op7_packing,
    "op8_near_join": near_join.op8_near_join,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_language_id": language_id.op11_language_id,
    "op12_collocations": collocations.op12_collocations,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
