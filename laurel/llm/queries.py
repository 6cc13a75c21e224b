"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, fim, linededup, maxent, merkle, minhash, neighbours, phrases, pieces, shard, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_chat_formatting": chat.op2,
    "op3_substring_dedup": phrases.op3,
    "op4_sentencepiece": pieces.op4,
    "op5_nearest_neighbours": neighbours.op5,
    "op6_benchmark_decontamination": decontaminate.op6,
    "op7_sharding": shard.op7,
    "op8_line_dedup": linededup.op8,
    "op9_lm_scoring": maxent.op9,
    "op10_simhash_near_dedup": simhash.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_minhash_near_dedup": minhash.op12,
    "op13_fill_in_middle": fim.op13,
}

ORACLE_SQL = {
    "op2_chat_formatting": chat.OP2_SQL,
    "op3_substring_dedup": phrases.OP3_SQL,
    "op6_benchmark_decontamination": decontaminate.OP6_SQL,
    "op8_line_dedup": linededup.OP8_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_minhash_near_dedup": minhash.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
