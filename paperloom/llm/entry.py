"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, dac, decontam, langid, merkle, negatives, packing, quality, sharding, simhash, substring, suffix, urls

QUERIES = {
    "op1_substring": substring.op1_substring,
    "op2_suffix": suffix.op2_suffix,
    "op3_url_filter": urls.op3_url_filter,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_quality": quality.op6_quality,
    "op7_token_ids": dac.op7_token_ids,
    "op8_bpe": bpe.op8_bpe,
    "op9_language": langid.op9_language,
    "op10_shard": sharding.op10_shard,
    "op11_merkle": merkle.op11_merkle,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_pack": packing.op13_pack,
}

ORACLE_SQL = {
    "op1_substring": substring.OP1_SQL,
    "op5_decontaminate": decontam.OP5_SQL,
    "op6_quality": quality.OP6_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
