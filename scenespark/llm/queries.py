"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bitsliced, divergence, kneser_ney, language, merkle, mixing, outliers, packing, pii, quality, simhash, sketch, token_files

QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_token_files": token_files.op2_token_files,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality": quality.op4_quality,
    "op5_mix": mixing.op5_mix,
    "op6_kneser_ney": kneser_ney.op6_kneser_ney,
    "op7_language": language.op7_language,
    "op8_pii": pii.op8_pii,
    "op9_topk": bitsliced.op9_topk,
    "op10_sketch": sketch.op10_sketch,
    "op11_merkle": merkle.op11_merkle,
    "op12_divergence": divergence.op12_divergence,
    "op13_outliers": outliers.op13_outliers,
}

ORACLES = {
    "op5_mix": mixing.ORACLE,
    "op9_topk": bitsliced.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
