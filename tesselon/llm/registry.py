"""Queries of this subpackage and their SQL."""

from . import align, chat, decontaminate, jaccard, language, licenses, lines, minhash, packing, pii, runs, sharding, sketch


def queries() -> dict:
    return {
        "op1_language": language.op1_language,
        "op2_packing": packing.op2_packing,
        "op3_lines": lines.op3_lines,
        "op4_jaccard": jaccard.op4_jaccard,
        "op5_pii": pii.op5_pii,
        "op6_sketch": sketch.op6_sketch,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_sharding": sharding.op8_sharding,
        "op9_chat": chat.op9_chat,
        "op10_licenses": licenses.op10_licenses,
        "op11_align": align.op11_align,
        "op12_runs": runs.op12_runs,
        "op13_minhash": minhash.op13_minhash,
    }


def oracle_sql() -> dict:
    return {
        "op4_jaccard": jaccard.OP4_SQL,
        "op9_chat": chat.OP9_SQL,
        "op13_minhash": minhash.OP13_SQL,
    }
