"""Queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from inkwell.llm import audio, chat, licenses, mixing, packing, pipeline, quality, ranking, simhash, sketches, token_counts, toxicity, vector_codes, warc


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_quality": quality.op2_quality,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_mixing": mixing.op4_mixing,
        "op5_simhash": simhash.op5_simhash,
        "op6_warc": warc.op6_warc,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_chroma": audio.op8_chroma,
        "op9_sketches": sketches.op9_sketches,
        "op10_chat": chat.op10_chat,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_licenses": licenses.op12_licenses,
        "op13_ranking": ranking.op13_ranking,
        "pipeline": pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {"op6_warc": warc.OP6_SQL, "op10_chat": chat.OP10_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_licenses": licenses.OP12_SQL, "op13_ranking": ranking.OP13_SQL}
