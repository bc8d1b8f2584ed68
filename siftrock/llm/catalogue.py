"""The queries of this subpackage and their SQL. Where SQL can't express one, tests hold it against brute force."""

from __future__ import annotations

from . import fim, language, neighbours, packing, pii, prefix_trie, quality, set_join, simhash, tiling, token_files, url_reputation, warc


def queries() -> dict:
    return {
        "op1_hilbert_neighbours": neighbours.op1,
        "op2_simhash_components": simhash.op2,
        "op3_language_id": language.op3,
        "op4_token_files": token_files.op4,
        "op5_warc_archives": warc.op5,
        "op6_string_tiling": tiling.op6,
        "op7_cutting_stock_packing": packing.op7,
        "op8_personal_data": pii.op8,
        "op9_attention_quality": quality.op9,
        "op10_url_reputation": url_reputation.op10,
        "op11_conversation_trie": prefix_trie.op11,
        "op12_fill_in_middle": fim.op12,
        "op13_set_join": set_join.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_archives": warc.ORACLE, "op10_url_reputation": url_reputation.ORACLE, "op11_conversation_trie": prefix_trie.ORACLE, "op12_fill_in_middle": fim.ORACLE, "op13_set_join": set_join.ORACLE}
