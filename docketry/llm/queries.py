"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from docketry.llm import chat, html_blocks, langid, lexical, line_rules, minhash, mixing, mtree, periodic, pieces, quality_mil, url_templates, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_language_id": langid.op2_language_id,
        "op3_quality": quality_mil.op3_quality,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_chat_format": chat.op5_chat_format,
        "op6_line_quality": line_rules.op6_line_quality,
        "op7_html_extract": html_blocks.op7_html_extract,
        "op8_exact_top_k": mtree.op8_exact_top_k,
        "op9_mix_sources": mixing.op9_mix_sources,
        "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_ranked_lexical": lexical.op12_ranked_lexical,
        "op13_url_templates": url_templates.op13_url_templates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "op5_chat_format": chat.OP5_SQL,
        "op6_line_quality": line_rules.OP6_SQL,
        "op8_exact_top_k": mtree.OP8_SQL,
        "op9_mix_sources": mixing.OP9_SQL,
        "op10_minhash_near_dedup": minhash.OP10_SQL,
        "op12_ranked_lexical": lexical.OP12_SQL,
        "op13_url_templates": url_templates.OP13_SQL,
    }
