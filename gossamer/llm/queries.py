"""The registered queries of this package and their SQL."""

from __future__ import annotations

from gossamer.llm import chat, decontaminate, infill, jaccard, mixing, mixlm, periods, quality, subtrees, suffixes, tokenbin, warc, webp

QUERIES = {
    "op1_warc_transactions": warc.op1_query,
    "op2_source_mixing": mixing.op2_query,
    "op3_context_mixing": mixlm.op3_query,
    "op4_quality_trees": quality.op4_query,
    "op5_lossless_webp": webp.op5_query,
    "op6_chat_formatting": chat.op6_query,
    "op7_token_packing": tokenbin.op7_query,
    "op8_benchmark_decontamination": decontaminate.op8_query,
    "op9_jaccard_classes": jaccard.op9_query,
    "op10_suffix_repeats": suffixes.op10_query,
    "op11_periodic_runs": periods.op11_query,
    "op12_fill_in_middle": infill.op12_query,
    "op13_suffix_subtrees": subtrees.op13_query,
}
SQL = {
    "op1_warc_transactions": warc.OP1_SQL,
    "op2_source_mixing": mixing.OP2_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "op12_fill_in_middle": infill.OP12_SQL,
    "op13_suffix_subtrees": subtrees.OP13_SQL,
}
