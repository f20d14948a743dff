"""The queries of this subpackage, by name, and the SQL that states their rows."""

from __future__ import annotations

from quire.llm import chat, collocations, exact_dedup, mixing, multi_index, packing, ranked_search, secrets, shingle_join, substring_dedup, surrogates, token_files, toxicity

QUERIES = {
    "op1_tool_calls": chat.op1_tool_calls,
    "op2_poisson_mixing": mixing.op2_poisson_mixing,
    "op3_multi_index": multi_index.op3_multi_index,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_token_files": token_files.op5_token_files,
    "op6_packing": packing.op6_packing,
    "op7_shingle_join": shingle_join.op7_shingle_join,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_surrogates": surrogates.op10_surrogates,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_collocations": collocations.op13_collocations,
}

SQL = {
    "op1_tool_calls": chat.OP1_SQL,
    "op2_poisson_mixing": mixing.OP2_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_substring_dedup": substring_dedup.OP11_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
