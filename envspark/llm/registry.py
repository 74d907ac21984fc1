"""Queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from envspark.llm import bm25, chat, chunk_dedup, exact_dedup, licences, mixing, near_dup, neighbours, packing, toxicity, url_rules, vector_codes, warc

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_hilbert_neighbours": neighbours.op2_hilbert_neighbours,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_licence_scan": licences.op5_licence_scan,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_url_rules": url_rules.op7_url_rules,
    "op8_chunk_dedup": chunk_dedup.op8_chunk_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_simhash_near_dedup": near_dup.op10_simhash_near_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_ranked_search": bm25.op12_ranked_search,
    "op13_warc": warc.op13_warc,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.SQL.strip(),
    "op4_source_mix": mixing.SQL.strip(),
    "op5_licence_scan": licences.SQL.strip(),
    "op7_url_rules": url_rules.SQL.strip(),
    "op11_vector_codes": vector_codes.SQL.strip(),
    "op12_ranked_search": bm25.SQL.strip(),
    "op13_warc": warc.SQL.strip(),
}
