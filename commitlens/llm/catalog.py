"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from commitlens.llm import chat, decontaminate, jaccard, lattice, mixing, packing, periodic, quality, search, sharding, tokens, urls, warc

QUERIES = {
    "op1_hash_tree_shards": sharding.shard_documents,
    "op2_warc_revisits": warc.warc_revisits,
    "op3_lattice_likelihood": lattice.lattice_scores,
    "op4_token_id_files": tokens.token_ids,
    "op5_mix_to_target_weights": mixing.mix_documents,
    "op6_url_markov_filter": urls.url_filter,
    "op7_template_decontamination": decontaminate.decontamination,
    "op8_line_frequency_quality": quality.quality_rules,
    "op9_chat_segments": chat.format_conversations,
    "op10_ngram_jaccard_join": jaccard.near_duplicates,
    "op11_periodic_runs": periodic.periodic_runs,
    "op12_lexical_search": search.lexical_search,
    "op13_sum_of_squares_packing": packing.pack_documents,
}

ORACLES = {
    "op5_mix_to_target_weights": mixing.OP5_SQL,
    "op6_url_markov_filter": urls.OP6_SQL,
    "op8_line_frequency_quality": quality.OP8_SQL,
    "op9_chat_segments": chat.OP9_SQL,
    "op10_ngram_jaccard_join": jaccard.OP10_SQL,
    "op12_lexical_search": search.OP12_SQL,
}
