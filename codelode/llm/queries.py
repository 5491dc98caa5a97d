"""Queries of the llm operators and their SQL, by name."""

from codelode.llm import bpe, chunk_dedup, clusters, embeddings, exact_dedup, leaks, lexical, licenses, lines, packing, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_chunk_dedup": chunk_dedup.op4_chunk_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_ranked_search": lexical.op11_ranked_search,
    "op12_benchmark_decontamination": leaks.op12_benchmark_decontamination,
    "op13_centroid_clustering": clusters.op13_centroid_clustering,
}
ORACLE_SQL = {
    "op1_embedding_near_dedup": embeddings.OP1_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op11_ranked_search": lexical.OP11_SQL,
    "op12_benchmark_decontamination": leaks.OP12_SQL,
    "op13_centroid_clustering": clusters.OP13_SQL,
}
