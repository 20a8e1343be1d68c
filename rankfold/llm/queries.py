"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from rankfold.llm import alignment, bpe, exact_dedup, licenses, line_dedup, mixing, pii, prefix_trie, quality, simhash, substring_dedup, token_table, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_quality": quality.op3_quality,
    "op4_simhash": simhash.op4_simhash,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_bpe": bpe.op9_bpe,
    "op10_pii": pii.op10_pii,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_token_table": token_table.op12_token_table,
    "op13_alignment": alignment.op13_alignment,
}
SQL = {**alignment.SQL, **line_dedup.SQL, **exact_dedup.SQL, **mixing.SQL, **bpe.SQL, **licenses.SQL, **pii.SQL, **prefix_trie.SQL, **quality.SQL, **simhash.SQL, **substring_dedup.SQL, **token_table.SQL, **toxicity.SQL}
