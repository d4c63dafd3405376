"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from linewright.llm import (
    decontam, langid, lengths, licenses, mainpage, packing, prefixes, quality, secrets, similarity, substrings, urls, whitening,
)

QUERIES = {
    "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
    "op2_token_counts": lengths.op2_token_counts,
    "op3_ngram_jaccard_join": similarity.op3_ngram_jaccard_join,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_language_id": langid.op7_language_id,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_html_extraction": mainpage.op9_html_extraction,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_prefix_trie": prefixes.op11_prefix_trie,
    "op12_url_filters": urls.op12_url_filters,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

SQL = {
    "op5_secret_scans": secrets.SQL,
    "op6_quality_rules": quality.SQL,
    "op8_substring_dedup": substrings.SQL,
    "op11_prefix_trie": prefixes.SQL,
}
