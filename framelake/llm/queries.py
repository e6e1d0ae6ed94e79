"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import (bpe, decontaminate, exact_dedup, html_extract, lexical_search, mixing, pii, prefix_trie, quality_classifier, quality_rules, secret_scan, simhash,
               url_filter)

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_mixing": mixing.query,
    "op4_secret_scan": secret_scan.query,
    "op5_pii_surrogates": pii.query,
    "op6_simhash": simhash.query,
    "op7_bpe": bpe.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_html_extract": html_extract.query,
    "op10_url_filter": url_filter.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_lexical_search": lexical_search.query,
    "op13_decontamination": decontaminate.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op13_decontamination": decontaminate.ORACLE,
}
