"""Queries and SQL of this subpackage."""

from __future__ import annotations

from quantloom.llm import bpe, contamination, exact, extraction, jaccard, lines, phrases, quality, spelling, substrings, tool_calls, urls, warc

QUERIES = {
    "op1_warc_bundles": warc.query,
    "op2_html_extraction": extraction.query,
    "op3_tool_calls": tool_calls.query,
    "op4_url_filter": urls.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_decontamination": contamination.query,
    "op7_repeated_phrases": substrings.query,
    "op8_line_dedup": lines.query,
    "op9_bpe": bpe.query,
    "op10_quality_rules": quality.query,
    "op11_collocations": phrases.query,
    "op12_spelling_variants": spelling.query,
    "op13_exact_dedup": exact.query,
}
ORACLES = {
    "op1_warc_bundles": warc.SQL,
    "op3_tool_calls": tool_calls.SQL,
    "op7_repeated_phrases": substrings.SQL,
    "op8_line_dedup": lines.SQL,
    "op10_quality_rules": quality.SQL,
    "op11_collocations": phrases.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_exact_dedup": exact.SQL,
}
