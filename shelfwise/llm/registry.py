"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from shelfwise.llm.automaton import OP6_SQL, op6_substring_dedup
from shelfwise.llm.curriculum import OP13_SQL, op13_source_mix
from shelfwise.llm.huffman import op3_token_ids
from shelfwise.llm.jaccard import OP4_SQL, op4_ngram_jaccard
from shelfwise.llm.langid import op2_language_id
from shelfwise.llm.licenses import op1_license_scan, op1_sql
from shelfwise.llm.merkle import OP11_SQL, op11_merkle_manifest
from shelfwise.llm.middle import OP12_SQL, op12_fill_in_middle
from shelfwise.llm.pieces import op7_sentencepiece
from shelfwise.llm.pivots import op8_nearest_neighbours
from shelfwise.llm.suffix_array import op5_sql, op5_suffix_array_dedup
from shelfwise.llm.templates import OP9_SQL, op9_line_dedup
from shelfwise.llm.winnowing import OP10_SQL, op10_benchmark_decontamination

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_token_ids": op3_token_ids,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_line_dedup": op9_line_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_mix": op13_source_mix,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": op1_sql(),
    "op4_ngram_jaccard": OP4_SQL,
    "op5_suffix_array_dedup": op5_sql(),
    "op6_substring_dedup": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_source_mix": OP13_SQL,
}
