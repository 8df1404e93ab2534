"""The opN_ queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import alignment, chat, decontaminate, filter_audit, html_text, minhash, mixing, quality, revisits, sharding, suffix_array, suffix_tree, token_files

QUERIES = {
    "op1_perspectives": chat.op1_perspectives,
    "op2_linear_grouping": suffix_array.op2_linear_grouping,
    "op3_style_tree": html_text.op3_style_tree,
    "op4_hashed_lr": quality.op4_hashed_lr,
    "op5_prefix_trees": suffix_tree.op5_prefix_trees,
    "op6_revisits": revisits.op6_revisits,
    "op7_elias_fano": token_files.op7_elias_fano,
    "op8_circulant": minhash.op8_circulant,
    "op9_suffix_arrays": decontaminate.op9_suffix_arrays,
    "op10_water_filling": mixing.op10_water_filling,
    "op11_filter_cube": filter_audit.op11_filter_cube,
    "op12_interval_index": alignment.op12_interval_index,
    "op13_feistel": sharding.op13_feistel,
}
SQL = {
    "op1_perspectives": chat.SQL,
    "op2_linear_grouping": suffix_array.SQL,
    "op5_prefix_trees": suffix_tree.SQL,
    "op6_revisits": revisits.SQL,
    "op8_circulant": minhash.SQL,
    "op9_suffix_arrays": decontaminate.SQL,
    "op10_water_filling": mixing.SQL,
    "op11_filter_cube": filter_audit.SQL,
    "op13_feistel": sharding.SQL,
}
