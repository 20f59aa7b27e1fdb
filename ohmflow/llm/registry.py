"""Queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, fill_middle, html_extract, license_scan, line_dedup, near_dedup, packing, quote_link, secret_scan, token_align, topk, toxicity, url_filter

QUERIES = {
    "op1_minhash_odd_sketch": near_dedup.query,
    "op2_url_segmentation": url_filter.query,
    "op3_quotation_linking": quote_link.query,
    "op4_line_winnowing": line_dedup.query,
    "op5_exact_topk_pivots": topk.query,
    "op6_secret_forest": secret_scan.query,
    "op7_counterfactual_toxicity": toxicity.query,
    "op8_license_similarity_join": license_scan.query,
    "op9_power_of_two_packing": packing.query,
    "op10_spaced_seed_decontamination": decontam.query,
    "op11_boosted_node_extraction": html_extract.query,
    "op12_fragment_alignment": token_align.query,
    "op13_skip_list_fill_in_middle": fill_middle.query,
}

SQL = {
    "op1_minhash_odd_sketch": near_dedup.SQL,
    "op3_quotation_linking": quote_link.SQL,
    "op5_exact_topk_pivots": topk.SQL,
    "op8_license_similarity_join": license_scan.SQL,
    "op10_spaced_seed_decontamination": decontam.SQL,
    "op13_skip_list_fill_in_middle": fill_middle.SQL,
}
