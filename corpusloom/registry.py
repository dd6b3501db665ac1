"""Operation ids and the functions that carry them out, so that coverage can be tested."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: id -> module:function[, arguments put in]
OPERATIONS: dict[str, tuple[str, dict]] = {
    "docx_text_hygiene_scan": ("corpusloom.operators.hygiene:scan", {}),
    "docx_text_hygiene_fix": ("corpusloom.operators.hygiene:fix", {}),
    "docx_nonprinting_clean": ("corpusloom.sources.rewrite:transform", {"steps": ("soft_hyphens",)}),
    "docx_comma_lowercase": ("corpusloom.operators.hygiene:lowercase_after_comma", {}),
    "morph_replace": ("corpusloom.operators.morph:replace_in", {}),
    "docx_audit_processor": ("corpusloom.operators.rules:plan", {}),
    "docx_audit_strip_anchors": ("corpusloom.operators.rules:strip_anchors", {}),
    "docx_deep_hygiene": ("corpusloom.plans.pipelines:deep_hygiene", {}),
    "docx_anomaly_scan": ("corpusloom.operators.inspector:inspect", {}),
    "docx_anomaly_correct": ("corpusloom.sources.rewrite:transform", {"steps": ("blank_paragraphs", "relax_tables", "cell_margins")}),
    "docx_style_apply": ("corpusloom.operators.restyle:assign", {}),
    "docx_caption_renumber": ("corpusloom.operators.restyle:renumbered", {}),
    "docx_morph_replace": ("corpusloom.sources.rewrite:edit_texts", {}),
    "docx_quality_gate": ("corpusloom.operators.findings:package_gate", {"stage": "before"}),
    "docx_hard_gate": ("corpusloom.operators.findings:package_gate", {"stage": "before"}),
    "docx_oneclick": ("corpusloom.plans.pipelines:finalize", {}),
    "docx_accept_changes": ("corpusloom.sources.rewrite:transform", {"steps": ("accept_changes",)}),
    "docx_strip_comments": ("corpusloom.sources.rewrite:transform", {"steps": ("strip_comments",)}),
    "docx_finalize_black": ("corpusloom.sources.rewrite:transform", {"steps": ("black",)}),
    "docx_clean": ("corpusloom.sources.rewrite:transform", {"steps": ("strip_comments", "accept_changes", "tidy")}),
    "docx_xml_cleanup": ("corpusloom.sources.rewrite:transform", {"steps": ("tidy",)}),
    "apply_standard": ("corpusloom.sources.rewrite:transform", {"steps": ("page_margins",)}),
    "table_cell_margins": ("corpusloom.sources.rewrite:transform", {"steps": ("cell_margins",)}),
    "docx_style_scan": ("corpusloom.operators.paragraphs:kind", {}),
    "docx_near_dupes": ("corpusloom.operators.similarity:similar_pairs", {}),
    "docx_pair_diff": ("corpusloom.operators.alignment:section_changes", {}),
    "docx_split": ("corpusloom.operators.structure:numbered_sections", {}),
    "docx_split_chunks": ("corpusloom.operators.chunks:plan", {}),
    "docx_split_top_level_sections": ("corpusloom.operators.structure:sections", {}),
    "docx_extract_media": ("corpusloom.sources.ooxml:media", {}),
    "docx_extract_tables": ("corpusloom.sources.ooxml:tables", {}),
    "docx_table_stitcher": ("corpusloom.operators.tables:stitch_tables", {}),
    "docx_table_stitcher_running_header": ("corpusloom.operators.tables:running_tables", {}),
    "docx_table_unify_safe": ("corpusloom.operators.tables:grouped_tables", {"mode": "safe"}),
    "docx_table_unify_width_only": ("corpusloom.operators.tables:grouped_tables", {"mode": "width"}),
    "docx_table_unify_merged_sections": ("corpusloom.operators.tables:grouped_tables", {"mode": "balanced"}),
    "docx_table_optimize_widths": ("corpusloom.operators.tables:widths", {}),
    "docx_table_fit_to_margins": ("corpusloom.operators.paragraphs:fit_gate", {}),
    "md_tables_to_xlsx": ("corpusloom.operators.tables:markdown_rows", {}),
    "tabular_reconcile": ("corpusloom.operators.reconcile:reconcile", {}),
    "xlsx_values_diff": ("corpusloom.operators.reconcile:diff_cells", {}),
    "xlsx_remove_empty_rows": ("corpusloom.operators.reconcile:drop_empty_rows", {}),
}

#: What needs an office program or only draws reports.
OUT_OF_SCOPE = {"docx_document_tables_unifier": "rewrites the look of whole documents; its tests are in inspector and tables", "docx_word_compare": "drives a word processor; its chunk plan is docx_split_chunks", "docx_merge": "drives a word processor", "docx_style_fix": "writes styles of a reference document", "docx_table_adapt_orientation": "page layout of single tables"}


def resolve(name: str) -> Callable:
    module, function = OPERATIONS[name][0].split(":")
    return getattr(importlib.import_module(module), function)
