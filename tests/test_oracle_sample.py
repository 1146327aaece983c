"""A sample of registered queries against their SQL twins; ``python -m tests.oracle`` runs all."""

import pytest

from corpuskit.catalog import all_queries, all_sql
from tests.conftest import SF
from tests.oracle import compare

SAMPLE = (
    "F2_slugs", "F7_dictionary_tags", "F11_code_mentions", "F15_row_cells", "F22_references", "F28_comment_above", "P7_metadata_predicates",
    "S1_source_file_scan", "S2_package_manifests", "S10_session_log_scan", "K3_collection_routing", "K4_keyed_upsert", "K5_resumable_append",
    "K6_delete_rows", "W1_heading_carry_forward", "W4_caption_attach", "W6_snippet_groups", "W7_table_groups", "W9_prose_packing", "W10_line_splitting",
    "W14_conversation_memory", "W17_time_since_previous", "X1_definition_extraction", "X2_import_extraction", "X3_note_extraction", "X6_cross_reference_map",
    "X8_manual_link_job", "J2_clone_references", "J4_set_similarity_join", "J6_substring_join", "J8_module_prefix_join", "J17_index_drift", "E8_clone_repo_pairs",
    "E16_health_score", "R1_multi_collection_retrieval", "R2_filtered_budgeted_search", "R3_symbol_lookup", "R10_bm25_search", "R14_citation_validation",
    "R16_context_assembly", "N2_module_notes", "N5_chapter_notes", "Q3_token_ranges", "Z2_log_follow", "Z7_activity_windows",
)


@pytest.mark.parametrize("key", SAMPLE)
def test_query_matches_sql(spark, con, key):
    ok, message = compare(spark, con, key, all_queries()[key], all_sql()[key], SF)
    assert ok, message


def test_every_operator_id_has_a_query():
    counts = dict(S=11, K=9, P=17, F=32, J=24, E=32, W=17, T=9, U=6, X=13, R=17, Z=8, V=8, Q=11, N=9)
    have = {key.split("_")[0] for key in all_queries()}
    assert not [f"{p}{i}" for p, n in counts.items() for i in range(1, n + 1) if f"{p}{i}" not in have]
