import os

import pytest
from oracle import same_rows

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "pf1_remove_self_loops", "so6_directedness", "g1_inverse_edges", "g4_undirected_bundle", "g10_stratified_split", "j11_node_roles", "ag3_row_pointers", "rw2_non_backtracking_walk",
    "rw5_restart_non_backtracking", "m5_heuristic_recall_ra", "m1_m2_filtered_mrr", "m8_w15_class_auc", "j6_l11_negatives", "it5_clustering", "it6_components", "fe1_z_scores", "ag10_over_splits", "src3_encoded_triples",
    "src3_three_files", "src4_inductive_files", "src5_five_files", "src6_fact_files", "src9_csv_graph", "g14_masks_by_nodes", "g20_message_graph", "pf5_link_prediction", "x6_run_summary", "x9_candidate_batches",
    "j3_steps_beside_records", "rw18_start_mix", "rw20_adaptive_budget", "rw22_coverage", "it1_queue_order", "it2_bfs_subsample", "it4_bounded_distance", "l10_shared_within_hops", "m16_metric_row",
    "w2_optimistic_ranks", "w3_top_k", "m4_full_pool_recall", "m6_sampled_recall", "l4_l6_pair_scores", "g12_random_masks", "ag17_masked_uniques",
    "rw10_prefix_resume", "rw9_dispatch", "rw19_start_mix", "rw19_batch_only", "it6_bridges", "it7_hub_pagerank", "fe7_quantile_grid_normal", "fe15_category_plan", "fe5_smoothed_features",
    "it11_relational_messages", "l10_structural_features_1", "snk5_bundle", "src10_array_masks", "st9_best_so_far", "st6_mixed_stream", "it3_batch_report", "so8_split_classes", "j14_cold_start", "gn11_conditioned_graph",
)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, name):
    from graphloom.plans import ORACLES, QUERIES

    same_rows(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_entry(spark):
    import __spark_entry__

    same_rows(__spark_entry__.entry(spark), __spark_entry__.oracle_sql()["m5_heuristic_recall_ra"], FOLDER)
