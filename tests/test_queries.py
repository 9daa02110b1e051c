"""A cross-section of registered queries against their SQL twins (all of them: tests/compare.py)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import compare as H  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["S1_asof_scan", "S5_forum_scan_both", "P11_clip_winsorise", "J1_window_assign", "J9_dense_grid", "J10_first_seen_stories",
         "A2_last_non_null_per_column", "A12_representative_features", "A22_conditional_table", "W5_rolling_beta", "W10_abnormal_count_ewm",
         "W15_macd", "W16_rsi", "W24_sequence_windows", "K4_stratified_sample", "K8_universe_draws", "F6_cluster_key", "T3_novelty",
         "T4_tfidf_uni", "D2_k_rule_scores", "R1_tercile_scaling", "E2_extended_metrics", "E13_block_bootstrap_reps", "B2_full_panel",
         "B3_universe_panels", "B5_exploratory_panel", "X5_row_decomposition", "F9_company_mentions", "A39_spearman", "D7_decomp_rule",
         "D8_objective_selects_k", "M10_residual_blend", "B9_variant_errors", "S18_learned_save_restore"]


@pytest.fixture(scope="module")
def both():
    import __spark_entry__ as entry
    return entry.queries(), entry.oracle_sql(), H.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, both, name):
    queries, oracles, con = both
    status, n, note = H.compare(spark, con, name, queries[name], oracles[name], SF)
    assert status == "OK", f"{status} {note}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_point_in_time_equality(spark, both):
    rows = both[0]["E18_point_in_time_equality"](spark, SF).collect()
    assert len(rows) == 23 and all(r["violations"] == r["unmatched"] == r["null_mismatch"] == 0 for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_known_slice_values(spark):
    """Best k and score of the gap rule on the smallest tables."""
    import __spark_entry__ as entry
    from cutline.plans.rules import best_k
    r = best_k(entry.entry(spark)).first()
    assert r["k"] == 0.5 and round(r["score"], 4) == 0.4744


def test_every_oracle_has_a_query(both):
    assert set(both[1]) <= set(both[0])
