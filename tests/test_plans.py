"""What the plans of the core must look like, and the driver contract."""

import re

import pytest

import __spark_entry__ as entry
from stylematch import workload


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


CORE = [
    "additive_top3", "gated_top3_nonzero", "weighted_scaled_top3", "precision_at_k_per_user", "weight_grid_all_users",
    "score_rating_correlation", "batch_scaled_first_users", "document_tf_idf", "rare_value_fixpoint", "keyed_upsert",
    "enriched_outfits", "scaled_per_group", "filled_with_modes", "result_cards",
]


@pytest.mark.parametrize("name", CORE)
def test_core_plans(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize("name", ["weighted_scaled_top3", "precision_at_k_per_user", "scaled_per_group", "top5_rated_per_user"])
def test_no_single_partition_exchange(spark, sf, name):
    """Only the vocabulary of accords is gathered in one place."""
    lines = plan_of(entry.queries()[name](spark, sf)).splitlines()
    for line, below in zip(lines, lines[1:]):
        assert "Exchange SinglePartition" not in line or "partial_collect_list(accord#" in below


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    plan = plan_of(entry.queries()["top5_rated_per_user"](spark, sf))
    assert re.search(r"WindowGroupLimit.*Final", plan) and re.search(r"WindowGroupLimit.*Partial", plan)


def test_only_needed_columns_are_read(spark, sf):
    plan = plan_of(entry.queries()["weighted_scaled_top3"](spark, sf))
    users = re.search(r"customer\.parquet\], PartitionFilters.*?ReadSchema: (struct<[^>]*>)", plan)
    assert users and users.group(1) == "struct<c_custkey:bigint>"
    sides = plan_of(entry.queries()["id_range"](spark, sf))
    assert "GreaterThanOrEqual(c_custkey,1001)" in sides


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    assert rows.columns == ["user_id", "user_style", "item_id", "style_score", "color_score", "season_score", "myscore", "rank"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(workload.COVERS) == set(workload.QUERIES)
    without = set(workload.QUERIES) - set(workload.oracles())
    assert without == {
        "sampled_images", "vector_clusters", "cluster_sweep", "note_clusters", "two_piece_style_report",
        "one_piece_style_report", "predicted_user_styles", "stacked_style_report", "random_users",
    }


def test_queries_stay_without_the_corpus_modules(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError(f"No module named {name}")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    assert set(entry.queries()) == set(workload.QUERIES)
    assert set(entry.oracle_sql()) == set(workload.oracles())


def test_all_operators_of_the_inventory_are_covered():
    wanted = (
        [f"S{i}" for i in range(1, 13)] + [f"P{i}" for i in range(1, 22)] + [f"J{i}" for i in range(1, 13)]
        + [f"A{i}" for i in range(1, 19)] + [f"W{i}" for i in range(1, 9)] + [f"O{i}" for i in range(1, 8)]
        + [f"U{i}" for i in range(1, 6)] + [f"F{i}" for i in range(1, 31)] + [f"M{i}" for i in range(1, 20)]
        + [f"R{i}" for i in range(1, 6)] + [f"E{i}" for i in range(1, 9)] + [f"T{i}" for i in range(1, 4)]
    )
    covered = {c for ids in workload.COVERS.values() for c in ids}
    assert set(wanted) <= covered, sorted(set(wanted) - covered)
