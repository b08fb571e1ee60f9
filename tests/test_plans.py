"""Physical plans: no pair-producing joins, pruned scans, no forced hints; nothing left behind."""

import pytest

import __spark_entry__ as entry

LIGHT = ["clean_catalog", "cleaning_audit", "describe_numeric", "region_breakdown", "top_places",
         "region_significance", "magnitude_histogram_by_class", "split_assignment", "feature_table",
         "sample_points", "within_distance_counts", "classification_report"]
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LIGHT)
def test_no_nested_loop_or_cartesian(spark, sf001, name):
    p = plan(entry.queries()[name](spark, sf001))
    assert not any(b in p for b in BAD), p


def test_flagship_prunes_and_broadcasts(spark, sf001):
    p = plan(entry.queries()["region_breakdown"](spark, sf001))
    assert "BroadcastHashJoin" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p
    assert "partial_count" in p  # map-side combine before the shuffle


@pytest.mark.parametrize("name", LIGHT)
def test_no_round_robin_shuffle(spark, sf001, name):
    assert "RoundRobinPartitioning" not in plan(entry.queries()[name](spark, sf001))


def test_no_forced_broadcast_of_places(spark, sf001):
    p = entry.queries()["region_breakdown"](spark, sf001)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in p and "UnresolvedHint" not in p


def test_no_table_is_left_after_the_run():
    """A run in a process of its own removes its folder when it ends."""
    import os
    import subprocess
    import sys
    import tempfile

    with tempfile.TemporaryDirectory() as shared:
        code = ("from faultline.session import get_spark; import __spark_entry__ as e\n"
                f"s = get_spark('local[2]', shuffle_partitions=2, extra={{'spark.checkpoint.dir': {shared!r}}})\n"
                "e.queries()['split_assignment'](s, '/root/testdata/sf0.001').count()\n"
                f"import os; assert any(f.startswith('tables-') for f in os.listdir({shared!r})); s.stop()")
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=300)
        # Spark's own (empty) checkpoint folder stays
        assert not [f for f in os.listdir(shared) if f.startswith("tables-")]
