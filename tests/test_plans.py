"""Plan-shape checks: the scale properties the operators are designed for."""

import re

import pytest

from issuelens.operators.consolidate import consolidate
from issuelens.operators.features import dedup_keep_last
from issuelens.plans.consolidate_q import _sources
from tests.conftest import SF_SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    import __spark_entry__ as E

    return E.queries(), E.oracle_sql()


def test_top1_per_key_combines_map_side(spark):
    o, f = _sources(spark, SF_SMALL)
    p = plan_of(consolidate(o, f))
    assert "partial_min_by" in p  # duplicates collapse before the shuffle


def test_per_repo_cap_limits_before_exchange(spark, qs):
    p = plan_of(qs[0]["collect_issues"](spark, SF_SMALL))
    assert re.search(r"WindowGroupLimit .*Partial", p)
    assert "PushedFilters: [IsNull(pull_request)" in p or "isnull(pull_request" in p


def test_team_lookup_is_broadcast(spark, qs):
    p = plan_of(qs[0]["team_routing"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_running_count_broadcasts_only_the_carry(spark, qs):
    df = qs[0]["user_history"](spark, SF_SMALL)
    p = plan_of(df)
    assert "BroadcastExchange" in p and "_car_" in p  # the bounded carry table
    assert "hashpartitioning(author" in p and "_slice" in p  # hot users are cut into slices


def test_scan_reads_only_needed_columns(spark, qs):
    p = plan_of(qs[0]["top_labels"](spark, SF_SMALL))
    scan = [line for line in p.split("\n") if "FileScan parquet" in line][0]
    assert "text" not in scan.split("ReadSchema")[-1]  # the wide text is never read for label counts


def test_no_python_udfs_in_batch_plans(spark, qs):
    queries, oracle = qs
    for k in ["heuristic_score", "issue_features", "webhook_triage", "relabel_history", "consolidate_summary",
              "dashboard_kpis", "feature_scaling", "eval_weighted"]:
        p = plan_of(queries[k](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, k


def test_counts_over_the_best_row_shuffle_no_body(spark):
    o, f = _sources(spark, SF_SMALL)
    p = plan_of(consolidate(o, f, payload=["source"]))
    picks = [line for line in p.split("\n") if "partial_min_by" in line]
    assert picks and all("sha2(" in line or "body" not in line for line in picks)
    rows = spark.createDataFrame([(1, "t", "b", 2), (2, "t", "b", 3)], "number long, title string, body string, comments long")
    narrow = dedup_keep_last(rows, "number", payload=["comments"])
    assert narrow.columns == ["comments"] and [r.comments for r in narrow.collect()] == [3]
    picks = [line for line in plan_of(narrow).split("\n") if "min_by" in line]
    assert picks and not any("body#" in line.replace("_k_body#", "") for line in picks)
