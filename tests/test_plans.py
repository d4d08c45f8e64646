"""Physical-plan properties of the registered queries (the scale contract, checked on sf0.001 plans)."""

import pytest

import __spark_entry__ as E
from outreach_spark.plans.registry import REGISTRY
from tests.conftest import SF_SMALL

KEYS = sorted(REGISTRY)


def plan_of(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_nested_loop_or_python(spark, key):
    p = plan_of(spark, key)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert bad not in p, f"{key}: {bad}"


def test_filters_reach_the_scan(spark):
    p = plan_of(spark, "followup_eligible")
    assert "PushedFilters: [IsNotNull(o_orderkey), IsNotNull(o_orderdate), LessThanOrEqual(o_orderdate" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in p


@pytest.mark.parametrize("key", ["scan_search_hits", "daily_send_cap", "warmup_cap"])
def test_per_group_top_n_is_limited_before_the_shuffle(spark, key):
    p = plan_of(spark, key)
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("key", ["top_leads", "lead_leaderboard", "activity_feed", "genre_performance", "scan_logs", "fill_to_target"])
def test_global_top_k_is_take_ordered(spark, key):
    assert "TakeOrderedAndProject" in plan_of(spark, key)


@pytest.mark.parametrize("key", ["first_per_email", "upsert_verifications", "mx_lookup", "classify_candidates"])
def test_keyed_first_wins_are_aggregates_not_windows(spark, key):
    p = plan_of(spark, key)
    assert "partial_min" in p or "partial_max" in p
    assert "Window [" not in p


TEXTS = ("body", "html", "book_description", "full_name", "snippet", "message", "_text", "plain")


@pytest.mark.parametrize("key", KEYS)
def test_no_texts_in_sorted_aggregates(spark, key):
    for line in plan_of(spark, key).splitlines():
        if "SortAggregate" in line:  # a choice among rows may carry narrow fields, never texts
            functions = line.split("functions=", 1)[1]
            assert not any(t in functions for t in TEXTS), line


@pytest.mark.parametrize("key, scans", [("bounce_rate", 2), ("export_contacts_main", 3), ("contact_subpage_links", 3), ("followup_eligible", 2)])
def test_inputs_are_read_as_often_as_needed(spark, key, scans):
    assert plan_of(spark, key).count("FileScan parquet") <= scans


def test_upserted_drafts_are_dealt_without_their_bodies(spark):
    p = plan_of(spark, "upsert_drafts")
    assert p.count("xxhash64(") == 2  # invitations and follow-ups: each is rendered once
    assert "length(" not in p.split("SortMergeJoin")[0] and p.count("length(invitation_body_html") >= 1  # sizes are taken below the joins
    assert "WindowGroupLimit" not in p


def test_drafts_are_stripped_once_and_phrases_skip_ahead(spark):
    p = plan_of(spark, "render_drafts")
    assert "trim(_text" not in p  # stripped where it is filled, not at every use
    assert "translate(" not in p and p.count("Contains(") <= 4  # blank lines and </body>; no phrase is tried at every position


def test_no_plan_depends_on_input_size(spark):
    for key in ("banned_phrases", "export_daily_summary", "lead_scores"):
        assert "REPARTITION_BY_NUM" not in plan_of(spark, key)
    from outreach_spark.plans.registry import REGISTRY

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256m")
        assert REGISTRY["lead_scores"][0](spark, SF_SMALL).count() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
