"""Physical plans: what must and must not be in them."""

import pytest

from quarrycast.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


STREAMS = {"T1_T3_alert_stream", "T2_insert_stream"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - STREAMS))
def test_no_cross_joins(spark, data, name):
    text = plan(registry.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["N4_norm_company", "N5_norm_title", "N6_posted_week", "N7_parse_instant", "N9_clean", "X4_company_name", "X6_confidence", "M1_kind", "M5_subject_company", "R4_domain_matches", "N2a_found_away_from", "D2_J18_canonical", "W2_diagnosis"])
def test_stays_in_the_jvm(spark, data, name):
    text = plan(registry.QUERIES[name](spark, data))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_top_k_and_pruned_scan(spark, data):
    text = plan(registry.QUERIES["O6_budget"](spark, data))
    assert "TakeOrderedAndProject" in text
    text = plan(registry.QUERIES["J1_jobs_company"](spark, data))
    assert "jd_text" not in text
    text = plan(registry.QUERIES["F7_pollable"](spark, data))
    assert "EqualTo(watchlist_enabled,1)" in text and "In(ats, [" in text


def test_changes_shuffle_hashes_only(spark, data):
    """One exchange for the sides of a key, combined before it, one for the keys, and no text in either."""
    from quarrycast.operators import snapshots
    from quarrycast.runtime import table

    rows = table(spark, data, "job_snapshots", "snapshot_no", "source", "external_id", "title", "jd_text")
    df = snapshots.changes(rows, "snapshot_no", ["source"], "external_id", ["title", "jd_text"], ["jd_text"])
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 2
    sides = text[: text.rindex("Exchange hashpartitioning")]
    assert "title" not in sides and "jd_text" not in sides


def test_poll_rank_is_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(registry.QUERIES["W1_last_polls"](spark, data))
