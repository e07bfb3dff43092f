"""Physical plans: pushdown, pruning, shuffles."""

import re

import trailmark as tm
from contract.mapping import END, FLOWS, START, families
from tests.conftest import plan_of


def test_dates_reach_the_scan_and_columns_are_pruned(spark, small):
    events = tm.unify_events(families(spark, small))
    plan = plan_of(tm.filter_events(events, FLOWS, START, END).select("SessionId"))
    pushed = re.findall(r"PushedFilters: \[(.*)\]", plan)
    assert len(pushed) == 5
    assert all("GreaterThanOrEqual(ts,2024-01-03" in p for p in pushed)
    assert all("LessThan(ts,2024-01-29" in p for p in pushed)
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    assert all("event_id" not in s for s in schemas)
    assert sum("props" in s for s in schemas) <= 1


def test_one_shuffle_for_the_steps(spark, small):
    from trailmark.operators.steps import step_parts

    events = tm.filter_events(tm.unify_events(families(spark, small)), FLOWS, START, END)
    plan = plan_of(step_parts(events, None)[0])
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1
    assert len(re.findall(r"^\(\d+\) Window", plan, re.M)) == 1


def test_one_shuffle_for_the_paths(spark, small):
    from trailmark.operators.paths import paths_of

    events = tm.filter_events(tm.unify_events(families(spark, small)), FLOWS, START, END)
    plan = plan_of(paths_of(events, ["SessionId"], None))
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1
    assert "Window" not in plan


def test_top_paths_take_without_a_full_sort(spark, small):
    events = tm.unify_events(families(spark, small))
    plan = plan_of(tm.top_paths(events, FLOWS, START, END))
    assert "TakeOrderedAndProject" in plan
