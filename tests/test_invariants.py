"""What must hold for any input, on the driver's tables."""

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from contract.mapping import END, FLOWS, START, conversation_events, events_log


@pytest.fixture(scope="module")
def kept(spark, small):
    return tm.filter_events(events_log(spark, small), FLOWS, START, END).persist()


@pytest.fixture(scope="module")
def sequence(spark, small):
    return tm.user_sequence(events_log(spark, small), FLOWS, START, END).persist()


def test_steps_are_numbered_without_gaps(kept):
    steps = tm.step_metrics(kept)
    gaps = (
        steps.groupBy("SessionId")
        .agg(F.max("rank_event").alias("m"), F.count_distinct("rank_event").alias("d"),
             F.count("*").alias("n"))
        .filter("m != d OR d != n")
    )
    assert gaps.count() == 0


def test_links_add_up_to_steps_with_a_next(sequence):
    total = tm.flow_links(sequence).agg(F.sum("count")).first()[0]
    assert total == sequence.filter("event_name IS NOT NULL AND next_event IS NOT NULL").count()


def test_path_counts_add_up_to_sessions(kept):
    paths = tm.session_paths(kept)
    total = tm.path_frequencies(paths).agg(F.sum("count")).first()[0]
    assert total == kept.select("SessionId").distinct().count()


def test_first_calls_have_no_last_call(kept):
    calls = tm.callbacks(tm.caller_sessions(kept))
    wrong = calls.filter((F.col("callback_instance") == 1) != F.col("days_since_last_call").isNull())
    assert wrong.count() == 0


def test_path_length_is_steps_less_one(spark, small):
    from trailmark.functions import path_length

    chats = conversation_events(spark, small)
    lengths = tm.session_paths(chats).select("SessionId", path_length(F.col("Path")).alias("n"))
    steps = chats.groupBy("SessionId").count()
    assert lengths.join(steps, "SessionId").filter("n != count - 1").count() == 0
    assert lengths.count() == steps.count()


def test_periods_are_sequenced_apart(kept):
    links = tm.compare_periods(
        kept, FLOWS, {"a": (START, "2024-01-10"), "b": ("2024-01-11", END), "all": (START, END)}
    )
    totals = {r.period: r.n for r in links.groupBy("period").agg(F.sum("count").alias("n")).collect()}
    # Sessions do not cross midnight here, so the halves make the whole.
    assert totals["a"] + totals["b"] == totals["all"]


def test_approximate_sessions(spark, small):
    from contract.mapping import exit_events

    exits = exit_events(spark, small)
    exact = {(r.date, r.FlowName): r["count"] for r in tm.daily_sessions(exits).collect()}
    close = tm.daily_sessions(exits, approximate=True).collect()
    assert all(abs(r["count"] - exact[r.date, r.FlowName]) <= 2 for r in close)
