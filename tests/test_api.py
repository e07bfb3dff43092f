import datetime as dt

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from contract.mapping import END, FLOWS, START, events_log
from tests.conftest import rows
from trailmark.functions.dates import as_date


@pytest.fixture(scope="module")
def events(spark, small):
    return events_log(spark, small).persist()


@pytest.fixture(scope="module")
def flow(events):
    return tm.Flow(events, "flow-1", START, dt.date(2024, 1, 28), include_tollfree=True)


def test_dates():
    day = dt.date(2024, 2, 3)
    assert as_date("2024-02-03") == as_date(day) == as_date(None, day) == day
    with pytest.raises(ValueError):
        as_date(None)
    with pytest.raises(TypeError):
        as_date(20240203)
    with pytest.raises(TypeError):
        as_date(day, "2024-02-03")
    with pytest.raises(TypeError):
        as_date(dt.datetime(2024, 2, 3))


def test_defaults(events):
    flow = tm.Flow(events, "flow-1")
    assert flow.start_date == dt.date(2020, 1, 1)
    assert flow.end_date == dt.date.today()
    assert flow.include_tollfree is False


def test_sequence(flow, events):
    assert rows(flow.sequence) == rows(tm.user_sequence(events, "flow-1", START, END))


def test_frame_window_is_strict(spark):
    times = ["2024-01-05 00:00:00", "2024-01-05 00:00:01", "2024-01-06 23:59:59",
             "2024-01-07 00:00:00"]
    steps = spark.createDataFrame([(t,) for t in times], "t string").select(
        F.to_timestamp("t").alias("time_event")
    )
    kept = tm.restrict_window(steps, "2024-01-05", "2024-01-07")
    assert [str(r.time_event) for r in kept.collect()] == times[1:3]
    assert tm.restrict_window(steps).count() == 4


def test_tollfree_toggle(flow):
    everyone = flow.user_sequence().count()
    flow.set_tollfree_toggle(False)
    assert {r[0] for r in flow.user_sequence().select("TollFreeNumber").distinct().collect()} == {
        "NonTollFree"
    }
    flow.set_tollfree_toggle(True)
    assert flow.user_sequence().count() == everyone


def test_date_at_percent(flow):
    first, last = flow.sequence.agg(F.min("time_event"), F.max("time_event")).first()
    assert flow.date_at_percent(0) == first.date()
    assert flow.date_at_percent(100) == last.date()
    assert flow.date_at_percent(50) == (first + (last - first) / 2).date()
    assert tm.date_at_percent(flow.sequence, 50).first().date == flow.date_at_percent(50)
    for wrong in (-1, 101):
        with pytest.raises(ValueError):
            flow.date_at_percent(wrong)
        with pytest.raises(ValueError):
            tm.date_at_percent(flow.sequence, wrong)


def test_graph(flow):
    nodes, links = flow.flow_graph()
    shown = tm.restrict_window(flow.sequence, flow.start_date, flow.end_date)
    with_next = shown.filter("event_name IS NOT NULL AND next_event IS NOT NULL")
    assert links.agg(F.sum("count")).first()[0] == with_next.count()
    labels = {r.node_id: r.label for r in nodes.collect()}
    for link in links.collect():
        assert labels[link.sourceID] == link.source
        assert labels[link.targetID] == link.target
    largest = links.agg(F.max("count")).first()[0]
    assert flow.links_over(largest).filter(F.col("count") < largest).count() == 0
    over = flow.links_over_percent(50).agg(F.min("count")).first()[0]
    assert over >= int(largest * 0.5)
    name = links.first().path_nickname
    colors = flow.highlight(name).groupBy("path_nickname", "color").count().collect()
    assert {r.color for r in colors if r.path_nickname == name} == {"#ed7953"}
    assert {r.color for r in flow.highlight(None).collect()} == {"#d3d3d3"}


def test_graph_with_sessions(flow):
    _, links = tm.flow_graph(flow.sequence, sessions=True)
    plain = tm.flow_graph(flow.sequence)[1]
    assert rows(links.select(plain.columns)) == rows(plain)
    assert links.filter("sessions < 1 OR sessions > count").count() == 0


def test_threshold_arguments(flow):
    links = tm.flow_links(flow.sequence)
    with pytest.raises(ValueError):
        tm.threshold_links(links)
    with pytest.raises(ValueError):
        tm.threshold_links(links, 1, 2)
    assert tm.threshold_links(links.limit(0), pct=10).count() == 0


def test_panels(flow):
    assert flow.daily_events().agg(F.sum("count")).first()[0] == flow.sequence.count()
    assert flow.top_paths(3).select("path_nickname").distinct().count() == 3
    classes = flow.callback_analysis().select("TollFreeNumber").distinct()
    assert {r[0] for r in classes.collect()} <= {"TollFree", "NonTollFree"}


def test_stored_flow(events, tmp_path):
    flow = tm.Flow(events, "flow-0", START, END, store=str(tmp_path / "flow"))
    assert rows(flow.sequence) == rows(tm.user_sequence(events, "flow-0", START, END))
    again = tm.Flow.from_sequence(flow.sequence, "flow-0")
    assert rows(again.sequence) == rows(flow.sequence)


def test_a_stored_sequence_is_reused(events, tmp_path):
    """One of the same flow and dates is read; others, and refreshed ones, are computed."""
    store = str(tmp_path / "flows")
    fewer = events.filter("EventId % 2 = 0")
    made = rows(tm.Flow(events, "flow-0", START, END, store=store).sequence)
    assert rows(tm.Flow(fewer, "flow-0", START, END, store=store).sequence) == made
    other = tm.Flow(events, "flow-0", START, "2024-01-15", store=store).sequence
    assert rows(other) == rows(tm.user_sequence(events, "flow-0", START, "2024-01-15"))
    fresh = tm.Flow(fewer, "flow-0", START, END, store=store, refresh=True).sequence
    assert rows(fresh) == rows(tm.user_sequence(fewer, "flow-0", START, END)) != made
    assert rows(tm.Flow(events, "flow-0", START, END, store=store).sequence) == rows(fresh)
    nothing = [tm.Flow(events, "none", START, END, store=store).sequence.count() for _ in range(2)]
    assert nothing == [0, 0]


def test_dashboard(events):
    sequence = tm.user_sequence(events, FLOWS, START, END).persist()
    frames = tm.dashboard_frames(sequence, (0, 100), include_tollfree=False, threshold_pct=20)
    assert frames.totals.agg(F.sum("count")).first()[0] == sequence.count()
    assert {r.color for r in frames.links.collect()} <= {"#ed7953", "#d3d3d3"}
    assert frames.nodes.count() > 0
    assert rows(frames.callbacks.select("TollFreeNumber").distinct()) == [("NonTollFree",)]
    assert frames.top_paths.select("path_nickname").distinct().count() <= 10


def test_dashboard_of_nothing(events):
    sequence = tm.user_sequence(events, "no such flow", START, END)
    assert sequence.count() == 0
    frames = tm.dashboard_frames(sequence)
    assert [getattr(frames, name).count() for name in vars(frames)] == [0] * 5
    assert tm.date_at_percent(sequence, 10).first()["date"] is None
    assert tm.dates_at_percents(sequence, 10, 90) == (None, None)


def test_unknown_scope(events):
    with pytest.raises(ValueError, match="scope"):
        tm.sessions_on_path(events, "1-Path_Freq_Rank", scope="some")


def test_panels_follow_the_dates_and_the_threshold(flow):
    try:
        dates = "2024-01-04", "2024-01-28"
        _, links = flow.flow_graph(*dates)
        shown = flow.user_sequence(*dates)
        assert rows(flow.callback_analysis()) == rows(tm.callback_trend(shown))
        assert rows(flow.top_paths()) == rows(tm.top_path_trend_from_sequence(shown, 10))
        over = flow.links_over(2)
        assert 0 < over.count() < links.count()
        assert flow.highlight("2-Path_Freq_Rank").count() == over.count()
        flow.set_tollfree_toggle(True)
        all_callers = tm.restrict_window(flow.sequence, *dates)
        assert rows(flow.top_paths()) == rows(tm.top_path_trend_from_sequence(all_callers, 10))
        assert flow.links_over_percent(50).count() == flow.highlight(None).count()
    finally:
        flow.set_tollfree_toggle(False)
        flow.path_highlight = "1-Path_Freq_Rank"
        flow.flow_graph()
