"""Expected values of the edge fixture, at an ordinary and at a tiny limit for heavy groups."""

import pytest
from pyspark.sql import functions as F

import trailmark as tm
from tests.conftest import rows
from tests.edge import FLOW, edge_families

LIMITS = [1_000_000, 1]


@pytest.fixture(scope="module")
def events(spark):
    return tm.unify_events(edge_families(spark)).persist()


@pytest.fixture(scope="module", params=LIMITS)
def sequence(request, events):
    made = tm.user_sequence(events, FLOW, "2020-07-01", "2020-07-31", group_rows=request.param)
    return made.persist()


def test_labels_and_transfer(events):
    labels = {row.EventId: row.ActionId for row in events.collect()}
    assert labels[1] == "X~~API_EVENT"
    assert labels[3] == "ICALL_1~~CALL_EVENT:ANSWER"
    assert labels[4] is None
    assert labels[10] == "MENU_1~~2-dtmf"
    assert 5 not in labels


@pytest.mark.parametrize("limit", LIMITS)
def test_paths_and_ranks(events, limit):
    paths = tm.session_paths(events, group_rows=limit)
    ranks = tm.rank_paths(tm.path_frequencies(paths))
    found = {row.SessionId: row.Path for row in paths.collect()}
    assert found == {
        "S1": "X~~API_EVENT;Y~~MSG_EVENT;ICALL_1~~CALL_EVENT:ANSWER",
        "S2": None,
        "S4": "ICALL_1~~CALL_EVENT:HANGUP",
        "S5": "ICALL_1~~CALL_EVENT:ANSWER;ICALL_1~~CALL_EVENT:HANGUP",
        "S6": "ICALL_1~~CALL_EVENT:ANSWER;MENU_1~~2-dtmf;ICALL_2~~CALL_EVENT:HANGUP",
    }
    order = {row.Path: (row["rank"], row.nickname) for row in ranks.collect()}
    assert order[found["S5"]] == (1, "1-Path_Freq_Rank")
    assert [order[found[s]][0] for s in ("S6", "S4", "S1", "S2")] == [2, 3, 4, 5]


@pytest.mark.parametrize("limit", LIMITS)
def test_callbacks(events, limit):
    calls = tm.callbacks(tm.caller_sessions(events), group_rows=limit)
    found = calls.select(
        "CallingNumber",
        "SessionId",
        "TollFreeNumber",
        "callback_instance",
        "days_since_last_call",
        "session_duration",
        "previous_duration",
    )
    assert rows(found) == [
        ("+12125550002", "S5", "NonTollFree", 1, None, 0, None),
        ("+18005550001", "S1", "TollFree", 1, None, 0, None),
        ("+18005550001", "S2", "TollFree", 2, 0, 0, 0),
        ("+18005550001", "S6", "TollFree", 3, 2, 30, 0),
        ("+18775550003", "S5", "TollFree", 1, None, 0, None),
    ]


def test_sequence(sequence):
    assert {r.user_id: r["count"] for r in sequence.groupBy("user_id").count().collect()} == {
        "S1": 3,
        "S4": 1,
        "S5": 4,
        "S6": 3,
    }
    steps = sequence.filter(F.col("user_id") == "S6").orderBy("rank_event").collect()
    assert [r.rank_event for r in steps] == [1, 2, 3]
    assert [r.time_from_start for r in steps] == [0, 1, 30]
    assert [r.time_to_next for r in steps] == [1, 28, None]
    first = sequence.filter("user_id = 'S5' AND rank_event = 1").first()
    assert first.time_to_next == 1
    hidden = sequence.filter("user_id = 'S4'").first()
    assert hidden.CallingNumber is None and hidden.TollFreeNumber is None


def test_sequence_columns(sequence):
    assert sequence.columns == tm.schemas.SEQUENCE.fieldNames()
    assert [t for _, t in sequence.dtypes] == [
        f.dataType.simpleString() for f in tm.schemas.SEQUENCE
    ]


def test_links(sequence):
    links = tm.flow_links(sequence, by=(), sessions=True)
    answer, hangup = "ICALL_1~~CALL_EVENT:ANSWER", "ICALL_1~~CALL_EVENT:HANGUP"
    assert rows(links) == sorted(
        [
            (answer, hangup, 2, 0.0, 1),
            (answer, "MENU_1~~2-dtmf", 1, 0.0, 1),
            ("MENU_1~~2-dtmf", "ICALL_2~~CALL_EVENT:HANGUP", 1, 1.0, 1),
            ("X~~API_EVENT", "Y~~MSG_EVENT", 1, 0.0, 1),
            ("Y~~MSG_EVENT", answer, 1, 0.0, 1),
        ],
        key=repr,
    )


def test_nodes(sequence):
    nodes = {r.label: (r.node_id, r.position) for r in tm.flow_nodes(sequence).collect()}
    assert sorted(i for i, _ in nodes.values()) == list(range(len(nodes)))
    # Twice first in S5, once in S6, third in S1.
    assert nodes["ICALL_1~~CALL_EVENT:ANSWER"][1] == 1
    assert nodes["ICALL_2~~CALL_EVENT:HANGUP"][1] == 3
    order = [p for _, p in sorted(nodes.values())]
    assert order == sorted(order)


def test_target_only_node_comes_last(spark):
    schema = "event_name string, next_event string, rank_event long"
    moves = spark.createDataFrame([("b", "z", 5), ("a", "z", 1), ("a", "z", 1)], schema)
    assert rows(tm.flow_nodes(moves)) == [(0, "a", 1), (1, "b", 5), (2, "z", 1)]


def test_lowest_of_several_modes(spark):
    schema = "event_name string, next_event string, rank_event long"
    moves = spark.createDataFrame([("a", None, 4), ("a", None, 2), ("b", None, 3)], schema)
    assert rows(tm.flow_nodes(moves)) == [(0, "a", 2), (1, "b", 3)]


def test_repeat_calls_of_the_fixture(spark):
    calls = tm.call_events(edge_families(spark)["call"])
    stats = {
        (str(r.date), r.TollFreeNumber): (r["count"], r.mean_days_between_calls)
        for r in tm.repeat_call_stats(calls).collect()
    }
    # S1 before S2 (0 days) and before both calls of S6 (3 days, 3 days less one 30 s apart).
    assert stats == {
        ("2020-07-01", True): (3, pytest.approx((0 + 3 + 3) / 3)),
        ("2020-07-02", True): (2, pytest.approx(2.0)),
        ("2020-07-02", False): (1, pytest.approx(0.0)),
    }
