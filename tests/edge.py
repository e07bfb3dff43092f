"""The edge fixture of FIXTURES.md: tied times, several numbers in a session, a 24-hour gap."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trailmark import schemas

FLOW = "A"

# id, session, family, time, action, indicator, number, digit
EVENTS = [
    (1, "S1", "api", "2020-07-01 10:00:00", "X", None, None, None),
    (2, "S1", "msg", "2020-07-01 10:00:00", "Y", None, None, None),
    (3, "S1", "call", "2020-07-01 10:00:30", "ICALL_1", "ANSWER", "+18005550001", None),
    (4, "S2", "call", "2020-07-02 09:59:59", "ICALL_1", None, "+18005550001", None),
    (5, "S3", "call", "2020-07-02 11:00:00", "TRANSFER_33", "ANSWER", "+12125550002", None),
    (6, "S4", "call", "2020-07-02 12:00:00", "ICALL_1", "HANGUP", "Restricted", None),
    (7, "S5", "call", "2020-07-03 00:00:00", "ICALL_1", "ANSWER", "+12125550002", None),
    (8, "S5", "call", "2020-07-03 00:00:01.9", "ICALL_1", "HANGUP", "+18775550003", None),
    (9, "S6", "call", "2020-07-04 10:00:30", "ICALL_1", "ANSWER", "+18005550001", None),
    (10, "S6", "dtmf", "2020-07-04 10:00:31.5", "MENU_1", None, None, 2),
    (11, "S6", "call", "2020-07-04 10:01:00", "ICALL_2", "HANGUP", "+18005550001", None),
]


def edge_families(spark):
    """The fixture as five event families in the documented schemas."""
    schema = (
        "EventId long, SessionId string, family string, time string, ActionId string, "
        "CallAnswerIndicator string, CallingNumber string, DtmfInput long"
    )
    events = (
        spark.createDataFrame(EVENTS, schema)
        .withColumn("TimeStamp", F.to_timestamp("time"))
        .withColumn("CustomerId", F.lit("7"))
        .withColumn("FlowName", F.lit(FLOW))
        .withColumn("CallDuration", F.lit(60.0))
    )
    return {
        family: events.filter(F.col("family") == family).select("EventId", *schema.fieldNames())
        for family, schema in schemas.FAMILY_SCHEMAS.items()
    }


def at(day: int, clock: str = "00:00:00") -> dt.datetime:
    return dt.datetime.fromisoformat(f"2020-07-{day:02d} {clock}")
