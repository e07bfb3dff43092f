"""The unified event log: labels, union of the families, and its filters."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import step_label
from trailmark.functions.dates import as_date, as_list

# The transfer action dropped from call events; the caller id of hidden numbers.
TRANSFER_ACTION = "TRANSFER_33"
HIDDEN_CALLER = "Restricted"

FAMILIES = ("api", "call", "dtmf", "msg", "nlp")
EVENT_ID = "EventId"


def unify_events(
    families: Mapping[str, DataFrame], drop_actions: Iterable[str] = (TRANSFER_ACTION,)
) -> DataFrame:
    """One log from the five families, with each event labelled.

    `ActionId` becomes the step label. `CallingNumber` is null outside call events. An `EventId`
    column, where the families have one, is kept to order events of equal time. Call events whose
    action is in `drop_actions`, or null, are left out; pass () to keep all.
    """
    parts = []
    for family in FAMILIES:
        events = families[family]
        if family == "call":
            for action in drop_actions:
                events = events.filter(F.col("ActionId") != action)
            number = F.col("CallingNumber")
        else:
            number = F.lit(None).cast("string")
        parts.append(
            events.select(
                "SessionId",
                "TimeStamp",
                step_label(family).alias("ActionId"),
                number.alias("CallingNumber"),
                "CustomerId",
                "FlowName",
                *[name for name in events.columns if name == EVENT_ID],
            )
        )
    return functools.reduce(DataFrame.unionByName, parts)


def tie_break(events: DataFrame) -> str:
    """The column that orders events of equal time."""
    return EVENT_ID if EVENT_ID in events.columns else "ActionId"


def event_order(events: DataFrame) -> list[Column]:
    return [F.col("TimeStamp"), F.col(tie_break(events))]


def within_dates(column: str, start=None, end=None, start_exclusive: bool = False) -> Column:
    """Calendar-date range of a timestamp; inclusive unless `start_exclusive`.

    Catalyst turns the date comparison into a timestamp range and pushes it into the scan.
    """
    day = F.to_date(column)
    condition = F.lit(True)
    if start is not None:
        first = F.lit(as_date(start))
        condition = condition & (day > first if start_exclusive else day >= first)
    if end is not None:
        condition = condition & (day <= F.lit(as_date(end)))
    return condition


def filter_events(
    events: DataFrame,
    flows=None,
    start=None,
    end=None,
    customers=None,
    start_exclusive: bool = False,
) -> DataFrame:
    """Events of the given flows, dates and customers; an argument left out does not filter."""
    kept = events.filter(within_dates("TimeStamp", start, end, start_exclusive))
    if flows is not None:
        kept = kept.filter(F.col("FlowName").isin(as_list(flows)))
    if customers is not None:
        kept = kept.filter(F.col("CustomerId").isin(as_list(customers)))
    return kept


def known_caller() -> Column:
    """Number present and not hidden."""
    return F.col("CallingNumber").isNotNull() & (F.col("CallingNumber") != HIDDEN_CALLER)


def call_events(calls: DataFrame, flows=None, start=None, end=None) -> DataFrame:
    """Raw call events with a known caller, for one or more flows and a date range."""
    return filter_events(calls, flows, start, end).filter(known_caller())


def available_flows(exits: DataFrame) -> DataFrame:
    """Distinct flow names, in order."""
    return exits.select("FlowName").distinct().orderBy("FlowName")
