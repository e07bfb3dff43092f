"""Column contracts of the event families, exit events and the enriched sequence."""

from pyspark.sql import types as T

_BASE = [
    T.StructField("SessionId", T.StringType()),
    T.StructField("TimeStamp", T.TimestampType()),
    T.StructField("ActionId", T.StringType()),
    T.StructField("CustomerId", T.StringType()),
    T.StructField("FlowName", T.StringType()),
]

BASE_EVENT = T.StructType(_BASE)
CALL_EVENT = T.StructType(
    _BASE
    + [
        T.StructField("CallAnswerIndicator", T.StringType()),
        T.StructField("CallingNumber", T.StringType()),
        T.StructField("CallDuration", T.DoubleType()),
    ]
)
KEYPRESS_EVENT = T.StructType(_BASE + [T.StructField("DtmfInput", T.LongType())])
EXIT_EVENT = T.StructType(
    [
        T.StructField("SessionId", T.StringType()),
        T.StructField("TimeStamp", T.TimestampType()),
        T.StructField("FlowName", T.StringType()),
        T.StructField("Path", T.StringType()),
    ]
)

FAMILY_SCHEMAS = {
    "api": BASE_EVENT,
    "call": CALL_EVENT,
    "dtmf": KEYPRESS_EVENT,
    "msg": BASE_EVENT,
    "nlp": BASE_EVENT,
}

# The enriched sequence: one row per step, times the numbers seen in its session.
SEQUENCE = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("time_event", T.TimestampType()),
        T.StructField("date", T.DateType()),
        T.StructField("rank_event", T.LongType()),
        T.StructField("next_event", T.StringType()),
        T.StructField("FlowName", T.StringType()),
        T.StructField("time_from_start", T.LongType()),
        T.StructField("time_to_next", T.LongType()),
        T.StructField("path_nickname", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("CallingNumber", T.StringType()),
        T.StructField("callback_instance", T.LongType()),
        T.StructField("days_since_last_call", T.LongType()),
        T.StructField("session_duration", T.LongType()),
        T.StructField("previous_duration", T.LongType()),
        T.StructField("TollFreeNumber", T.StringType()),
    ]
)
