"""The same results in plain SQL for DuckDB, written the direct way: windows over every event,
pairs by self-join, constant tables."""

from __future__ import annotations

# Mapping of the events table, as in FIXTURES.md.
_RAW = """
raw AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS kk
  FROM events
),
labelled AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS SessionId,
         ts AS "TimeStamp",
         CASE event_type
           WHEN 'click' THEN 'EXTCALL_51'
           WHEN 'view' THEN 'MSG_1'
           WHEN 'purchase' THEN 'NLP_1'
           WHEN 'signup' THEN 'MENU_TREE_' || CAST(kk % 2 AS VARCHAR)
           WHEN 'error' THEN
             CASE WHEN kk % 33 = 0 THEN 'TRANSFER_33' ELSE 'ICALL_' || CAST(kk % 2 AS VARCHAR) END
         END AS action,
         event_type,
         CASE WHEN kk % 10 = 7 THEN NULL WHEN value < 10 THEN 'HANGUP' ELSE 'ANSWER'
         END AS CallAnswerIndicator,
         CASE WHEN event_type <> 'error' THEN NULL
              WHEN user_id % 10 = 0 THEN 'Restricted'
              WHEN user_id % 10 = 1 THEN NULL
              WHEN user_id % 10 IN (2, 3) THEN '+1800555' || lpad(CAST(user_id AS VARCHAR), 4, '0')
              WHEN user_id % 10 = 4 THEN '+1877555' || lpad(CAST(user_id AS VARCHAR), 4, '0')
              ELSE '+1212555' || lpad(CAST(user_id AS VARCHAR), 4, '0')
         END AS CallingNumber,
         value AS CallDuration,
         kk % 3 AS DtmfInput,
         CAST(1000 + user_id % 5 AS VARCHAR) AS CustomerId,
         'flow-' || CAST(user_id % 3 AS VARCHAR) AS FlowName,
         event_id AS EventId
  FROM raw
),
every AS (
  SELECT SessionId, "TimeStamp",
         CASE event_type
           WHEN 'click' THEN action || '~~API_EVENT'
           WHEN 'view' THEN action || '~~MSG_EVENT'
           WHEN 'purchase' THEN action || '~~NLP_EVENT'
           WHEN 'signup' THEN action || '~~' || CAST(DtmfInput AS VARCHAR) || '-dtmf'
           WHEN 'error' THEN action || '~~CALL_EVENT:' || CallAnswerIndicator
         END AS ActionId,
         CallingNumber, CustomerId, FlowName, EventId, action, event_type
  FROM labelled
),
major AS (
  SELECT SessionId, "TimeStamp", ActionId, CallingNumber, CustomerId, FlowName, EventId
  FROM every WHERE event_type <> 'error' OR action <> 'TRANSFER_33'
)"""

_FILTERED = (
    _RAW
    + """,
filtered AS (
  SELECT * FROM major
  WHERE FlowName IN ('flow-0', 'flow-1')
    AND CAST("TimeStamp" AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'
)"""
)

_TOLL_FREE = " OR ".join(
    f"substr(CallingNumber, 1, 6) LIKE '%{code}%'"
    for code in (800, 888, 877, 866, 855, 844, 833)
)


def _paths(source: str, keys: str, name: str = "paths") -> str:
    return f"""
{name} AS (
  SELECT {keys}, min("TimeStamp") AS "TimeStamp",
         date_sub('second', min("TimeStamp"), max("TimeStamp")) AS Duration,
         string_agg(ActionId, ';' ORDER BY "TimeStamp", EventId) AS Path
  FROM {source} GROUP BY {keys}
)"""


def _ranks(source: str = "paths", limit: str = "") -> str:
    return f"""
frequencies AS (SELECT Path, count("TimeStamp") AS "count" FROM {source} GROUP BY Path),
ranks AS (
  SELECT Path, "count", row_number() OVER (ORDER BY "count" DESC, Path NULLS LAST) AS rank
  FROM frequencies
  ORDER BY rank {limit}
),
named AS (SELECT *, CAST(rank AS VARCHAR) || '-Path_Freq_Rank' AS nickname FROM ranks)"""


_CALLS = f"""
calls AS (
  SELECT CallingNumber, SessionId, min("TimeStamp") AS "TimeStamp",
         date_sub('second', min("TimeStamp"), max("TimeStamp")) AS session_duration,
         CASE WHEN {_TOLL_FREE} THEN 'TollFree' ELSE 'NonTollFree' END AS TollFreeNumber
  FROM filtered WHERE CallingNumber <> 'Restricted' GROUP BY CallingNumber, SessionId
)"""

_CALLBACKS = """
callbacks AS (
  SELECT *, rank() OVER (PARTITION BY CallingNumber ORDER BY "TimeStamp") AS callback_instance,
         lag(session_duration) OVER w AS previous_duration,
         date_sub('day', lag("TimeStamp") OVER w, "TimeStamp") AS days_since_last_call
  FROM calls
  WINDOW w AS (PARTITION BY CallingNumber ORDER BY "TimeStamp", SessionId)
)"""


def _steps(source: str, keys: str = "SessionId", tie: str = "EventId") -> str:
    return f"""
steps AS (
  SELECT *, row_number() OVER w AS rank_event,
         lead(ActionId) OVER w AS next_event,
         date_sub('second', first_value("TimeStamp") OVER w, "TimeStamp") AS time_from_start,
         date_sub('second', "TimeStamp", lead("TimeStamp") OVER w) AS time_to_next
  FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY "TimeStamp", {tie})
)"""


_SLIM = """
SELECT SessionId AS user_id, ActionId AS event_name, "TimeStamp" AS time_event, rank_event,
       next_event, FlowName, time_from_start, time_to_next
FROM steps"""

_SEQUENCE = ",".join(
    [_FILTERED, _paths("filtered", "SessionId"), _ranks(), _CALLS, _CALLBACKS, _steps("filtered")]
    + [
        """
seq AS (
  SELECT s.SessionId AS user_id, s.ActionId AS event_name, s."TimeStamp" AS time_event,
         CAST(s."TimeStamp" AS DATE) AS date, rank_event, next_event, FlowName,
         time_from_start, time_to_next, nickname AS path_nickname, CAST(1 AS BIGINT) AS "count",
         cb.CallingNumber, callback_instance, days_since_last_call, session_duration,
         previous_duration, TollFreeNumber
  FROM steps s
  JOIN paths p ON p.SessionId = s.SessionId
  JOIN named n ON n.Path = p.Path
  LEFT JOIN callbacks cb ON cb.SessionId = s.SessionId
)"""
    ]
)


def _links(source: str = "seq", by: str = "path_nickname", extra: str = "") -> str:
    by = f", {by}" if by else ""
    return f"""
links AS (
  SELECT event_name AS source, next_event AS target{by}, CAST(sum("count") AS BIGINT) AS "count",
         round(avg(time_from_start), 6) AS time_from_start{extra}
  FROM {source} WHERE event_name IS NOT NULL AND next_event IS NOT NULL
  GROUP BY event_name, next_event{by}
)"""


def _nodes(source: str = "seq") -> str:
    return f"""
ends AS (
  SELECT 0 AS role, event_name AS label, rank_event FROM {source}
  UNION ALL SELECT 1, next_event, rank_event FROM {source}
),
modes AS (
  SELECT role, label, rank_event AS position,
         row_number() OVER (PARTITION BY role, label ORDER BY count(*) DESC, rank_event) AS pick
  FROM ends WHERE label IS NOT NULL GROUP BY role, label, rank_event
),
spots AS (
  SELECT label, role, position FROM modes m
  WHERE pick = 1
    AND (role = 0 OR label NOT IN (SELECT label FROM ends WHERE role = 0 AND label IS NOT NULL))
),
nodes AS (
  SELECT row_number() OVER (ORDER BY role, position, label) - 1 AS node_id, label, position
  FROM spots
)"""


_GRAPH = """
SELECT l.*, a.node_id AS sourceID, b.node_id AS targetID
FROM links l JOIN nodes a ON a.label = l.source JOIN nodes b ON b.label = l.target"""


def _full(column: str, by: str, order: str = "date", rows: int = 14, fn: str = "avg") -> str:
    """A rolling aggregate that is null unless the frame holds `rows` values."""
    part = f"PARTITION BY {by} " if by else ""
    frame = f"({part}ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    value = f"{fn}({column}) OVER {frame}"
    value = f"round({value}, 6)" if fn == "avg" else f"CAST({value} AS BIGINT)"
    return f"CASE WHEN count({column}) OVER {frame} = {rows} THEN {value} END"


def _partial(column: str, by: str) -> str:
    frame = f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)"
    return f"round(avg({column}) OVER {frame}, 6)"


_DAILY_TOP = """
top AS (
  SELECT path_nickname FROM seq GROUP BY path_nickname
  ORDER BY count(*) DESC, path_nickname LIMIT 10
),
per_session AS (
  SELECT user_id, date, path_nickname, avg(session_duration) AS d
  FROM seq WHERE path_nickname IN (SELECT path_nickname FROM top) GROUP BY ALL
),
daily AS (
  SELECT path_nickname, date, avg(d) AS avg_duration, count(*) AS "count"
  FROM per_session GROUP BY path_nickname, date
)"""


def _top_trend(by: str, order: str) -> str:
    return f"""
SELECT path_nickname, date, round(avg_duration, 6) AS avg_duration, "count",
       {_full("avg_duration", by, order)} AS avg_14_day_avg_duration,
       {_full('"count"', by, order)} AS avg_14_day_count
FROM daily"""


_DAILY_EVENTS = """
daily AS (
  SELECT date, FlowName, CAST(sum("count") AS BIGINT) AS "count" FROM seq GROUP BY date, FlowName
)"""


def _event_trend(by: str, order: str) -> str:
    return f"""
SELECT date, FlowName, "count", {_full('"count"', by, order)} AS avg_14_day_count FROM daily"""


def _daily_callbacks(source: str = "seq") -> str:
    return f"""
per_session AS (
  SELECT user_id, date, TollFreeNumber, avg(session_duration) AS d, avg(previous_duration) AS p,
         avg(days_since_last_call) AS g
  FROM {source} WHERE TollFreeNumber IS NOT NULL GROUP BY user_id, date, TollFreeNumber
),
daily AS (
  SELECT TollFreeNumber, date, avg(d) AS avg_duration, avg(p) AS avg_previous_duration,
         avg(g) AS avg_days_since_last_call, count(*) AS "count"
  FROM per_session GROUP BY TollFreeNumber, date
)"""


_CALLBACK_TREND = f"""
SELECT TollFreeNumber, date, round(avg_duration, 6) AS avg_duration,
       round(avg_previous_duration, 6) AS avg_previous_duration,
       round(avg_days_since_last_call, 6) AS avg_days_since_last_call, "count",
       {_full("avg_duration", "TollFreeNumber")} AS avg_14_day_avg_duration,
       {_full("avg_previous_duration", "TollFreeNumber")} AS avg_14_day_avg_previous_duration,
       {_full('"count"', "TollFreeNumber")} AS avg_14_day_count
FROM daily"""

_EXITS = (
    _RAW
    + ","
    + """
exits AS (
  SELECT SessionId, max("TimeStamp") AS "TimeStamp", FlowName,
         string_agg(ActionId, ';' ORDER BY "TimeStamp", EventId) AS Path
  FROM major GROUP BY SessionId, FlowName
)"""
)

_TREND_FRAME = """
lines AS (
  SELECT path_nickname AS series, date, 'count' AS metric, true AS rolling,
         avg_14_day_count AS value FROM trend
  UNION ALL SELECT path_nickname, date, 'count', false, CAST("count" AS DOUBLE) FROM trend
  UNION ALL SELECT path_nickname, date, 'avg_duration', true, avg_14_day_avg_duration FROM trend
  UNION ALL SELECT path_nickname, date, 'avg_duration', false, avg_duration FROM trend
)
SELECT *, max(value) OVER (PARTITION BY metric, rolling) AS metric_max,
       date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AS in_band
FROM lines"""


def _pairs(source: str) -> str:
    return f"""
subset AS (
  SELECT DISTINCT CallingNumber, SessionId, "TimeStamp", CallAnswerIndicator, CallDuration
  FROM {source}
),
pairs AS (
  SELECT CAST(a."TimeStamp" AS DATE) AS date,
         ({_TOLL_FREE.replace("CallingNumber", "a.CallingNumber")}) AS TollFreeNumber,
         date_sub('day', a."TimeStamp", b."TimeStamp") AS gap,
         CAST(a.CallDuration AS DECIMAL(18, 2)) AS d1, CAST(b.CallDuration AS DECIMAL(18, 2)) AS d2
  FROM subset a JOIN subset b ON a.CallingNumber = b.CallingNumber
  WHERE a.SessionId <> b.SessionId AND a."TimeStamp" < b."TimeStamp"
)"""


def _pair_stats(by: str) -> str:
    return f"""
SELECT {by}, count(*) AS "count",
       round(avg(gap), 6) AS mean_days_between_calls,
       round(stddev_samp(gap), 6) AS std_days_between_calls,
       CAST(round(CAST(avg(d1) AS DECIMAL(28, 10)), 6) AS DOUBLE) AS mean_first_call_duration,
       round(stddev_samp(d1), 6) AS std_first_call_duration,
       CAST(round(CAST(avg(d2) AS DECIMAL(28, 10)), 6) AS DOUBLE) AS mean_second_call_duration,
       round(stddev_samp(d2), 6) AS std_second_call_duration
FROM pairs GROUP BY {by}"""


_CALL_ROWS = """
call_rows AS (
  SELECT SessionId, "TimeStamp", action AS ActionId, CustomerId, FlowName, EventId,
         CallAnswerIndicator, CallingNumber, CallDuration
  FROM labelled WHERE event_type = 'error' AND CallingNumber <> 'Restricted'
)"""

_ORDERS = """
order_calls AS (
  SELECT '+1212' || CAST(o_custkey AS VARCHAR) AS CallingNumber,
         CAST(o_orderkey AS VARCHAR) AS SessionId, o_orderdate AS "TimeStamp",
         o_orderstatus AS CallAnswerIndicator, o_totalprice AS CallDuration
  FROM orders
)"""

_CHATS = """
chats AS (
  SELECT CAST(conv_id AS VARCHAR) AS SessionId,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS "TimeStamp",
         role AS ActionId, turn AS EventId, 'chat' AS FlowName
  FROM conversations
)"""

_SHIPMENTS = (
    """
log AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS SessionId, l_returnflag || '-' || l_linestatus AS ActionId,
         l_shipdate AS "TimeStamp"
  FROM lineitem
),"""
    + _steps("log", tie="ActionId")
    + """,
seq AS (
  SELECT SessionId AS user_id, ActionId AS event_name, "TimeStamp" AS time_event, rank_event,
         next_event, time_from_start, time_to_next, CAST(1 AS BIGINT) AS "count"
  FROM steps
)"""
)

_PERIODS = """
dated AS (
  SELECT period, f.* FROM filtered f JOIN (
    SELECT 'early' AS period, DATE '2024-01-03' AS a, DATE '2024-01-16' AS b
    UNION ALL SELECT 'late', DATE '2024-01-16', DATE '2024-01-28'
  ) ON CAST("TimeStamp" AS DATE) BETWEEN a AND b
)"""

# Dates at 10 and 90 percent of the sequence, then strictly between their midnights.
_SHOWN = """
ends_at AS (
  SELECT min(time_event) AS a, date_diff('microsecond', min(time_event), max(time_event)) AS span
  FROM seq
),
shown AS (
  SELECT seq.* FROM seq, ends_at
  WHERE time_event > CAST(CAST(a + to_microseconds(CAST(span * 0.1 AS BIGINT)) AS DATE) AS TIMESTAMP)
    AND time_event < CAST(CAST(a + to_microseconds(CAST(span * 0.9 AS BIGINT)) AS DATE) AS TIMESTAMP)
    AND TollFreeNumber = 'NonTollFree'
)"""


def _with(*parts: str) -> str:
    """WITH the parts but the last, which is the query (or continues the last part with one)."""
    return "WITH " + ",".join(parts[:-1]) + parts[-1]


# The operators without a filter of their own, on the whole log.
_WHOLE = _RAW + """,
filtered AS (SELECT * FROM major)"""

_ON_WHOLE_LOG = [
    "session_paths",
    "session_flow_paths",
    "path_frequencies",
    "path_ranks",
    "session_nicknames",
    "caller_sessions",
    "callbacks",
    "step_sequence",
    "user_sequence",
]


def _color(nickname: str) -> str:
    return f"CASE WHEN path_nickname = '{nickname}' THEN '#ed7953' ELSE '#d3d3d3' END AS color"


ORACLE: dict[str, str] = {
    "unified_events": _with(_RAW, "SELECT * FROM major"),
    "unified_events_all_actions": _with(
        _RAW,
        'SELECT SessionId, "TimeStamp", ActionId, CallingNumber, CustomerId, FlowName, EventId '
        "FROM every",
    ),
    "filtered_events": _with(_FILTERED, "SELECT * FROM filtered"),
    "customer_events": _with(
        _RAW,
        "SELECT * FROM major WHERE CustomerId = '1001' "
        "AND CAST(\"TimeStamp\" AS DATE) > DATE '2024-01-03'",
    ),
    "call_events": _with(
        _RAW,
        _CALL_ROWS,
        "SELECT * FROM call_rows WHERE FlowName IN ('flow-0', 'flow-1') "
        "AND CAST(\"TimeStamp\" AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'",
    ),
    "available_flows": _with(_EXITS, "SELECT DISTINCT FlowName FROM exits ORDER BY FlowName"),
    "step_sequence": _with(_FILTERED, _steps("filtered"), _SLIM),
    "session_paths": _with(_FILTERED, _paths("filtered", "SessionId"), "SELECT * FROM paths"),
    "session_flow_paths": _with(
        _FILTERED, _paths("filtered", "SessionId, FlowName"), "SELECT * FROM paths"
    ),
    "path_frequencies": _with(
        _FILTERED, _paths("filtered", "SessionId"), _ranks(), "SELECT * FROM frequencies"
    ),
    "path_ranks": _with(
        _FILTERED, _paths("filtered", "SessionId"), _ranks(), "SELECT * FROM named"
    ),
    "session_nicknames": _with(
        _FILTERED,
        _paths("filtered", "SessionId"),
        _ranks(),
        "SELECT SessionId, Path, nickname AS path_nickname FROM paths JOIN named USING (Path)",
    ),
    "top_paths": _with(
        _FILTERED,
        _paths("filtered", "SessionId, FlowName"),
        _ranks(limit="LIMIT 10"),
        "SELECT * FROM named",
    ),
    "sessions_on_path": _with(
        _FILTERED,
        _paths("filtered", "SessionId, FlowName"),
        _ranks(limit="LIMIT 10"),
        "SELECT DISTINCT SessionId FROM paths JOIN named USING (Path) "
        "WHERE nickname = '1-Path_Freq_Rank'",
    ),
    "sessions_on_path_all": _with(
        _RAW,
        _paths("major", "SessionId, FlowName"),
        """
in_scope AS (
  SELECT * FROM paths WHERE FlowName IN ('flow-0', 'flow-1')
    AND CAST("TimeStamp" AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'
)""",
        _ranks("in_scope", "LIMIT 10"),
        "SELECT DISTINCT SessionId FROM paths JOIN named USING (Path) "
        "WHERE nickname = '1-Path_Freq_Rank'",
    ),
    "caller_sessions": _with(_FILTERED, _CALLS, "SELECT * FROM calls"),
    "callbacks": _with(_FILTERED, _CALLS, _CALLBACKS, "SELECT * FROM callbacks"),
    "user_sequence": _with(_SEQUENCE, "SELECT * FROM seq"),
    "sequence_window": _with(
        _SEQUENCE,
        "SELECT * FROM seq WHERE time_event > TIMESTAMP '2024-01-05 00:00:00' "
        "AND time_event < TIMESTAMP '2024-01-20 00:00:00'",
    ),
    "sequence_nontollfree": _with(
        _SEQUENCE, "SELECT * FROM seq WHERE TollFreeNumber = 'NonTollFree'"
    ),
    "date_at_percent": _with(
        _SEQUENCE,
        "SELECT CAST(min(time_event) + to_microseconds(CAST(date_diff('microsecond', "
        "min(time_event), max(time_event)) * 0.37 AS BIGINT)) AS DATE) AS date FROM seq",
    ),
    "flow_links": _with(_SEQUENCE, _links(), "SELECT * FROM links"),
    "flow_links_sessions": _with(
        _SEQUENCE,
        _links(extra=", count(DISTINCT user_id) AS sessions"),
        "SELECT * FROM links",
    ),
    "flow_nodes": _with(_SEQUENCE, _nodes(), "SELECT * FROM nodes"),
    "flow_graph": _with(_SEQUENCE, _links(), _nodes(), _GRAPH),
    "links_threshold_abs": _with(_SEQUENCE, _links(), 'SELECT * FROM links WHERE "count" >= 3'),
    "links_threshold_pct": _with(
        _SEQUENCE,
        _links(),
        'SELECT * FROM links WHERE "count" >= (SELECT floor(max("count") * 0.1) FROM links)',
    ),
    "links_highlight": _with(
        _SEQUENCE, _links(), f"SELECT *, {_color('6-Path_Freq_Rank')} FROM links"
    ),
    "top_path_trend_from_sequence": _with(
        _SEQUENCE, _DAILY_TOP, _top_trend("path_nickname", "date")
    ),
    "top_path_trend_from_sequence_ungrouped": _with(
        _SEQUENCE, _DAILY_TOP, _top_trend("", "path_nickname, date")
    ),
    "daily_event_trend": _with(_SEQUENCE, _DAILY_EVENTS, _event_trend("FlowName", "date")),
    "daily_event_trend_ungrouped": _with(
        _SEQUENCE, _DAILY_EVENTS, _event_trend("", "date, FlowName")
    ),
    "callback_trend": _with(_SEQUENCE, _daily_callbacks(), _CALLBACK_TREND),
    "rolling_three": _with(
        _SEQUENCE,
        _daily_callbacks(),
        f"""
SELECT TollFreeNumber, date, round(avg_duration, 6) AS avg_duration, "count",
       {_full("avg_duration", "TollFreeNumber", rows=3)} AS mean_3,
       {_full('"count"', "TollFreeNumber", rows=3, fn="sum")} AS sum_3
FROM daily""",
    ),
    "top_nicknames": _with(_SEQUENCE, _DAILY_TOP, "SELECT path_nickname FROM top"),
    "daily_top_paths": _with(
        _SEQUENCE,
        _DAILY_TOP,
        'SELECT path_nickname, date, round(avg_duration, 6) AS avg_duration, "count" FROM daily',
    ),
    "daily_callbacks": _with(
        _SEQUENCE,
        _daily_callbacks(),
        """
SELECT TollFreeNumber, date, round(avg_duration, 6) AS avg_duration,
       round(avg_previous_duration, 6) AS avg_previous_duration,
       round(avg_days_since_last_call, 6) AS avg_days_since_last_call, "count"
FROM daily""",
    ),
    "trend_frame": _with(
        _SEQUENCE,
        _DAILY_TOP,
        f" trend AS ({_top_trend('path_nickname', 'date')})",
        "," + _TREND_FRAME,
    ),
    "dashboard_links": _with(
        _SEQUENCE,
        _SHOWN,
        _links("shown"),
        _nodes("shown"),
        f"""
SELECT g.*, {_color('1-Path_Freq_Rank')} FROM ({_GRAPH}) g
WHERE "count" >= (SELECT floor(max("count") * 0.1) FROM links)""",
    ),
    "dashboard_callbacks": _with(_SEQUENCE, _SHOWN, _daily_callbacks("shown"), _CALLBACK_TREND),
    "dashboard_nodes": _with(_SEQUENCE, _SHOWN, _nodes("shown"), "SELECT * FROM nodes"),
    "dashboard_totals": _with(_SEQUENCE, _DAILY_EVENTS, _event_trend("FlowName", "date")),
    "dashboard_top_paths": _with(
        _SEQUENCE,
        _SHOWN,
        _DAILY_TOP.replace("FROM seq", "FROM shown"),
        _top_trend("path_nickname", "date"),
    ),
    "daily_sessions": _with(
        _EXITS,
        'SELECT CAST("TimeStamp" AS DATE) AS date, FlowName, '
        'count(DISTINCT SessionId) AS "count" FROM exits GROUP BY ALL',
    ),
    "daily_path_length": _with(
        _EXITS,
        'SELECT CAST("TimeStamp" AS DATE) AS date, FlowName, '
        'count(DISTINCT SessionId) AS "count", '
        "round(avg(length(Path) - length(replace(Path, ';', ''))), 6) AS avg_pathLength "
        "FROM exits GROUP BY ALL",
    ),
    "daily_session_trend": _with(
        _EXITS,
        """
daily AS (
  SELECT CAST("TimeStamp" AS DATE) AS date, FlowName, count(DISTINCT SessionId) AS "count"
  FROM exits WHERE FlowName IN ('flow-0', 'flow-1') GROUP BY ALL
)""",
        f"SELECT *, {_partial('\"count\"', 'FlowName')} AS avg_14_day_count FROM daily",
    ),
    "flow_trend": _with(
        _EXITS,
        """
daily AS (
  SELECT CAST("TimeStamp" AS DATE) AS date, FlowName, count(DISTINCT SessionId) AS "count",
         avg(length(Path) - length(replace(Path, ';', ''))) AS steps
  FROM exits GROUP BY ALL
)""",
        f"""
SELECT date, FlowName, "count", round(steps, 6) AS avg_pathLength,
       {_partial('"count"', "FlowName")} AS avg_14_day_count,
       {_partial("steps", "FlowName")} AS avg_14_day_pathLength
FROM daily""",
    ),
    "top_path_trend": _with(
        _FILTERED,
        _paths("filtered", "SessionId, FlowName"),
        _ranks(limit="LIMIT 10"),
        """
daily AS (
  SELECT CAST("TimeStamp" AS DATE) AS date, nickname, any_value(Path) AS Path,
         count(DISTINCT SessionId) AS "count", avg(Duration) AS mean
  FROM paths JOIN named USING (Path) GROUP BY ALL
)""",
        f"""
SELECT date, nickname, Path, daily."count", round(mean, 6) AS avg_duration,
       {_partial('daily."count"', "nickname")} AS avg_14_day_count,
       {_partial("mean", "nickname")} AS avg_14_day_avg_duration
FROM daily""",
    ),
    "compare_periods": _with(
        _FILTERED,
        _PERIODS,
        _steps("dated", "period, SessionId"),
        """
seq AS (
  SELECT period, SessionId AS user_id, ActionId AS event_name, next_event, time_from_start,
         CAST(1 AS BIGINT) AS "count" FROM steps
)""",
        _links(by="period"),
        "SELECT * FROM links",
    ),
    "repeat_call_stats": _with(
        _RAW, _CALL_ROWS, _pairs("call_rows"), _pair_stats("date, TollFreeNumber")
    ),
    "repeat_call_stats_by_date": _with(
        _RAW, _CALL_ROWS, _pairs("call_rows"), _pair_stats("date")
    ),
    "sample_sessions": _with(
        _RAW,
        """
chosen AS (
  SELECT SessionId FROM (SELECT DISTINCT SessionId FROM major)
  ORDER BY md5('0' || SessionId), SessionId LIMIT 500
)""",
        "SELECT major.* FROM major JOIN chosen USING (SessionId)",
    ),
    "order_callbacks": _with(
        _ORDERS,
        """
calls AS (
  SELECT CallingNumber, SessionId, "TimeStamp", CallDuration AS session_duration FROM order_calls
)""",
        _CALLBACKS,
        "SELECT * FROM callbacks",
    ),
    "order_repeat_stats": _with(
        _ORDERS, _pairs("order_calls"), _pair_stats("date, TollFreeNumber")
    ),
    "conversation_path_ranks": _with(
        _CHATS, _paths("chats", "SessionId"), _ranks(), "SELECT * FROM named"
    ),
    "conversation_path_lengths": _with(
        _CHATS,
        _paths("chats", "SessionId"),
        "SELECT SessionId, length(Path) - length(replace(Path, ';', '')) AS pathLength FROM paths",
    ),
    "conversation_steps": _with(_CHATS, _steps("chats"), _SLIM),
    "shipment_steps": _with(_SHIPMENTS, "SELECT * FROM seq"),
    "flow_graph_from_log": _with(_SHIPMENTS, _links(by=""), _nodes(), _GRAPH),
    "flow_graph_from_log_nodes": _with(_SHIPMENTS, _nodes(), "SELECT * FROM nodes"),
    "sequence_in_order": _with(
        _SEQUENCE, "SELECT * FROM seq ORDER BY user_id, time_event, rank_event"
    ),
}
_STEP = """user_id, event_name, time_event, date, rank_event, next_event, FlowName,
       time_from_start, time_to_next, path_nickname"""

ORACLE |= {
    "factorised_steps": _with(
        _SEQUENCE,
        f"""
SELECT {_STEP}, count(*) AS "count",
       count(*) FILTER (WHERE TollFreeNumber = 'NonTollFree') AS ordinary_count
FROM seq GROUP BY {_STEP}""",
    ),
    "factorised_callers": _with(
        _SEQUENCE,
        """
SELECT DISTINCT user_id, CallingNumber, callback_instance, days_since_last_call,
       session_duration, previous_duration, TollFreeNumber
FROM seq WHERE CallingNumber IS NOT NULL""",
    ),
    "factorised_links": ORACLE["flow_links"],
    "factorised_nodes": ORACLE["flow_nodes"],
    "factorised_callback_trend": ORACLE["callback_trend"],
    "factorised_top_path_trend": ORACLE["top_path_trend_from_sequence"],
    **{
        f"refreshed_{frame}": ORACLE[f"dashboard_{frame}"]
        for frame in ("links", "nodes", "totals", "top_paths", "callbacks")
    },
    "sketched_weeks": _with(
        _EXITS,
        """
SELECT FlowName, CAST(date_trunc('week', "TimeStamp") AS DATE) AS week,
       count(DISTINCT SessionId) AS sessions, true AS within_error
FROM exits GROUP BY ALL""",
    ),
    "stored_in_parts": _with(
        _SEQUENCE.replace(
            "AND CAST(\"TimeStamp\" AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'", ""
        ),
        "SELECT * FROM seq",
    ),
    "events_from_files": ORACLE["unified_events"],
    "exit_events_from_files": _with(_EXITS, "SELECT * FROM exits"),
}

_OF_FLOWS = [name for name in _ON_WHOLE_LOG if name not in ("step_sequence", "user_sequence")]
ORACLE |= {f"{name}_of_flows": ORACLE[name] for name in _OF_FLOWS}
ORACLE |= {
    name if name in _OF_FLOWS else f"{name}_whole_log": ORACLE[name].replace(_FILTERED, _WHOLE)
    for name in _ON_WHOLE_LOG
}
