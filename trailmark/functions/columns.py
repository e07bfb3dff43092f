"""Column expressions: labels, time differences, caller classes and path text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators and family names that make up a step label.
LABEL_SEPARATOR = "~~"
FAMILY_NAMES = {
    "api": "API_EVENT",
    "call": "CALL_EVENT",
    "msg": "MSG_EVENT",
    "nlp": "NLP_EVENT",
}
KEYPRESS_SUFFIX = "-dtmf"
PATH_SEPARATOR = ";"
NICKNAME_SUFFIX = "-Path_Freq_Rank"

# Toll-free area codes, matched anywhere in the first six characters.
TOLL_FREE_CODES = ("800", "888", "877", "866", "855", "844", "833")
TOLL_FREE = "TollFree"
NOT_TOLL_FREE = "NonTollFree"


def step_label(family: str) -> Column:
    """Label of one event of `family`; null when any of its parts is null."""
    action = F.col("ActionId")
    if family == "dtmf":
        digit = F.col("DtmfInput").cast("string")
        return F.concat(action, F.lit(LABEL_SEPARATOR), digit, F.lit(KEYPRESS_SUFFIX))
    label = F.concat(action, F.lit(LABEL_SEPARATOR + FAMILY_NAMES[family]))
    if family == "call":
        label = F.concat(label, F.lit(":"), F.col("CallAnswerIndicator"))
    return label


def whole_seconds(start: Column, end: Column) -> Column:
    """Complete seconds from `start` to `end`."""
    return F.timestamp_diff("SECOND", start, end)


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour days from `start` to `end` (not calendar days)."""
    return F.timestamp_diff("DAY", start, end)


def is_toll_free(number: Column) -> Column:
    return F.substring(number, 1, 6).rlike("|".join(TOLL_FREE_CODES))


def toll_free_class(number: Column) -> Column:
    return F.when(is_toll_free(number), F.lit(TOLL_FREE)).otherwise(F.lit(NOT_TOLL_FREE))


def path_nickname(rank: Column) -> Column:
    return F.concat(rank.cast("string"), F.lit(NICKNAME_SUFFIX))


def path_key(path: Column) -> Column:
    """32 bytes that stand for a path's text, whatever its length; null for the null path."""
    return F.unhex(F.sha2(path, 256))


def path_length(path: Column) -> Column:
    """Number of separators in a path, which is its number of steps less one."""
    separator = F.lit(PATH_SEPARATOR)
    return (F.char_length(path) - F.char_length(F.replace(path, separator, F.lit("")))).cast("long")
