"""Statistics over all pairs of calls of one number, without forming the pairs.

Split the time of a call into its day q and its time of day r. A later call j is then
q_j - q_i whole days after call i, less one if r_j < r_i. Sums over all later calls therefore follow
from running totals of 1, q and q squared over the calls in time order, corrected by how many later
calls have the smaller time of day (a *borrow*), and on which days.

Borrows are counted by the highest bit in which the two days differ. At each bit, the calls of a
number whose days agree above it form a group; in order of time of day, a call with a 0 there
borrows from the calls with a 1 before it. A number with n calls over d days takes n log d rows,
where the pairs would take n squared.

All sums are integers, of days and of microseconds of duration, so that taking one large sum off
another loses nothing. A duration is kept as a high and a low part, d = high * 2**30 + low, whose
products are summed apart: the square of a long duration, times the pairs of a placeholder number,
would not fit into 38 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import is_toll_free
from trailmark.operators.freeze import BROADCAST_ROWS, fits, frozen, join_attributes
from trailmark.operators.ordered import (
    GROUP_ROWS,
    Heavy,
    first_of,
    heavy_keys,
    last_of,
    ordered_metrics,
    total_before,
)

_MICROS_PER_SECOND = 1_000_000
_MICROS_PER_DAY = 86_400 * _MICROS_PER_SECOND
_KEYS = ["CallingNumber", "_session"]
_EXACT = "decimal(38,0)"
# Bits of the low part of a duration, and the sums of both parts that make a deviation.
_LOW_BITS = 30
_PARTS = ["high", "low", "high_squares", "products", "low_squares"]


def repeat_call_stats(
    calls: DataFrame, by_toll_free: bool = True, group_rows: int | None = GROUP_ROWS
) -> DataFrame:
    """Statistics of repeated calls by the date of the earlier call and the caller class.

    Over every pair of calls of one number in different sessions, the later strictly later: the
    number of pairs, and mean and sample deviation of the whole days between them and of the
    durations of the first and of the second call. Equal rows of `calls` count once.
    """
    points = _points(calls)
    first, last = points.agg(F.min("_day"), F.max("_day")).first()
    first, last = first or 0, last or 0
    heavy = heavy_keys(points, _KEYS, group_rows)
    # Read by both kinds of sums.
    rows = frozen(_with_later(points.withColumn("_day", F.col("_day") - first), heavy))
    bits = max(1, (last - first).bit_length())
    sums = _later_sums(rows).unionByName(
        _borrow_sums(rows, bits, heavy, group_rows), allowMissingColumns=True
    )
    return _statistics(sums, ["date", "TollFreeNumber"] if by_toll_free else ["date"])


def _points(calls: DataFrame) -> DataFrame:
    """Calls added up per instant, once per number and once per session of the number.

    The pairs inside one session have to come off the pairs of the number. They are the pairs of
    the same sum taken per session, so both go through the same steps with opposite signs. A session
    of one instant has no pairs.
    """
    known = calls.select(
        "CallingNumber", "SessionId", "TimeStamp", "CallAnswerIndicator", "CallDuration"
    ).dropna(subset=["CallingNumber", "SessionId", "TimeStamp"])
    named = known.withColumn("_pair", F.struct("CallingNumber", "SessionId"))
    several = frozen(
        named.groupBy("_pair")
        .agg(F.min("TimeStamp").alias("_first"), F.max("TimeStamp").alias("_last"))
        .filter("_first < _last")
        .select("_pair")
    )
    inside = join_attributes(named, several, "_pair", "left_semi", fits(several, BROADCAST_ROWS))
    session = F.col("SessionId").cast("string")
    added = _per_instant(known, 1, F.lit(None).cast("string")).unionByName(
        _per_instant(inside.select(*known.columns), -1, session)
    )
    micros = F.unix_micros(F.col("TimeStamp").cast("timestamp"))
    time = F.pmod(micros, F.lit(_MICROS_PER_DAY))
    return frozen(
        added.withColumn("_time", time)
        .withColumn("_day", ((micros - time) / _MICROS_PER_DAY).cast("long"))
        .withColumn("date", F.to_date("TimeStamp"))
        .withColumn("TollFreeNumber", is_toll_free(F.col("CallingNumber")))
        .drop("TimeStamp")
    )


def _per_instant(calls: DataFrame, sign: int, session: Column) -> DataFrame:
    duration = F.rint(F.col("CallDuration") * _MICROS_PER_SECOND).cast("long")
    high = F.shiftright("_micros", _LOW_BITS).cast(_EXACT)
    low = F.col("_micros").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)).cast(_EXACT)
    parts = [high, low, high * high, high * low, low * low]
    nothing = F.lit(0).cast(_EXACT)
    return (
        calls.distinct()
        .select("CallingNumber", session.alias("_session"), "TimeStamp", duration.alias("_micros"))
        .groupBy("CallingNumber", "_session", "TimeStamp")
        .agg(
            F.count(F.lit(1)).alias("_calls"),
            F.count("_micros").alias("_known"),
            *[F.coalesce(F.sum(x), nothing).alias(f"_{n}") for n, x in zip(_PARTS, parts)],
        )
        .withColumn("_sign", F.lit(sign))
    )


def _exact(name: str) -> Column:
    return F.col(name).cast(_EXACT)


def _with_later(points: DataFrame, heavy: Heavy | None) -> DataFrame:
    """Instants with totals over the later ones and the first and last day of their number."""
    weighted = points.withColumns(
        {
            "_days": F.col("_calls") * F.col("_day"),
            "_day_squares": _exact("_calls") * _exact("_day") * _exact("_day"),
        }
    )
    metrics = {
        "_later": total_before("_calls"),
        "_later_days": total_before("_days"),
        "_later_day_squares": total_before("_day_squares"),
        "_later_known": total_before("_known"),
        **{f"_later_{name}": total_before(f"_{name}") for name in _PARTS},
        "_newest": first_of("_day"),
        "_oldest": last_of("_day"),
    }
    newest_first = [F.col("_day").desc(), F.col("_time").desc()]
    return ordered_metrics(weighted, _KEYS, newest_first, metrics, heavy)


def _later_sums(rows: DataFrame) -> DataFrame:
    """Per instant: the sums over its pairs with all later calls, borrows left out."""
    calls, later, day = _exact("_calls"), _exact("_later"), _exact("_day")
    days = _exact("_later_days")
    squares = _exact("_later_day_squares")
    return rows.filter(F.col("_later") > 0).select(
        "date",
        "TollFreeNumber",
        "_sign",
        (calls * later).alias("pairs"),
        (calls * (days - later * day)).alias("days"),
        (calls * (squares - 2 * day * days + later * day * day)).alias("day_squares"),
        (_exact("_known") * later).alias("first_known"),
        *[(F.col(f"_{name}") * later).alias(f"first_{name}") for name in _PARTS],
        (calls * _exact("_later_known")).alias("second_known"),
        *[(calls * F.col(f"_later_{name}")).alias(f"second_{name}") for name in _PARTS],
    )


def _borrow_sums(
    rows: DataFrame, bits: int, heavy: Heavy | None, group_rows: int | None
) -> DataFrame:
    """Per instant and bit: what the borrows change in the sums of days and of their squares."""
    # A call borrows at the bits where a later day can differ, and lends where an earlier one can.
    candidates = F.expr(
        f"""
        filter(
          transform(
            sequence(0, {bits - 1}),
            bit -> named_struct('_level', bit, '_bit', shiftright(_day, bit) & 1L)
          ),
          at -> shiftright(_day ^ if(at._bit = 0, _newest, _oldest), at._level) > 0
        )"""
    )
    levels = rows.select(
        *_KEYS,
        "_sign",
        "date",
        "TollFreeNumber",
        "_calls",
        "_day",
        "_time",
        F.explode(candidates).alias("_at_bit"),
    ).select("*", "_at_bit._level", "_at_bit._bit")
    one = F.col("_bit") == 1
    levels = levels.withColumns(
        {
            "_prefix": F.expr("shiftright(_day, _level + 1)"),
            "_lenders": F.when(one, F.col("_calls")).otherwise(0),
            "_lender_days": F.when(one, F.col("_calls") * F.col("_day")).otherwise(0),
        }
    ).drop("_at_bit")
    keys = [*_KEYS, "_level", "_prefix"]
    # A group here is part of a group of `_KEYS`, so none is heavy if none was there.
    heavy_levels = heavy and heavy_keys(levels, keys, group_rows)
    metrics = {
        "_borrows": total_before("_lenders"),
        "_borrow_days": total_before("_lender_days"),
    }
    # At equal time of day the 0 comes before the 1: only a smaller time lends.
    order = [F.col("_time"), F.col("_bit")]
    rows = ordered_metrics(levels, keys, order, metrics, heavy_levels)
    calls, borrows = _exact("_calls"), _exact("_borrows")
    gaps = _exact("_borrow_days") - _exact("_day") * borrows
    return rows.filter((F.col("_bit") == 0) & (F.col("_borrows") > 0)).select(
        "date",
        "TollFreeNumber",
        "_sign",
        (-calls * borrows).alias("days"),
        (calls * (borrows - 2 * gaps)).alias("day_squares"),
    )


def _statistics(sums: DataFrame, by: list[str]) -> DataFrame:
    names = [name for name in sums.columns if name not in ("date", "TollFreeNumber", "_sign")]
    totals = sums.groupBy(*by).agg(*[F.sum(F.col("_sign") * F.col(n)).alias(n) for n in names])
    made = [F.col("pairs").cast("long").alias("count")]
    for name, (mean, deviation) in {
        "days_between_calls": _day_moments(),
        "first_call_duration": _duration_moments("first"),
        "second_call_duration": _duration_moments("second"),
    }.items():
        made += [mean.alias(f"mean_{name}"), deviation.alias(f"std_{name}")]
    return totals.filter(F.col("pairs") > 0).select(*by, *made)


def _day_moments() -> tuple[Column, Column]:
    """Mean and sample deviation; null for no value and for fewer than two."""
    n, total = F.col("pairs"), F.col("days")
    mean = total.cast("double") / _or_null(n)
    # Centre on a whole number near the mean while the sums are still exact.
    centre = F.floor(mean).cast(_EXACT)
    off = total - n * centre
    squares = F.col("day_squares") - 2 * centre * total + n * centre * centre
    return mean, _deviation(n, off, squares.cast("double"))


def _duration_moments(which: str) -> tuple[Column, Column]:
    """As `_day_moments` in seconds, from the sums of the parts of the durations."""
    n, high, low, high_squares, products, low_squares = (
        F.col(f"{which}_{name}") for name in ("known", *_PARTS)
    )
    unit, factor = F.lit(1 << _LOW_BITS).cast(_EXACT), float(1 << _LOW_BITS)

    def joined(highs: Column, lows: Column) -> Column:
        """highs * 2**30 + lows, exact up to 38 digits, the leading digits beyond."""
        exact = F.try_add(F.try_multiply(highs, unit), lows)
        return F.coalesce(exact.cast("double"), highs.cast("double") * factor + lows.cast("double"))

    mean = joined(high, low) / _or_null(n)
    centre = F.floor(mean).cast(_EXACT)
    # The centre in parts like those of a duration, so that each sum stays exact.
    up = F.floor(mean / factor).cast(_EXACT)
    down = centre - up * unit
    highs = high_squares - 2 * up * high + n * up * up
    mixed = products - up * low - down * high + n * up * down
    lows = low_squares - 2 * down * low + n * down * down
    exact = F.try_add(
        F.try_multiply(F.try_add(F.try_multiply(highs, unit), 2 * mixed), unit), lows
    )
    rough = (highs.cast("double") * factor + 2.0 * mixed.cast("double")) * factor + lows.cast("double")
    squares = F.coalesce(exact.cast("double"), rough)
    deviation = _deviation(n, joined(high - n * up, low - n * down), squares)
    return mean / _MICROS_PER_SECOND, deviation / _MICROS_PER_SECOND


def _or_null(n: Column) -> Column:
    return F.nullif(n.cast("double"), F.lit(0.0))


def _deviation(n: Column, off: Column, squares: Column) -> Column:
    """Sample deviation of n values from the sums of their offsets from a centre and the squares."""
    spread = squares - off.cast("double") * off.cast("double") / _or_null(n)
    freedom = F.nullif(n.cast("double") - 1, F.lit(0.0))
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / freedom))
