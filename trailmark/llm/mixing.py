"""Mixing sources to target weights: blocks of rows in the slots of a Pfair schedule."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.freeze import BROADCAST_ROWS, fits, frozen, join_attributes
from trailmark.operators.ordered import number_rows

BLOCK_ROWS = 16
PERIOD = 1000
# Slots for each source at least, and the sources that are scheduled one by one.
SLOTS_PER_SOURCE = 8
MOST_SCHEDULED = 2_048
WEIGHT_POWER = 0.5


def _source(column: str) -> Column:
    """The source as a key that is never null: null and the empty string stay apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def tempered_weights(
    docs: DataFrame, power: float = WEIGHT_POWER, source_column: str = "source"
) -> DataFrame:
    """Target weights that flatten the sources' shares: rows to the power `power`."""
    return (
        docs.groupBy(F.col(source_column).alias("source"))
        .count()
        .select("source", F.pow(F.col("count").cast("double"), F.lit(power)).alias("weight"))
    )


def _shares(weights: DataFrame, period: int) -> DataFrame:
    """Whole slots of a period for each source, by largest remainder; sources without one are out."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_rest").desc(), "_source")
    whole = weights.select(
        _source("source").alias("_source"),
        (F.col("weight") / F.sum("weight").over(everything) * period).alias("_exact"),
    ).select(
        "_source",
        F.floor("_exact").alias("_floor"),
        F.round(F.col("_exact") - F.floor("_exact"), 9).alias("_rest"),
    )
    left = F.lit(period) - F.sum("_floor").over(everything)
    return whole.select(
        "_source",
        (F.col("_floor") + (F.row_number().over(order) <= left).cast("long")).alias("share"),
    )


def pfair_period(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """One period of the schedule: `slot` (from 0), `_source`, `nth` block of it in the period, `share`.

    A source with a of the period's P slots releases its block c (from 0) at slot floor(c*P/a), with
    the deadline ceil((c+1)*P/a). Each slot goes to the released block with the earliest deadline,
    of equal ones to the first source by name. Since the shares add up to P all deadlines are met,
    so after t slots a source has had t*a/P blocks with less than one block's deviation, and the
    schedule repeats after P slots. Sources of equal share have the same releases and deadlines and
    are served in turn, so the fold over P slots keeps one count per distinct share, of which there are
    at most sqrt(2P): its size does not depend on the data mixed.
    """
    return _period_plan(_shares(weights, period).filter("share > 0"), period)


def _period_plan(shares: DataFrame, period: int) -> DataFrame:
    names = shares.agg(F.array_sort(F.collect_list(F.struct("_source", "share"))).alias("_of"))
    alike = (
        names.select(F.posexplode("_of").alias("at", "of"))
        .groupBy(F.col("of.share").alias("share"))
        .agg(F.array_sort(F.collect_list("at")).alias("members"))
    )
    classes = alike.agg(F.array_sort(F.collect_list(F.struct("share", "members"))).alias("_classes"))

    def step(state: Column, slot: Column) -> Column:
        def next_of(group: Column, i: Column) -> Column:
            given, size = F.get(state["given"], i), F.size(group["members"])
            block = F.floor(given / size)
            return F.when(
                F.floor(block * period / group["share"]) <= slot,
                F.struct(
                    F.ceil((block + 1) * period / group["share"]).alias("deadline"),
                    F.get(group["members"], (given % size).cast("int")).alias("index"),
                    block.alias("nth"),
                    i.alias("group"),
                ),
            )

        chosen = F.array_min(F.transform("_classes", next_of))
        return F.struct(
            F.transform(
                state["given"], lambda n, i: n + (i == chosen["group"]).cast("long")
            ).alias("given"),
            F.array_append(
                state["plan"], F.struct(chosen["index"].alias("index"), chosen["nth"].alias("nth"))
            ).alias("plan"),
        )

    start = F.struct(
        F.transform("_classes", lambda group: F.lit(0).cast("long")).alias("given"),
        F.array().cast("array<struct<index:int,nth:bigint>>").alias("plan"),
    )
    fold = F.aggregate(
        F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda state: state["plan"]
    )
    plan = (
        classes.filter(F.size("_classes") > 0)
        .select(F.posexplode(fold).alias("slot", "_step"))
        .select(F.col("slot").cast("long").alias("slot"), "_step.*")
    )
    places = names.select(F.posexplode("_of").alias("index", "of")).select("index", "of.*")
    # One row per source with a slot: at most MOST_SCHEDULED, or as many as the caller's period.
    return plan.join(F.broadcast(places), "index").select("slot", "_source", "nth", "share")


def _numbered(
    docs: DataFrame, seed: int, id_column: str, source_column: str
) -> tuple[DataFrame, DataFrame]:
    """(`docs` as `_row` with `_source` and `_number`, by source and draw; `_first`, `_rows` a source)."""
    packed = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row"),
        _source(source_column).alias("_source"),
        F.md5(
            F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
        ).alias("_draw"),
    )
    numbered = number_rows(packed, [F.col("_source"), F.col("_draw")], "_number").drop("_draw")
    sources = numbered.groupBy("_source").agg(
        F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    return numbered, frozen(sources)


@dataclass(frozen=True)
class _Schedule:
    """Which slots sources have, for any number of them and any ratio of weights.

    `plan` is the period of the scheduled sources; `light` has the `weight` of those with less than half
    a slot of it or beyond MOST_SCHEDULED. These share slots of their own, which fall between the
    scheduled ones at the rate of their joint weight: `ratio` scheduled slots to one of theirs.
    """

    plan: DataFrame
    period: int
    light: DataFrame | None = None
    ratio: float = 0.0

    def gap(self, light: Column) -> Column:
        """Scheduled slots before the light block of this place."""
        return F.floor((light + 0.5) * self.ratio)

    def final(self, scheduled: Column) -> Column:
        """The slot of the mix for a slot of the plan, repeated without end."""
        if self.light is None:
            return scheduled
        about = F.ceil((scheduled + 1) / self.ratio - 0.5)
        before = (
            F.when(self.gap(about - 1) > scheduled, about - 1)
            .when(self.gap(about) > scheduled, about)
            .otherwise(about + 1)
        )
        return scheduled + F.greatest(before, F.lit(0))


def _schedule(weights: DataFrame, period: int) -> _Schedule:
    """The schedule of `weights` (source, weight), written."""
    # Bounded: the heaviest sources.
    heavy = frozen(weights.orderBy(F.col("weight").desc(), "source").limit(MOST_SCHEDULED))
    period = max(period, SLOTS_PER_SOURCE * heavy.count())
    shares = frozen(_shares(heavy, period).filter("share > 0"))
    plan = frozen(_period_plan(shares, period))
    named = weights.select(_source("source").alias("_source"), "weight")
    scheduled = F.broadcast(shares.select("_source"))
    light = frozen(named.join(scheduled, "_source", "left_anti"))
    rest = light.agg(F.sum("weight")).first()[0]
    if rest is None:
        return _Schedule(plan, period)
    whole = named.join(scheduled, "_source", "left_semi").agg(F.sum("weight")).first()[0]
    return _Schedule(plan, period, light, whole / rest)


def _placed(
    numbered: DataFrame, sources: DataFrame, schedule: _Schedule, block_rows: int
) -> tuple[DataFrame, int | None]:
    """`numbered` with `mix_block` and `mix_slot`, and the first slot whose source lacks a whole block."""
    planned = schedule.plan.select("_source", "share").distinct()
    own = planned.withColumn("weight", F.lit(None).cast("double"))
    if schedule.light is not None:
        own = own.unionByName(schedule.light.withColumn("share", F.lit(None).cast("long")))
    own = frozen(own.join(sources, "_source", "left"))
    known = own.select("_source", "_first", "share", "weight")
    block = F.floor((F.col("_number") - F.col("_first")) / block_rows)
    rows = (
        join_attributes(numbered, known, "_source", "left", fits(known, BROADCAST_ROWS))
        .withColumn("mix_block", block)
        .withColumn("nth", F.col("mix_block") % F.col("share"))
        .join(F.broadcast(schedule.plan), ["_source", "nth", "share"], "left")
    )
    turn = F.floor(F.col("mix_block") / F.col("share")) * schedule.period
    rows = rows.withColumn("mix_slot", schedule.final(turn + F.col("slot")))
    full = F.floor(F.coalesce("_rows", F.lit(0)) / block_rows)
    ends = own.withColumn("_full", full).withColumn("nth", F.col("_full") % F.col("share"))
    at = F.floor(F.col("_full") / F.col("share")) * schedule.period + F.col("slot")
    limits = ends.join(F.broadcast(schedule.plan), ["_source", "nth", "share"]).agg(
        F.min(schedule.final(at))
    )
    limit = limits.first()[0]
    if schedule.light is None:
        return rows, limit
    due = (F.col("mix_block") + 0.5) / F.col("weight")
    starts = rows.filter(
        F.col("weight").isNotNull() & ((F.col("_number") - F.col("_first")) % block_rows == 0)
    ).select("_source", "mix_block", due.alias("_due"))
    order = [F.col("_due"), F.col("_source")]
    places = number_rows(starts, order, "_place").withColumn("_place", F.col("_place") - 1)
    slot = schedule.gap(F.col("_place")) + F.col("_place")
    slots = places.select("_source", "mix_block", slot.alias("_light_slot"))
    rows = rows.join(slots, ["_source", "mix_block"], "left").withColumn(
        "mix_slot", F.coalesce("_light_slot", "mix_slot")
    )
    lacking = F.struct(((F.col("_full") + 0.5) / F.col("weight")).alias("_due"), "_source")
    first = ends.filter("weight is not null").agg(F.min(lacking)).first()[0]
    before = places.filter(F.struct("_due", "_source") < F.struct(*map(F.lit, first))).count()
    at = rows.sparkSession.range(1).select(schedule.gap(F.lit(before)) + before).first()[0]
    return rows, at if limit is None else min(limit, at)


def _unpacked(placed: DataFrame, names: list[str]) -> DataFrame:
    rows = [F.col("_row")[name].alias(name) for name in names]
    return placed.select(*rows, "mix_block", "mix_slot", "mix_kept")


def _all_placed(
    docs: DataFrame, block_rows: int, period: int, seed: int, id_column: str, source_column: str
) -> DataFrame:
    """All rows at `tempered_weights`, with the slots of a schedule in which no source ends."""
    numbered, sources = _numbered(docs, seed, id_column, source_column)
    weights = frozen(tempered_weights(docs, source_column=source_column))
    return _placed(numbered, sources, _schedule(weights, period), block_rows)[0]


def interleave(
    docs: DataFrame,
    block_rows: int = BLOCK_ROWS,
    seed: int = 0,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """All rows of `docs`, sorted by the slots that `mix` gives them without target weights.

    Same columns. Nulls, ties, repeated rows and empty tables are as in `mix`; columns may have any
    names, also `mix_slot`.
    """
    if block_rows < 1:
        raise ValueError("block_rows is at least 1")
    placed = _all_placed(docs, block_rows, PERIOD, seed, id_column, source_column)
    return placed.orderBy("mix_slot", "_number").select(
        *[F.col("_row")[name].alias(name) for name in docs.columns]
    )


def placed_in_order(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """`docs` with their place in their present order in two new columns: file and row, or partition and row.

    A table that is read from files has the order in which it was written; any other that of its
    partitions.
    """
    # A sorted table shows the files below it too, but no longer has their order.
    if docs._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            placed = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
            return docs.select("*", *[x.alias(name) for x, name in zip(placed, names)])
        except AnalysisException as error:
            if not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
    made = {names[0]: F.lit(""), names[1]: F.monotonically_increasing_id()}
    return docs.select("*", *[x.alias(name) for name, x in made.items()])


def slots_in_order(
    docs: DataFrame,
    order: tuple[str, str],
    block_rows: int = BLOCK_ROWS,
    source_column: str = "source",
) -> DataFrame:
    """`docs` with `mix_slot`, the number of their block in the order by the columns `order`.

    Each `block_rows` rows of a source in that order are a block, the last one may be shorter, and
    blocks are numbered from 0 by their first row. Where `interleave` made the order, these are the
    slots that `mix` gives without weights. `order` must be unique. A null source is a source of its own.
    """
    by = [F.col(name) for name in order]
    keyed = docs.drop("mix_slot").withColumn("_source", _source(source_column))
    numbered = number_rows(keyed, [F.col("_source"), *by], "_number")
    firsts = frozen(numbered.groupBy("_source").agg(F.min("_number").alias("_first")))
    small = fits(firsts, BROADCAST_ROWS)
    since = F.col("_number") - F.col("_first")
    rows = (
        join_attributes(numbered, firsts, "_source", "left", small)
        .withColumn("_block", F.floor(since / block_rows))
        .withColumn("_starts", since % block_rows == 0)
    )
    keys = ["_source", "_block"]
    starts = rows.filter("_starts").select(*keys, *order)
    slot = (F.col("_place") - 1).alias("mix_slot")
    slots = number_rows(starts, by, "_place").select(*keys, slot)
    names = [name for name in docs.columns if name != "mix_slot"]
    return rows.join(slots, keys).select(*names, "mix_slot")


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    seed: int = 0,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """`docs` with their place in a mix of the sources by weight.

    The rows of a source, in an order drawn by `seed` and the id, make blocks of `block_rows`. New
    columns: `mix_block` (of the source, from 0), `mix_slot`, `mix_kept`. No row is lost here.

    `weights` maps sources to positive numbers, or is a table (source, weight). Blocks take the slots
    of a Pfair schedule (see `pfair_period`), over and over, and kept are those up to the slot where the
    first source lacks a whole block: there every prefix of the mix holds the weights to within one
    block per source. There are `period` slots, or SLOTS_PER_SOURCE for each source if those are more;
    weights are rounded to whole slots. Sources that are too light for one, and those beyond the
    MOST_SCHEDULED heaviest, share slots that fall between the others at the rate of their weight, and
    take them in the order of the middles of their blocks' windows: such a source has all its rows
    placed, and moves the blocks of others by no more than the slots it takes. Sources not named have no
    slot: `mix_slot` is null.

    Without `weights` all rows are kept, also short last blocks, in the same schedule at
    `tempered_weights`; a source that has run out leaves its slots to the others, and `mix_slot` counts
    the blocks in the order of their slots.

    A null source is a source of its own. Null ids come first, and rows of equal id, repeated rows
    too, lie next to each other in any order. Columns of `docs` named like new ones are replaced. An
    empty table gives an empty result. The numbering is a parallel range sort, so that a source may
    hold any part of the rows.
    """
    if block_rows < 1 or period < 1:
        raise ValueError("block_rows and period are at least 1")
    added = ["mix_block", "mix_slot", "mix_kept"]
    docs = docs.drop(*added)
    spark = docs.sparkSession
    if weights is None:
        rows = _all_placed(docs, block_rows, period, seed, id_column, source_column)
        keys = ["_source", "mix_block"]
        starts = rows.filter((F.col("_number") - F.col("_first")) % block_rows == 0)
        ranks = number_rows(starts.select(*keys, "mix_slot"), [F.col("mix_slot")], "_place")
        slots = ranks.select(*keys, (F.col("_place") - 1).alias("mix_slot"))
        placed = rows.drop("mix_slot").join(slots, keys, "left")
        return _unpacked(placed.withColumn("mix_kept", F.lit(True)), docs.columns)
    if isinstance(weights, Mapping):
        rows = [(source, float(weight)) for source, weight in weights.items()]
        weights = spark.createDataFrame(rows, "source string, weight double")
    known = frozen(weights)
    if known.filter("not weight > 0 or weight is null").limit(1).count():
        raise ValueError("weights must be positive")
    numbered, sources = _numbered(docs, seed, id_column, source_column)
    rows, limit = _placed(numbered, sources, _schedule(known, period), block_rows)
    kept = F.coalesce(F.col("mix_slot") < F.lit(limit or 0), F.lit(False))
    return _unpacked(rows.withColumn("mix_kept", kept), docs.columns)
