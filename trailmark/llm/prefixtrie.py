"""Prefix trie of sequences, built by van Emde Boas recursion.

Sequences are cut at half depth. The cut prefixes get names; the upper halves form the trie above
the cut, the lower halves one trie below each cut prefix. Both kinds have half the depth and are
built the same way, side by side: one round of Spark jobs handles all subtries of a depth at once.

1. *Naming, upwards*: blocks of 1, 2, 4, ... aligned steps are named from the names of their halves.
2. *Cutting, downwards*: a path below a node is cut into its upper and lower half at the node that
   the upper half's name leads to. Equal paths below one node are merged, with their members counted,
   before the next cut, so shared prefixes are handled once. The last round holds every node.
3. *Grafting, upwards*: the totals of the tries below the cuts are added to the trie above them, then
   each cut takes what continues below its own trie.

A round works on rows of (path, node), at most steps / block length of them, so all rounds together
read each step a constant number of times. No sequence and no node is ever held as a whole: a sequence
with a third of all steps and a node shared by a third of all sequences are rows like others.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.keyed import NAME_BYTES, framed, lookup, name_of
from trailmark.operators.freeze import frozen
from trailmark.operators.ordered import GROUP_ROWS, heavy_keys, numbered, ordered_metrics

_ROOT = bytes(NAME_BYTES)
_SEED = "struct<level:int,place:bigint,under:binary,node:binary,weight:bigint>"
_EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def conversation_steps(
    turns: DataFrame, group_rows: int | None = GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(`member`, `place`, `name`, `weight`) per turn and (`member`, `n_steps`) per conversation.

    Turns are ordered by `turn`, null first; equal turns by role, then by text, in byte order, so
    repeated rows are steps of their own. A null role or text is empty. Rows without a conv_id belong
    to no conversation. A step's name stands for its role and text, its weight is the text's code
    points. Of `turns` only conv_id, turn, role and text are read.
    """
    kept = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("member"),
        "turn",
        *[F.coalesce(name, F.lit("")).alias(name) for name in ("role", "text")],
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    heavy = heavy_keys(kept, ["member"], group_rows)
    placed = ordered_metrics(kept, ["member"], order, {"place": numbered()}, heavy)
    steps = frozen(
        placed.select(
            "member",
            (F.col("place") - 1).alias("place"),
            name_of(framed(F.col("role")), F.col("text")).alias("name"),
            F.char_length("text").cast("long").alias("weight"),
        )
    )
    return steps, frozen(steps.groupBy("member").agg(F.count(F.lit(1)).alias("n_steps")))


def with_shared_heads(
    steps: DataFrame, members: DataFrame, leader: Column, heads: Column, most: int
) -> DataFrame:
    """`steps` in which the first `heads` steps of a member are those of its `leader`.

    Both columns are computed from `member`, and `heads` is at most `most`. A leader with fewer steps
    gives all it has, an absent one none; the member's own steps after its first `heads` follow.
    """
    led = frozen(members.select("member", leader.alias("leader"), heads.alias("heads")))
    first = steps.filter(F.col("place") < most).withColumnRenamed("member", "leader")
    wanted = led.select("leader").distinct()
    first = frozen(first.join(wanted, "leader", "left_semi"))
    lengths = frozen(first.groupBy("leader").agg(F.count(F.lit(1)).alias("n_head")))
    given = led.join(first, "leader").filter(F.col("place") < F.col("heads"))
    own = steps.withColumns({"leader": leader, "heads": heads}).filter("place >= heads")
    n_head = F.least(F.coalesce("n_head", F.lit(0)), F.col("heads"))
    moved = lookup(own, lengths, "leader", "left").withColumn(
        "place", F.col("place") - F.col("heads") + n_head
    )
    columns = ["member", "place", "name", "weight"]
    return moved.select(*columns).unionByName(given.select(*columns))


def prefix_trie(steps: DataFrame, members: DataFrame) -> DataFrame:
    """One row per distinct prefix of the members' steps, the empty one included.

    `steps` has `member` (long), `place` (0-based, without gaps), `name` (16 bytes that stand for the
    step's content) and `weight` (long, a function of the name); `members` the distinct `member` ids,
    also of members without steps. Returns, all long but the last: `member` (smallest with the prefix),
    `depth`, `parent` (the smallest member with the prefix one step shorter; null at the root),
    `n_members`, `n_children`, `n_leaves` (nodes without children in the subtree, which includes its
    top), `saved` (sum over the subtree of (n_members - 1) * weight of the node's last step) and
    `ends_sha256`, the hash of the ids of members that end at the node, ascending, joined by commas.
    Without members there are no rows.
    """
    pairs, tails = _named_blocks(steps)
    chains = frozen(_chains(tails))
    levels = _cut_paths(pairs, chains)
    root = frozen(
        members.agg(F.min("member").alias("member"), F.count(F.lit(1)).alias("n_members")).filter(
            "n_members > 0"
        )
    )
    ended = chains.select("member", F.col("chain.at").alias("node"))
    ends = members.select("member").join(ended, "member", "left").select(
        "member", F.coalesce("node", F.lit(_ROOT)).alias("node")
    )
    ends = frozen(_ends(ends))
    nodes = levels[0].withColumn("depth", F.col("place") + 1).drop("place")
    top = root.select(
        F.lit(None).cast("binary").alias("under"),
        F.lit(_ROOT).alias("node"),
        "n_members",
        "member",
        F.lit(0).cast("long").alias("weight"),
        F.lit(0).cast("long").alias("depth"),
    )
    children = nodes.groupBy(F.col("under").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = frozen(
        nodes.unionByName(top)
        .join(children, "node", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", (F.col("n_members") - 1) * F.col("weight"))
        .drop("weight")
    )
    named = nodes.select(F.col("node").alias("under"), F.col("member").alias("parent"))
    whole = (
        nodes.join(_below(levels, nodes), "node", "left")
        .join(ends, "node", "left")
        .select(
            "under",
            "member",
            "depth",
            "n_members",
            "n_children",
            (F.col("leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved"),
            F.coalesce("ends_sha256", F.lit(_EMPTY_SHA256)).alias("ends_sha256"),
        )
    )
    return lookup(frozen(whole), named, "under", "left").select(
        "member", "depth", "parent", "n_members", "n_children", "n_leaves", "saved", "ends_sha256"
    )


def _named_blocks(steps: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Halves of the blocks of 2, 4, 8, ... steps, and the blocks that no longer block holds.

    The second are, for each member, the binary digits of its length.
    """
    blocks = frozen(steps.select("member", "place", "name", "weight"))
    longest = blocks.agg(F.max("place")).first()[0]
    pairs: list[DataFrame] = []
    tails: list[DataFrame] = []
    for level in range(0 if longest is None else (longest + 1).bit_length()):
        half = F.shiftright("place", 1).alias("place")
        left = blocks.filter("place % 2 = 0").select(
            "member", half, F.col("name").alias("left"), F.col("weight").alias("left_weight")
        )
        right = blocks.filter("place % 2 = 1").select(
            "member", half, F.col("name").alias("right"), F.col("weight").alias("right_weight")
        )
        both = frozen(left.join(right, ["member", "place"], "left"))
        tails.append(
            both.filter(F.col("right").isNull()).select(
                "member",
                F.lit(level).alias("level"),
                (F.col("place") * 2).alias("place"),
                F.col("left").alias("name"),
                F.col("left_weight").alias("weight"),
            )
        )
        pairs.append(both.filter(F.col("right").isNotNull()))
        blocks = pairs[-1].select(
            "member",
            "place",
            name_of(F.col("left"), F.col("right")).alias("name"),
            F.lit(None).cast("long").alias("weight"),
        )
    if not tails:
        tails = [blocks.withColumn("level", F.lit(0))]
    return pairs, functools.reduce(DataFrame.unionByName, tails)


def _chains(tails: DataFrame) -> DataFrame:
    """Per member its few blocks, longest first, each with the node above and the node it leads to."""
    block = F.struct((-F.col("level")).alias("order"), "place", "name", "weight")
    start = F.struct(
        F.lit(_ROOT).alias("at"), F.array().cast(f"array<{_SEED}>").alias("seeds")
    )

    def follow(done: Column, block: Column) -> Column:
        node = name_of(done["at"], block["name"])
        seed = F.struct(
            (-block["order"]).cast("int").alias("level"),
            block["place"].alias("place"),
            done["at"].alias("under"),
            node.alias("node"),
            block["weight"].alias("weight"),
        )
        return F.struct(node.alias("at"), F.concat(done["seeds"], F.array(seed)).alias("seeds"))

    return tails.groupBy("member").agg(
        F.aggregate(F.array_sort(F.collect_list(block)), start, follow).alias("chain")
    )


def _cut_paths(pairs: list[DataFrame], chains: DataFrame) -> list[DataFrame]:
    """For each level the distinct paths of 2 ** level steps: `under` (node above), `node` (at its
    end), `place` (in such paths from the root), `n_members`, `member` (smallest), `weight`."""
    seeds = frozen(chains.select("member", F.explode("chain.seeds").alias("s")).select("member", "s.*"))
    levels: list[DataFrame] = []
    above = None
    for level in reversed(range(max(len(pairs), 1))):
        upper = seeds.filter(F.col("level") == level).select(
            "under", "node", "place", F.lit(1).cast("long").alias("n_members"), "member", "weight"
        )
        lower = None
        if above is not None:
            # A node's smallest member and its place identify it, so both sides are unique here.
            halves = above.drop("weight").join(pairs[level], ["member", "place"])
            cut = halves.withColumn("middle", name_of(F.col("under"), F.col("left")))
            upper = upper.unionByName(
                cut.select(
                    "under",
                    F.col("middle").alias("node"),
                    (F.col("place") * 2).alias("place"),
                    "n_members",
                    "member",
                    F.col("left_weight").alias("weight"),
                )
            )
            lower = cut.select(
                F.col("middle").alias("under"),
                "node",
                (F.col("place") * 2 + 1).alias("place"),
                "n_members",
                "member",
                F.col("right_weight").alias("weight"),
            )
        merged = upper.groupBy("under", "node", "place").agg(
            F.sum("n_members").alias("n_members"),
            F.min("member").alias("member"),
            F.max("weight").alias("weight"),
        )
        above = frozen(merged if lower is None else merged.unionByName(lower))
        levels.insert(0, above)
    return levels


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _below(levels: list[DataFrame], nodes: DataFrame) -> DataFrame:
    """`leaves_below` and `saved_below` of each `node` with children, itself not counted."""
    # inside[k]: totals of the trie of height 2 ** k below each node at a multiple of that depth.
    first = nodes.filter("depth > 0").select(
        F.col("under").alias("node"), (F.col("depth") - 1).alias("at"), "leaves", "saved"
    )
    inside = [frozen(_summed(first, "node", "at"))]
    for paths in levels:
        grafted = (
            paths.filter("place % 2 = 0")
            .select("under", "node", (F.col("place") / 2).cast("long").alias("at"))
            .join(inside[-1].drop("at"), "node")
            .select(F.col("under").alias("node"), "at", "leaves", "saved")
        )
        own = inside[-1].filter("at % 2 = 0").withColumn("at", F.shiftright("at", 1))
        inside.append(frozen(_summed(own.unionByName(grafted), "node", "at")))
    known = inside.pop().drop("at")
    for paths, trie in zip(reversed(levels), reversed(inside)):
        further = (
            paths.filter("place % 2 = 1")
            .select("under", "node")
            .join(known, "node")
            .select(F.col("under").alias("node"), "leaves", "saved")
        )
        own = trie.filter("at % 2 = 1").drop("at")
        known = known.unionByName(frozen(_summed(own.unionByName(further), "node")))
    return known.toDF("node", "leaves_below", "saved_below")


def _ends(ends: DataFrame) -> DataFrame:
    """`ends_sha256` per `node`: its members' ids are joined in pieces, cut by the order alone, and
    each node's pieces are hashed as they pass by."""
    pieces = (
        ends.repartitionByRange("node", "member")
        .sortWithinPartitions("node", "member")
        .mapInArrow(_pieces, "node binary, first long, ids binary")
    )
    return (
        pieces.repartition("node")
        .sortWithinPartitions("node", "first")
        .mapInArrow(_hashed, "node binary, ends_sha256 string")
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("node").to_pylist(), batch.column("member").to_pylist())
        found = []
        for node, members in groupby(pairs, lambda pair: pair[0]):
            ids = [member for _, member in members]
            found.append((node, ids[0], ",".join(map(str, ids)).encode()))
        nodes, first, ids = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(first, pa.int64()), pa.array(ids, pa.binary())],
            ["node", "first", "ids"],
        )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
        nodes, hashes = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], ["node", "ends_sha256"]
        )

    node, running = None, None
    for batch in batches:
        found = []
        for other, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if other == node:
                running.update(b",")
            else:
                if node is not None:
                    found.append((node, running.hexdigest()))
                node, running = other, hashlib.sha256()
            running.update(ids)
        yield made(found)
    if node is not None:
        yield made([(node, running.hexdigest())])
