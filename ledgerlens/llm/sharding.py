"""Sharding by a k-d tree over document metadata.

Documents with equal texts form a unit, with the unit's bytes as its weight and
its metadata as its point: language, source, length and place in the table.
Starting from one node for all units, each node is split at the weighted median
of the dimension in which its units spread widest, until every leaf has about
the target bytes.  A node that must give an odd number of leaves is split in
that proportion instead of in halves.

Medians are found for all nodes of a level at once, by histograms: a bounded
number of bins per node comes back from each pass, and the bin that holds the
median is divided again until it weighs next to nothing.  Points that tie in a
dimension are ordered by a hash of the text, so that a source that holds a
third of the rows still splits where the bytes ask for it.

A unit is kept together unless it alone weighs more than ``MAX_UNIT_SHARE`` of
a shard; heavier groups of copies are dealt to parts by a hash of the id, since
otherwise shards could not be near equal.

Scale: the texts are read once for their size and hash and never shuffled.
Units come from partial aggregation.  The driver holds the tree (fewer splits
than shards) and the bins of one level.  Slots are numbered by range
partitions, not by a window over a whole shard.

Defined results: a null text has no bytes (size 8) and shares a unit with empty
texts; null language or source is a value of its own; rows that repeat are
placed each by itself, with slots of their own; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.joins import nullsafe_join
from ledgerlens.functions.ordered import row_numbers
from ledgerlens.llm.common import pick
from ledgerlens.session import materialize

ROW_BYTES = 8
#: A group of equal texts heavier than this share of a shard is dealt to parts.
MAX_UNIT_SHARE = 0.05
#: A cut is exact enough once its bin weighs less than this share of a shard.
TOLERANCE = 0.0005
BINS = 1024
DIMENSIONS = ("lang", "source", "length", "place")
_CODE_BITS, _TIE_BITS = 31, 31


def _weigh(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + ROW_BYTES
    code = lambda c: F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), 64 - _CODE_BITS)
    return pick(docs, "doc_id", "text", "lang", "source").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("group"),
        code("lang").alias("lang"),
        code("source").alias("source"),
    )


def _scaled(c: Column, low: float, high: float) -> Column:
    return (((c - F.lit(low)) / F.lit(max(high - low, 1e-9))) * F.lit((1 << _CODE_BITS) - 1)).cast("long")


def _units(rows: DataFrame, heaviest: float) -> tuple[DataFrame, DataFrame]:
    """Units (with a point each) and, for the groups that are split, their number of parts."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    parts = groups.where(F.col("bytes") > heaviest).select(
        "group", F.ceil(F.col("bytes") / F.lit(heaviest)).cast("int").alias("parts")
    )
    part = F.when(
        F.col("parts").isNotNull(), F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(7)), F.col("parts"))
    ).otherwise(F.lit(0))
    # At most total / heaviest = shards / MAX_UNIT_SHARE groups are that heavy.
    placed = rows.join(F.broadcast(parts), "group", "left").select(*rows.columns, part.cast("int").alias("part"))
    placed = materialize(placed, "shard-rows")
    units = placed.groupBy("group", "part").agg(
        F.sum("size").alias("bytes"),
        F.min("lang").alias("lang"),
        F.min("source").alias("source"),
        F.log(F.max("size")).alias("length"),
        F.min("doc_id").cast("double").alias("place"),
    )
    return placed, units


def _points(units: DataFrame) -> DataFrame:
    """Each dimension as one whole number: its code, then a hash that orders ties."""
    low_high = units.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("length", "place") for n, f in (("low", F.min), ("high", F.max))]
    ).first()
    tie = F.shiftrightunsigned(F.xxhash64("group", "part"), 64 - _TIE_BITS)
    scaled = {
        c: _scaled(F.coalesce(c, F.lit(low_high[f"low_{c}"] or 0.0)), low_high[f"low_{c}"] or 0.0, low_high[f"high_{c}"] or 1.0)
        for c in ("length", "place")
    }
    code = lambda c: F.shiftleft(scaled.get(c, F.col(c)), _TIE_BITS) + tie
    return units.select("group", "part", "bytes", *[code(c).alias(c) for c in DIMENSIONS])


def _in_node(tree: dict[int, tuple[str, int]]) -> Column:
    """The leaf of a unit, given the splits so far; node n has the children 2n and 2n+1."""

    def below(node: int) -> Column:
        if node not in tree:
            return F.lit(node).cast("long")
        dimension, cut = tree[node]
        return F.when(F.col(dimension) < F.lit(cut), below(2 * node)).otherwise(below(2 * node + 1))

    return below(1)


def _cuts(points: DataFrame, tree: dict, wanted: dict[int, tuple[str, int, int, float]], close: float) -> dict[int, int]:
    """For each node: the smallest cut of its dimension with about the wanted bytes below it."""
    todo = {n: {"dim": d, "low": lo, "high": hi + 1, "goal": goal} for n, (d, lo, hi, goal) in wanted.items()}
    done: dict[int, int] = {}
    node = _in_node(tree)
    while todo:
        for x in todo.values():
            x["step"] = max(1, -(-(x["high"] - x["low"]) // BINS))
        table = lambda k: F.create_map(*[F.lit(v) for n, x in todo.items() for v in (n, x[k])])[F.col("_node")]
        value = F.coalesce(*[F.when(table("dim") == d, F.col(d)) for d in DIMENSIONS])
        binned = (
            points.withColumn("_node", node)
            .where(F.col("_node").isin(*todo))
            .withColumn("_value", value)
            .where((F.col("_value") >= table("low")) & (F.col("_value") < table("high")))
            .withColumn("_bin", F.floor((F.col("_value") - table("low")) / table("step")))
        )
        # At most BINS rows per node.
        rows = binned.groupBy("_node", "_bin").agg(F.sum("bytes").alias("bytes")).collect()
        for n, x in list(todo.items()):
            below = 0
            for b, size in sorted((r["_bin"], r["bytes"]) for r in rows if r["_node"] == n):
                if below + size >= x["goal"]:
                    break
                below += size
            start, end = x["low"] + b * x["step"], x["low"] + (b + 1) * x["step"]
            if size <= close or x["step"] == 1:
                # The median lies in this bin: cut at its nearer edge.
                done[n] = end if below + size - x["goal"] <= x["goal"] - below else start
                del todo[n]
            else:
                x.update(low=start, high=min(end, x["high"]), goal=x["goal"] - below)
    return done


def kd_tree(points: DataFrame, n_leaves: int) -> tuple[dict[int, tuple[str, int]], dict[int, int]]:
    """The splits, and the number of each leaf from 0 to ``n_leaves`` - 1."""
    tree: dict[int, tuple[str, int]] = {}
    leaves = {1: n_leaves}
    spread: dict[str, float] = {}
    while open_nodes := [n for n, k in leaves.items() if k > 1]:
        facts = (
            points.groupBy(_in_node(tree).alias("_node"))
            .agg(
                F.sum("bytes").alias("bytes"),
                *[f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))],
            )
            .collect()  # one row per node
        )
        facts = {r["_node"]: r for r in facts}
        total = sum(r["bytes"] for r in facts.values())
        if not spread:
            spread = {c: max(1, facts[1][f"high_{c}"] - facts[1][f"low_{c}"]) for c in DIMENSIONS} if facts else {}
        wanted = {}
        for n in open_nodes:
            if n in facts:
                r, k = facts[n], leaves[n]
                widest = max(DIMENSIONS, key=lambda c: (r[f"high_{c}"] - r[f"low_{c}"]) / spread[c])
                wanted[n] = (widest, r[f"low_{widest}"], r[f"high_{widest}"], r["bytes"] * (k // 2) / k)
        for n, cut in _cuts(points, tree, wanted, TOLERANCE * total / n_leaves).items():
            tree[n] = (wanted[n][0], cut)
        for n in open_nodes:
            k = leaves.pop(n)
            if n in wanted:  # a node without units has no leaves to fill
                leaves[2 * n], leaves[2 * n + 1] = k // 2, k - k // 2
    return tree, {n: i for i, n in enumerate(sorted(leaves, key=lambda n: bin(n)[3:]))}


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    ``docs`` has doc_id, text, lang and source.  Give the number of shards, or
    the bytes that a shard should have.
    """
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give n_shards or target_bytes")
    rows = materialize(_weigh(docs), "shard-weights")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_shards = n_shards or max(1, -(-total // target_bytes))
    placed, units = _units(rows, max(1.0, MAX_UNIT_SHARE * total / n_shards))
    points = materialize(_points(units), "shard-points")
    tree, number = kd_tree(points, n_shards) if total else ({}, {1: 0})
    leaf = F.create_map(*[F.lit(v) for n, i in number.items() for v in (n, i)])[F.col("_node")]
    where = points.withColumn("_node", _in_node(tree)).select("group", "part", leaf.cast("int").alias("shard"))
    sharded = nullsafe_join(placed, where, ["group", "part"])
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.xxhash64("group", "lang", "source")]
    return row_numbers(sharded.drop("part"), ["shard"], order, "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
