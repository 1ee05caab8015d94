"""SimHash near-duplicate groups by a Gray-order hierarchical index.

A fingerprint has a bit for each bit that is set in over half the hashes of the
text's word shingles.  Distinct fingerprints are sorted by their rank in Gray
order, where neighbours agree in most bits.  Groups of neighbours make the
nodes of a hierarchical index: a node holds the bits that all its members share
and that its parent does not hold already.  A search goes down from the top and
adds up the differences to these shared patterns; a node where the sum exceeds
the allowed distance is dropped with its whole group.

Codes that differ in at most d bits agree in whole in one of d + 1 segments of
their bits.  So each fingerprint is entered once for each order of bits that has
one segment on top (or, for more rows, d + s segments and every choice of s of
them): those that agree in the top bits are neighbours in the Gray order of the
moved bits, and a search drops a node as soon as it shares a top bit that differs.

The entries are range-partitioned by order and Gray rank into blocks.  A block is
searched by itself; two blocks are a pair only if the top bits of the last entry
of one are those of the first of the other and their shared patterns are near.
Each block or pair is a unit of work, which reports a spanning forest of the
links it finds, not all pairs.  The components of these links are the groups.

Scale: texts are read once and not shuffled.  Equal fingerprints are one entry
with the smallest id, so copies cost nothing further.  A fingerprint is shuffled
once for each order (5 at 4 bits up to 10^9 rows, then 15).  Blocks have about
``BLOCK_ROWS`` entries; their number grows with the rows, and so does that of the
pairs, but for blocks of one top value, which are paired with each other where
their patterns do not tell them apart.  Nothing is collected or broadcast by hand.

Defined results: null, empty and white-space texts have no words and the
fingerprint zero, which is linked like any other; a text of fewer words than a
shingle is one shingle; rows that repeat are each in the group; a null id is
never a group's id (a group of null ids only has a null id); an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.joins import nullsafe_join
from ledgerlens.llm.common import drop_worker_tables, map_batches, parts, pick, row_key
from ledgerlens.llm.components import connected_components
from ledgerlens.session import materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Entries of a block, and blocks that even a small table is dealt to.
BLOCK_ROWS = 1 << 18
LEAST_BLOCKS = 16
#: Orders of bits that may be used, and the distance beyond which segments are too short to help.
MOST_ORDERS = 64
MOST_SEGMENT_BITS = 15
#: Children of a node, fingerprints that are searched for at once, and nodes that they may be compared with at once.
FAN_OUT = 4
SEARCHED = 4096
WIDEST = 1 << 20
#: Shingles hashed at once.
HASHED = 100_000


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> bytes:
    """The fingerprint of a text, 8 bytes with the highest bit first."""
    import xxhash

    tokens = text.lower().split()  # of bytes: lowers A-Z, splits at space and 0x09-0x0D
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = max(0, len(tokens) - words)
    firsts, ends = starts[: last + 1].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(firsts), HASHED):
        spans = map(slice, firsts[k : k + HASHED], ends[k : k + HASHED])
        hashes = np.array([digest(s, SEED) for s in map(joined.__getitem__, spans)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(firsts)).tobytes()


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, keyed: bool = False) -> DataFrame:
    """doc_id and the fingerprint as a (signed) long; if ``keyed``, the row key as well."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_tables()
        for batch in parts(batches):
            found = b"".join(fingerprint(t or b"", words) for t in batch.column(1).to_pylist())
            column = pa.array(np.frombuffer(found, ">i8").astype(np.int64))
            columns = [batch.column(0), column, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fingerprint", "row_key"][: len(columns)])

    more = [row_key(F.col("doc_id"), F.col("text")).alias("row_key")] if keyed else []
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *more)
    return map_batches(rows, work, "doc_id long, fingerprint long" + ", row_key binary" * keyed)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code (uint64) in Gray order."""
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """Hierarchical index over distinct codes; ``codes`` holds them in Gray order."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        full = np.full(len(codes), ~np.uint64(0))
        levels = [(self.codes, full)]
        while len(levels[-1][0]) > FAN_OUT:
            pattern, mask = levels[-1]
            first = pattern[::FAN_OUT]
            groups = np.arange(0, len(pattern), FAN_OUT)
            own = np.repeat(first, FAN_OUT)[: len(pattern)]
            differs = np.bitwise_or.reduceat((pattern ^ own) | ~mask, groups)
            levels.append((first & ~differs, ~differs))
        # A node keeps the bits that its parent does not hold.
        self.levels = []
        for k, (pattern, mask) in enumerate(levels):
            above = levels[k + 1][1] if k + 1 < len(levels) else np.zeros(-(-len(mask) // FAN_OUT), np.uint64)
            self.levels.append((pattern, mask & ~np.repeat(above, FAN_OUT)[: len(mask)]))

    def _descend(self, queries: np.ndarray, distance: int, top_bits: np.uint64) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs for a few queries, or None if these are too many at once."""
        top = len(self.levels[-1][0])
        query = np.repeat(np.arange(len(queries), dtype=np.int32), top)
        node = np.tile(np.arange(top, dtype=np.int32), len(queries))
        gone = np.zeros(len(query), np.uint8)
        for k in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[k]
            differs = (queries[query] ^ pattern[node]) & mask[node]
            gone = gone + np.bitwise_count(differs)
            near = (gone <= distance) & ((differs & top_bits) == 0)
            query, node, gone = query[near], node[near], gone[near]
            if k:
                if len(node) * FAN_OUT > WIDEST and len(queries) > 1:
                    return None
                below = len(self.levels[k - 1][0])
                node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT, dtype=np.int32)).ravel()
                query, gone = np.repeat(query, FAN_OUT), np.repeat(gone, FAN_OUT)
                if len(node) and node.max() >= below:
                    inside = node < below
                    query, node, gone = query[inside], node[inside], gone[inside]
        return query, node

    def pieces(self, queries: np.ndarray, distance: int, top_bits: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place among the queries, place among the codes) that differ in at most ``distance`` bits
        and in none of ``top_bits``, in pieces of bounded size."""
        todo = [(k, min(k + SEARCHED, len(queries))) for k in range(0, len(queries), SEARCHED)]
        while todo:
            begin, end = todo.pop()
            found = self._descend(queries[begin:end], distance, np.uint64(top_bits))
            if found is None:
                middle = (begin + end) // 2
                todo += [(begin, middle), (middle, end)]
            else:
                yield found[0].astype(np.int64) + begin, found[1].astype(np.int64)

    def within(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of ``pieces``."""
        found = [*self.pieces(queries, distance), (np.zeros(0, np.int64),) * 2]
        return tuple(np.concatenate(side) for side in zip(*found))


class Forest:
    """Components of the numbers 0 .. n-1 under links that arrive in arrays."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up


class BitOrder:
    """An order of the 64 bits: segments (shift, width) from the top on, of which the first ``key_bits`` bits must agree."""

    def __init__(self, segments: list[tuple[int, int]], key_bits: int) -> None:
        self.segments, self.key_bits = segments, key_bits
        self.top_bits = ((1 << key_bits) - 1) << (64 - key_bits)

    def moved(self, codes: np.ndarray) -> np.ndarray:
        out, below = np.zeros_like(codes), 64
        for shift, width in self.segments:
            below -= width
            out |= ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)) << np.uint64(below)
        return out

    def restored(self, moved: np.ndarray) -> np.ndarray:
        out, below = np.zeros_like(moved), 64
        for shift, width in self.segments:
            below -= width
            out |= ((moved >> np.uint64(below)) & np.uint64((1 << width) - 1)) << np.uint64(shift)
        return out


def bit_orders(distance: int, rows: int) -> list[BitOrder]:
    """Orders such that codes within ``distance`` bits agree in the top bits of at least one.

    More segments, and so longer keys, the more rows there are: a key of evenly
    spread codes has at most about a block of them.
    """
    if distance > MOST_SEGMENT_BITS:
        return [BitOrder([(0, 64)], 0)]
    m = distance + 1
    while rows >> (64 * (m - distance) // m) > BLOCK_ROWS and math.comb(m + 1, distance) <= MOST_ORDERS:
        m += 1
    ends = [64 * i // m for i in range(m + 1)]
    segments = [(64 - end, end - begin) for begin, end in zip(ends, ends[1:])]
    orders = []
    for top in combinations(segments, m - distance):
        orders.append(BitOrder([*top, *(s for s in segments if s not in top)], sum(width for _, width in top)))
    return orders


def _ranked(orders: list[BitOrder]):
    """For each code and order the rank in the Gray order of the moved bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            for number, order in enumerate(orders):
                rank = pa.array(gray_rank(order.moved(codes)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), number, np.int32)), rank], names=["order", "rank"])

    return work


def _blocks_of(orders: list[BitOrder]):
    """A row for each order in a partition: its codes (bits moved) by rank, what they share, and their first and last key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not columns:
            return
        numbers, ranks = map(np.concatenate, zip(*columns))
        for number in np.unique(numbers):
            rank = np.sort(ranks[numbers == number]).view(np.uint64)  # by sign first, as the ranges are
            codes = rank ^ (rank >> np.uint64(1))
            differs = np.bitwise_or.reduce(codes ^ codes[0])
            keys = codes[[0, -1]] & np.uint64(orders[number].top_bits)
            facts = np.array([*keys, codes[0] & ~differs, ~differs]).view(np.int64)
            row = [pa.array([number], pa.int32()), *(pa.array([x]) for x in facts), pa.array([codes.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["order", "first", "last", "pattern", "mask", "codes"])

    return work


def _paired(blocks: DataFrame, distance: int) -> DataFrame:
    """Each block with itself, and with later ones that go on with its last key and whose pattern may be near its own."""
    one = blocks.select("order", "block", F.col("last").alias("key"), "pattern", "mask")
    two = blocks.select(
        "order", F.col("block").alias("other"), F.col("first").alias("key"),
        F.col("pattern").alias("other_pattern"), F.col("mask").alias("other_mask"),
    )
    differs = F.col("pattern").bitwiseXOR(F.col("other_pattern")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("other_mask"))
    pairs = one.join(two, ["order", "key"]).where((F.col("block") < F.col("other")) & (F.bit_count(differs) <= distance))
    alone = blocks.select("order", "block", F.col("block").alias("other"))
    return alone.unionByName(pairs.select("order", "block", "other"))


def _search(orders: list[BitOrder], distance: int):
    """A spanning forest of the links inside a block or between two."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        order = orders[pdf["order"].iloc[0]]
        sides = [np.frombuffer(c, np.uint64) for _, c in sorted(zip(pdf["side"], pdf["codes"]))]
        if (pdf["block"] == pdf["other"]).all():
            index = GrayIndex(sides[0])
            queries, every, shift = index.codes, index.codes, 0
        else:
            top_bits = np.uint64(order.top_bits)
            key = sides[0][-1] & top_bits
            mine, queries = (codes[codes & top_bits == key] for codes in sides)
            index = GrayIndex(mine)
            every, shift = np.concatenate([index.codes, queries]), len(mine)
        forest = Forest(len(every))
        for query, node in index.pieces(queries, distance, order.top_bits):
            forest.link(query + shift, node)
        child = np.flatnonzero(forest.parent != np.arange(len(every)))
        ends = order.restored(every[child]), order.restored(every[forest.parent[child]])
        return pd.DataFrame({"a": ends[0].view(np.int64), "b": ends[1].view(np.int64)})

    return search


def links_within(distinct: DataFrame, distance: int) -> DataFrame:
    """A spanning forest (a, b) of the links, per pair of blocks; ``distinct`` has a column ``fingerprint``."""
    rows = distinct.count()
    orders = bit_orders(distance, rows)
    n_blocks = max(LEAST_BLOCKS, -(-rows * len(orders) // BLOCK_ROWS))
    ranked = distinct.select("fingerprint").mapInArrow(_ranked(orders), "order int, rank long")
    blocks = ranked.repartitionByRange(n_blocks, "order", "rank").mapInArrow(
        _blocks_of(orders), "order int, first long, last long, pattern long, mask long, codes binary"
    )
    blocks = materialize(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "gray-blocks")
    paired = materialize(_paired(blocks, distance), "block-pairs")
    codes = blocks.select("block", "codes")
    one = paired.join(codes, "block").select("order", "block", "other", F.lit(0).alias("side"), "codes")
    two = paired.join(codes.withColumnRenamed("block", "other"), "other").select(
        "order", "block", "other", F.lit(1).alias("side"), "codes"
    )
    # A set number of tasks: the work of a pair is not told by its bytes.
    units = one.unionByName(two).repartition(2 * n_blocks, "order", "block", "other")
    return units.groupBy("order", "block", "other").applyInPandas(_search(orders, distance), "a long, b long")


def _placed(rows: DataFrame, first: Column, distance: int) -> DataFrame:
    """fingerprint, ``first`` over its rows and its component."""
    distinct = materialize(rows.groupBy("fingerprint").agg(first), "distinct-fingerprints")
    found = connected_components(links_within(distinct, distance))
    placed = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", *distinct.columns[1:], F.coalesce("component", "fingerprint").alias("component")
    )
    return materialize(placed, "fingerprint-components")


def first_rows(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_BITS) -> DataFrame:
    """row_key of the first row of each group: the smallest id (null ones last), then the smallest row key."""
    rows = materialize(fingerprints(docs, words, keyed=True), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row_key")).alias("first")
    firsts = _placed(rows, first, distance).groupBy("component").agg(F.min("first").alias("first"))
    return firsts.select("first.row_key")


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id of the document's group)."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    placed = _placed(rows, F.min("doc_id").alias("first_id"), distance)
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(named, "component").select("fingerprint", "component_id")
    return nullsafe_join(rows, named, ["fingerprint"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
