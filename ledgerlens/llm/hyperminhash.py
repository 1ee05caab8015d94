"""Near-duplicate groups by HyperMinHash.

A document's set are the distinct shingles of its words.  For every bucket, each
with a hash function of its own so that short documents fill all of them too,
the sketch keeps the smallest hash of the set in compressed form: the number of
its leading zeros and the ``MANTISSA`` bits behind the first one.  Registers are
banded: documents that agree in all registers of a band are candidates.  The
share of equal registers, corrected for the equal ones that different hashes
give by chance, estimates the Jaccard similarity; candidates far below the
threshold end there, all others are verified on the full sets of shingles.

Which candidates are compared.  Documents of the same set are one entry.  In a
bucket of a band every entry is compared with the bucket's leader, which differs
from band to band.  Verified links make components.  An entry of a bucket that
is still in another component than others of it is then compared with all of
these on the full sets, in blocks of bounded size that count common shingles by
an inverted index and report the links that join components, never all pairs.
So a group of near copies, a third of all rows maybe, costs a few comparisons an
entry, and still no two entries of a bucket end up in different components
without having been compared.

What can be lost: a pair at the threshold agrees in no band with a chance of
3e-8 at J = 0.85 (``BANDS`` bands of ``ROWS`` registers), and is estimated lower
than ``threshold - MARGIN`` with a chance below 1e-7.  Other pairs above the
threshold have smaller chances.  There is no cap on candidates.

Scale: texts are read in one narrow pass; bands are 28 bytes an entry and band.
Only texts of entries with candidates are shuffled: a bitmap of fixed size over
their keys (``FILTER_BITS``, the only broadcast) sorts out the others before, and
what it lets through by chance goes with the join.

Defined results: null, empty and white-space texts have an empty set and are
linked with nothing; a text of fewer words than a shingle is one shingle; rows
that repeat are each in the group; a null id is never a group's id (a group of
null ids only has a null id, and all its rows count as kept); an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import parts, pick, row_key
from ledgerlens.llm.components import connected_components
from ledgerlens.session import materialize

#: The corpus default; op11 has its own.
SHINGLE_WORDS = 5
PERCENT = 80
#: Bands of a sketch and registers of a band.
BANDS, ROWS = 30, 5
BUCKETS = BANDS * ROWS
#: Bits behind the leading one that a register keeps (of 16; the others count zeros).
MANTISSA = 10
#: How far below the threshold an estimate may be for its pair still to be verified: more than 5 standard deviations.
MARGIN = 0.18
#: Rounds of comparing with leaders before the remaining entries are compared with all others.
LEADER_ROUNDS = 2
#: Entries of a side of a block, and their shingles.
BLOCK_ROWS = 1000
BLOCK_SHINGLES = 500_000
#: Bits of the filter on texts.
FILTER_BITS = 1 << 25
_BITMAP = 1 << 15
#: Words whose hash a task remembers, and hashes worked at once.
WORDS_HELD = 500_000
HASHED = 1 << 15

_SKETCHED = "doc_id long, row_key binary, entry binary, n int, registers binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_HELD:
            self.clear()
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def shingle_hashes(text: bytes, words: int, known: WordHashes) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; of bytes: lowers A-Z, splits at space and 0x09-0x0D."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    of_words = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    n = len(tokens) - width + 1
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found = _mixed(found + of_words[k : k + n])
    return np.unique(found)


@lru_cache(maxsize=4)
def _functions(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What a hash is changed by in each bucket: fixed values from a fixed seed."""
    draw = np.random.Generator(np.random.PCG64(11))
    change, factor = draw.integers(0, 1 << 64, (2, buckets), np.uint64)
    return change, factor | np.uint64(1)


def sketches(hashes: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Registers (uint16, a row each) of sets that follow each other in ``hashes``, none of them empty."""
    change, factor = _functions(buckets)
    least = np.full((len(starts), buckets), ~np.uint64(0))
    if len(hashes):
        for begin in range(0, len(hashes), HASHED):
            end = min(begin + HASHED, len(hashes))
            first, last = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end, "left")
            at = np.maximum(starts[first:last], begin) - begin
            piece = hashes[begin:end]
            for k in range(buckets):
                found = np.minimum.reduceat((piece ^ change[k]) * factor[k], at)
                np.minimum(least[first:last, k], found, out=least[first:last, k])
    return compressed(least)


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros of 53 bits, then the bits behind the first one: read off the exact float of the upper bits."""
    bits = (least >> np.uint64(11)).astype(np.float64).view(np.uint64)
    power = (bits >> np.uint64(52)).astype(np.int64)  # 1023 + place of the first one; 0 for zero
    zeros = np.where(power > 0, 1023 + 52 - power, 53)
    behind = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | behind.astype(np.int64)).astype(np.uint16)


def chance_equal(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of unrelated sets of n and m shingles agree.

    A register names a cell of hashes: its zeros z and one of the 2^MANTISSA
    parts of [2^-(z+1), 2^-z).  The least of n hashes is in a narrow cell at x
    with density n (1-x)^(n-1); cells of one z are summed by their middles.
    """
    n, m = np.broadcast_arrays(np.asarray(n, np.float64)[..., None, None], np.asarray(m, np.float64)[..., None, None])
    zeros = np.arange(53)[:, None]
    middles = 16  # so many parts of a cell range stand for 2^MANTISSA
    x = 2.0 ** -(zeros + 1) * (1 + (np.arange(middles) + 0.5) / middles)
    width = 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    density = lambda k: k * np.exp((k - 1) * np.log1p(-x))
    return (density(n) * width * density(m) * width * (1 << MANTISSA) / middles).sum(axis=(-1, -2))


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for those equal by chance."""
    chance = _chances()[_level(n), _level(m)]
    return (equal / buckets - chance) / (1 - chance)


def _level(n: np.ndarray) -> np.ndarray:
    """The power of two next to a set's size."""
    return np.round(np.log2(np.maximum(n, 1))).astype(np.int64)


@lru_cache(maxsize=1)
def _chances() -> np.ndarray:
    """``chance_equal`` for sets of 2^i and 2^j shingles."""
    sizes = 2.0 ** np.arange(41)
    return np.stack([chance_equal(np.full(41, s), sizes) for s in sizes])


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row_key, and of the set: entry (16 bytes that name it), size n and registers; null where it is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = WordHashes()
        for batch in parts(batches, 200):
            sets = [shingle_hashes(t or b"", words, known) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            registers, entries = [None] * len(sets), [None] * len(sets)
            if len(some):
                starts = np.append(0, np.cumsum(sizes[some])[:-1])
                for i, row in zip(some, sketches(np.concatenate([sets[i] for i in some]), starts)):
                    registers[i], entries[i] = row.astype("<u2").tobytes(), xxhash.xxh3_128_digest(sets[i].tobytes())
            columns = [pa.array(entries, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], names=["doc_id", "row_key", "entry", "n", "registers"]
            )

    key = row_key(F.col("doc_id"), F.col("text")).alias("row_key")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), key, F.col("text").cast("binary"))
    return materialize(rows.mapInArrow(work, _SKETCHED), "sketches")


def shared_buckets(entries: DataFrame) -> DataFrame:
    """bucket, members, entry, n: the bands' buckets that several entries are in, written once."""
    width = 2 * ROWS
    keys = [F.xxhash64(F.lit(b), F.substring("registers", b * width + 1, width)) for b in range(BANDS)]
    rows = entries.select("entry", "n", F.explode(F.array(*keys)).alias("bucket"))
    several = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return materialize(rows.join(several, "bucket"), "shared-buckets")


def _ordered(a: Column, n: Column, b: Column, m: Column) -> list[Column]:
    """a, n, b, m with the smaller entry first."""
    one, two = F.struct(a.alias("e"), n.alias("n")), F.struct(b.alias("e"), m.alias("n"))
    low, high = F.least(one, two), F.greatest(one, two)
    return [low["e"].alias("a"), low["n"].alias("n"), high["e"].alias("b"), high["n"].alias("m")]


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    """No sets of sizes further apart reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def leader_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Distinct pairs (a, n, b, m) of entries with their buckets' leaders in other components; ``rows`` has
    bucket, entry, n and component.  Leaders are drawn by a hash of turn, bucket and entry."""
    drawn = F.struct(F.xxhash64(F.lit(turn), "bucket", "entry").alias("h"), "entry", "n", "component")
    leaders = rows.groupBy("bucket").agg(F.min(drawn).alias("leader"))
    joined = rows.join(leaders, "bucket").where("component <> leader.component")
    joined = joined.where(_sizes_allow(F.col("n"), F.col("leader.n"), percent))
    return joined.select(*_ordered(F.col("entry"), F.col("n"), F.col("leader.entry"), F.col("leader.n"))).distinct()


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BUCKETS)


def estimated(pairs: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate is at least ``least``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 10_000):
            equal = (_registers(batch.column(4)) == _registers(batch.column(5))).sum(axis=1)
            found = estimate(equal, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            yield batch.select([0, 1]).filter(pa.array(found >= least))

    one = entries.select(F.col("entry").alias("a"), F.col("registers").alias("of_a"))
    two = entries.select(F.col("entry").alias("b"), F.col("registers").alias("of_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "of_a", "of_b")
    return joined.mapInArrow(work, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b and ``linked``: whether the full sets reach the threshold; written once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = WordHashes(), {}

        def full(entry: bytes, text: bytes) -> np.ndarray:
            found = held.get(entry)
            if found is None:
                if len(held) >= 64:
                    held.clear()
                found = held[entry] = shingle_hashes(text or b"", words, known)
            return found

        for batch in parts(batches, 200):
            linked = []
            for a, b, of_a, of_b in zip(*(c.to_pylist() for c in batch.columns)):
                one, two = full(a, of_a), full(b, of_b)
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(linked)], names=["a", "b", "linked"])

    one = texts.select(F.col("entry").alias("a"), F.col("text").alias("of_a"))
    two = texts.select(F.col("entry").alias("b"), F.col("text").alias("of_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b")
    return materialize(joined.mapInArrow(work, "a binary, b binary, linked boolean"), "verified-pairs")


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bit for each value that the hash of a ``row_key`` takes; FILTER_BITS whatever the number of keys."""
    place = F.pmod(F.xxhash64("row_key"), F.lit(FILTER_BITS))
    maps = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / _BITMAP).cast("int").alias("at"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.agg(F.bitmap_construct_agg(F.col("p") % _BITMAP).alias("m")).collect():
        bits[r["at"] * (_BITMAP // 8) : (r["at"] + 1) * (_BITMAP // 8)] = np.frombuffer(bytes(r["m"]), np.uint8)
    return bits


def texts_of_entries(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """entry and a text of it, for the entries of ``wanted`` (entry, row_key); written once."""
    bits = _filter_bits(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            place = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool)))

    rows = pick(docs, "doc_id", "text").where("text is not null")
    rows = rows.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("row_key"), F.lit(FILTER_BITS)))
    maybe = rows.mapInArrow(work, "row_key binary, text binary")
    one_each = maybe.groupBy("row_key").agg(F.first("text").alias("text"))
    return materialize(one_each.join(wanted, "row_key").select("entry", "text"), "entry-texts")


def _in_components(shared: DataFrame, components: DataFrame) -> DataFrame:
    """The shared buckets with each entry's component, those only that hold several and more than two entries."""
    placed = shared.where("members > 2").join(components.withColumnRenamed("node", "entry"), "entry", "left")
    placed = placed.select("bucket", "members", "entry", "n", F.coalesce("component", "entry").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return materialize(placed.join(mixed.where("low <> high").select("bucket"), "bucket", "left_semi"), "mixed-buckets")


class Forest:
    """Components of a block's entries, each link joining two of them."""

    def __init__(self) -> None:
        self.up: dict[bytes, bytes] = {}

    def find(self, x: bytes) -> bytes:
        while x in self.up:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x: bytes, y: bytes) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[x] = y
        return x != y


def block_links(minors: list[tuple], others: list[tuple], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join components of a block, found by counting the common shingles of each minor with all others.

    Both lists hold (entry, component, shingle hashes).  Counts come from an
    inverted index over the others, so a pair without a common shingle costs
    nothing and no pair is listed before its count is known.
    """
    sizes = np.array([len(h) for *_, h in others])
    hashes = np.concatenate([h for *_, h in others])
    order = np.argsort(hashes, kind="stable")
    of = np.repeat(np.arange(len(others)), sizes)[order]
    keys, first = np.unique(hashes[order], return_index=True)
    last = np.append(first[1:], len(of))
    forest, found = Forest(), []
    for entry, component, mine in minors:
        at = np.searchsorted(keys, mine)
        at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == mine)]
        begin, length = first[at], last[at] - first[at]
        ends = np.cumsum(length)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + length, length)
        both = np.bincount(of[places], minlength=len(others))
        for k in np.flatnonzero(100 * both >= percent * (len(mine) + sizes - both)):
            if forest.join(component, others[k][1]):
                found.append((entry, others[k][0]))
    return found


def remaining_links(mixed: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between a bucket's entries in different components, as far as they join these.

    The entries outside the bucket's largest component meet all its entries in
    blocks of bounded size, which come with their texts and are compared on the
    full sets; inside the largest component there is nothing to compare.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, sides = WordHashes(), None, ([], [])

        def links() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1] and (found := block_links(*sides, percent)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["a", "b"])

        for batch in parts(batches, 200):
            for bucket, number, side, entry, component, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, number) != block:
                    yield from links()
                    block, sides = (bucket, number), ([], [])
                sides[side].append((entry, component, shingle_hashes(text, words, known)))
        yield from links()

    sizes = mixed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    tops = sizes.groupBy("bucket").agg(F.sum("size").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("size", "component", "n")).alias("top"))
    blocks = lambda rows, n: F.ceil(F.greatest(rows / BLOCK_ROWS, n / BLOCK_SHINGLES)).cast("int")
    tops = tops.select(
        "bucket", F.col("top.component").alias("top"), blocks(F.col("rows"), F.col("n")).alias("blocks"),
        blocks(F.col("rows") - F.col("top.size"), F.col("n") - F.col("top.n")).alias("minor_blocks"),
    )
    rows = mixed.join(tops, "bucket")
    mine = lambda n: F.pmod(F.xxhash64("entry"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minors = rows.where("component <> top").withColumn("i", mine("minor_blocks")).withColumn("j", each("blocks"))
    others = rows.withColumn("j", mine("blocks")).withColumn("i", each("minor_blocks"))
    number = (F.col("i").cast("long") * F.col("blocks") + F.col("j")).alias("block")
    both = [d.select("bucket", number, F.lit(k).alias("side"), "entry", "component") for k, d in enumerate((minors, others))]
    dealt = both[0].unionByName(both[1]).join(texts, "entry")
    dealt = dealt.select("bucket", "block", "side", "entry", "component", "text")
    dealt = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(work, "a binary, b binary")


def near_components(docs: DataFrame, entries: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of the entries that are linked with another one."""
    shared = shared_buckets(entries)
    least = percent / 100 - MARGIN
    wanted = entries.join(shared.select("entry").distinct(), "entry", "left_semi").select("entry", "row_key")
    texts = texts_of_entries(docs, materialize(wanted, "wanted-texts"))
    rows, checked, components = shared.withColumn("component", F.col("entry")), None, None
    for turn in range(LEADER_ROUNDS):
        pairs = estimated(leader_pairs(rows, turn, percent), entries, least)
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        found = verified(pairs, texts, words, percent)
        checked = found if checked is None else checked.unionByName(found)
        components = connected_components(checked.where("linked").select("a", "b"))
        rows = _in_components(shared, components)
    links = checked.where("linked").select("a", "b").unionByName(remaining_links(rows, texts, words, percent))
    return connected_components(links)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept; links are ``100 * intersection >= percent * union``."""
    rows = sketched(docs, words)
    some = rows.where("entry is not null")
    entries = some.groupBy("entry").agg(
        F.min("row_key").alias("row_key"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"),
        F.first("registers").alias("registers"),
    )
    entries = materialize(entries, "entries")
    components = near_components(docs, entries, words, percent)
    placed = entries.join(components.withColumnRenamed("node", "entry"), "entry", "left").select(
        "entry", "first_id", F.coalesce("component", "entry").alias("component")
    )
    placed = materialize(placed, "entry-components")
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(named, "component").select("entry", "component_id")
    linked = some.select("doc_id", "n", "entry").join(named, "entry").select("doc_id", "n", "component_id")
    alone = rows.where("entry is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
