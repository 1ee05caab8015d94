"""Removal of repeated passages by suffix sorting in shards.

A byte is removed if some string of ``depth`` bytes that covers it also starts
earlier (in a document with a smaller id, or earlier in the same one).

Strings that are equal must meet in one shard without shipping every suffix.
Each string of ``depth`` bytes is given to the least of the hashed
``ANCHOR``-byte strings inside it, its anchor; neighbouring strings mostly share
theirs, so a document falls into pieces of at most 2 x ``depth`` bytes, and
equal strings have equal anchors.  Only anchors that occur in pieces of
different content need comparing; equal pieces are told by a 128-bit hash of
their content, and only the first of them goes on.

An anchor in very many different pieces (the edge of a passage that a third of
all documents share) would fill a shard alone.  Beyond ``HOT_PIECES`` its
strings are grouped one by one by a 128-bit hash instead, which any number of
tasks can share.

The pieces of a shard are put together to one text.  Its suffixes are sorted by
external induced sorting, which carries common prefixes along (``induced``);
runs of suffixes that share ``depth`` bytes are the repeats, and the earliest of
a run stays.

Scale: one shuffle of pieces (four numbers each, equal ones of a batch combined
first), one of texts to cut out the pieces to compare, one of these pieces by
anchor, one of texts to take the repeats out.  A copy of a hot passage costs a
number, not its bytes, and most are told before the shuffle.  A shard's text
has about ``SHARD_BYTES`` and, with the bound for hot anchors, not much more;
what does not fit the memory budget is sorted on disk.

Defined results: a null text counts as empty; texts of fewer bytes than
``depth`` keep all; a string may overlap its earlier occurrence; rows that
repeat id and text are one document with one verdict; rows that share an id
with different texts are ordered by start only; a null id comes before all
others; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.joins import nullsafe_join
from ledgerlens.llm.common import parts, pick
from ledgerlens.llm.induced import BUDGET, Scratch, suffixes
from ledgerlens.llm.tables import IntTable
from ledgerlens.session import materialize

DEPTH = 100
ANCHOR = 32
#: Bytes of text that are cut into pieces at once, and of a shard.
RUN_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
#: Contents that a task remembers while it cuts, to tell repeats before the shuffle.
REMEMBERED = 200_000
#: Different pieces an anchor may have in one shard (twice the bytes a shard has otherwise); those of hotter
#: anchors are told apart string by string.
HOT_PIECES = 60_000

_PLACE_BITS = 24  # a place in a run, below the hash that orders anchors
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ODD = 0x9E3779B97F4A7C15


def _byte_values() -> np.ndarray:
    values = np.arange(1, 257, dtype=np.uint64)
    for shift in (33, 29, 32):
        values = (values ^ (values >> np.uint64(shift))) * _MIX
    return values


class Cutter:
    """Cuts texts into pieces: runs of strings of ``depth`` bytes with one anchor."""

    def __init__(self, depth: int) -> None:
        self.depth, self.values = depth, _byte_values()

    def _rolling(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the strings of ANCHOR and of 2 x ANCHOR bytes at each place (wrong where they don't fit)."""
        now, size = self.values[text], 1
        while size < 2 * ANCHOR:
            if size == ANCHOR:
                anchors = now
            later = np.append(now[size:], np.zeros(min(size, len(now)), np.uint64))
            now = now * np.uint64(pow(_ODD, size, 1 << 64)) + later
            size *= 2
        anchors = (anchors ^ (anchors >> np.uint64(32))) * _MIX
        return anchors ^ (anchors >> np.uint64(29)), now

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each piece: number of the text, start, strings, anchor hash and content hash."""
        joined = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        n, depth = len(joined), self.depth
        if n < depth:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        anchors, doubles = self._rolling(joined)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        least = (anchors & ~low) | (np.arange(n, dtype=np.uint64) & low)
        wide, size = depth - ANCHOR + 1, 1
        while 2 * size <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: n - depth + 1], least[wide - size : wide - size + n - depth + 1])
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(least)]
        whole = np.arange(len(least)) + depth <= ends[text]
        begin = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])) & whole
        # A piece also ends where strings no longer fit; the next begins with a text and is marked already.
        first = np.flatnonzero(begin)
        fits = np.append(0, np.cumsum(whole))
        following = np.append(first[1:], len(least))
        strings = fits[following] - fits[first]
        at = (first & ~int(low)) | (least[first] & low).astype(np.int64)
        at = np.where(at < first, at + (1 << _PLACE_BITS), at)
        size = strings + depth - 1
        hashed = doubles[first] * np.uint64(3) + doubles[first + (size - 2 * ANCHOR) // 2] * np.uint64(0x5851F42D4C957F2D)
        hashed = (hashed + doubles[first + size - 2 * ANCHOR] + size.astype(np.uint64)) * _MIX
        hashed ^= hashed >> np.uint64(31)
        owner = text[first]
        starts = np.append(0, ends[:-1])
        return owner, first - starts[owner], strings, anchors[at], hashed


# A piece's place: start (32 bits), number of strings (8), row mark (24: tells texts that share an id apart).
def _place(start: np.ndarray, strings: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return (start << 32) | (strings << 24) | mark


def _byte_runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > RUN_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class Remembered:
    """The earliest places of the contents a task has seen, as far as they fit."""

    def __init__(self) -> None:
        self.table, self.rows = IntTable(), np.zeros((4, 0), np.int64)

    def repeats(self, anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of these pieces, of different content, have a remembered one that starts earlier."""
        now = np.array([anchor.view(np.int64), content.view(np.int64), doc, place])
        keys = ((content ^ (anchor * np.uint64(_ODD))) >> np.uint64(1)).astype(np.int64)
        _, alone = np.unique(keys, return_index=True)
        at = self.table.get(keys)
        known = np.flatnonzero(at >= 0)
        known = known[(self.rows[:2, at[known]] == now[:2, known]).all(axis=0)]
        before = self.rows[2:, at[known]]
        later = (now[2, known] > before[0]) | ((now[2, known] == before[0]) & (now[3, known] > before[1]))
        out = np.zeros(len(keys), bool)
        out[known[later]] = True
        sooner = known[~later]
        self.rows[2:, at[sooner]] = now[2:, sooner]
        new = alone[at[alone] < 0][: REMEMBERED - self.rows.shape[1]]
        self.table.add(keys[new], self.rows.shape[1] + np.arange(len(new)))
        self.rows = np.concatenate([self.rows, now[:, new]], axis=1)
        return out


_PIECE = "anchor long, content long, doc_id long, place long, first boolean"


def _cut(depth: int):
    """Pieces of documents (doc_id, mark, text); those with an equal one that a task saw to start earlier are
    not marked as first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, remembered = Cutter(depth), Remembered()
        for batch in parts(batches):
            ids, marks = (batch.column(c).to_numpy() for c in (0, 1))
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for begin, end in _byte_runs(texts):
                owner, start, strings, anchor, content = cutter.pieces(texts[begin:end])
                if not len(owner):
                    continue
                doc, place = ids[begin:end][owner], _place(start, strings, marks[begin:end][owner])
                order = np.lexsort((place, doc, content))
                doc, place, anchor, content = doc[order], place[order], anchor[order], content[order]
                same = np.append(False, (content[1:] == content[:-1]) & (anchor[1:] == anchor[:-1]))
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
                repeat = same & ((doc != doc[head]) | (place != place[head]))
                heads = np.flatnonzero(~same)
                repeat[heads] = remembered.repeats(anchor[heads], content[heads], doc[heads], place[heads])
                columns = [anchor.view(np.int64), content.view(np.int64), doc, place, ~repeat]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(_PIECE))

    return work


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_SORTED = "anchor long, doc_id long, place long, compare boolean"


def _compare_or_remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by anchor, content, doc_id and place: the repeated ones (all their strings
    go), and the first ones of their content whose anchor has other content too (to be compared)."""
    held = None  # the last first piece, and whether another content of its anchor came before it
    for batch in batches:
        anchor, content, doc, place = (batch.column(c).to_numpy() for c in range(4))
        first = batch.column(4).to_numpy(zero_copy_only=False)
        out = [(anchor[~first], doc[~first], place[~first], np.zeros(int((~first).sum()), bool))]
        anchor, content, doc, place = (c[first] for c in (anchor, content, doc, place))
        if held is not None:
            anchor, content, doc, place = (np.append(h, c) for h, c in zip(held[:4], (anchor, content, doc, place)))
        n = len(anchor)
        if n:
            new_anchor = np.append(True, anchor[1:] != anchor[:-1])
            head = new_anchor | np.append(True, content[1:] != content[:-1])
            own = np.maximum.accumulate(np.where(head, np.arange(n), 0))
            again = ~head & ((doc != doc[own]) | (place != place[own]))
            out.append((anchor[again], doc[again], place[again], np.zeros(int(again.sum()), bool)))
            heads = np.flatnonzero(head)
            other_before = ~new_anchor[heads]
            if held is not None:
                other_before[0] = held[4]
            other_after = np.append(~new_anchor[heads[1:]], False)
            last, compare = heads[-1], heads[:-1][(other_before | other_after)[:-1]]
            out.append((anchor[compare], doc[compare], place[compare], np.ones(len(compare), bool)))
            held = (anchor[last], content[last], doc[last], place[last], bool(other_before[-1]))
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(_SORTED))
    if held is not None and held[4]:
        row = [pa.array([held[k]], pa.int64()) for k in (0, 2, 3)]
        yield pa.RecordBatch.from_arrays([*row, pa.array([True])], names=_names(_SORTED))


def _cut_out(depth: int):
    """The bytes of the pieces to compare; columns text, and lists of anchors and places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text, doc = batch.column(1)[row].as_py() or b"", batch.column(0)[row].as_py()
                anchors, places = batch.column(2)[row].values, batch.column(3)[row].values.to_numpy()
                begin = places >> 32
                end = begin + ((places >> 24) & 255) + depth - 1
                pieces = [text[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [anchors, pa.array([doc] * len(pieces), pa.int64()), pa.array(places), pa.array(pieces, pa.binary())],
                    names=["anchor", "doc_id", "place", "piece"],
                )

    return work


_SPAN = "doc_id long, mark int, begin long, end long"


class ShardText:
    """The pieces of a shard as one text, in memory up to the budget and in a file beyond it."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.parts, self.file, self.held, self.sizes = scratch, [], None, 0, []

    def add(self, pieces: pa.Array) -> None:
        pieces = pieces.to_pylist()
        self.sizes.append(np.array([len(p) for p in pieces], np.int64))
        self.parts.append(b"".join(pieces))
        self.held += len(self.parts[-1])
        if self.held > self.scratch.budget // 4:
            if self.file is None:
                self.file = open(self.scratch.path(), "w+b")
            self.file.write(b"".join(self.parts))
            self.parts, self.held = [], 0

    def text(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(b"".join(self.parts), np.uint8)
        self.file.write(b"".join(self.parts))
        self.file.flush()
        return np.memmap(self.file.name, np.uint8, "r")


def repeats(text: np.ndarray, ends: np.ndarray, order: np.ndarray, depth: int, scratch: Scratch) -> np.ndarray:
    """True at the places of ``text`` where a string of ``depth`` bytes starts that also starts earlier.

    ``text`` is a row of pieces, which end before ``ends``; strings do not go
    across them.  ``order``: for each piece a number that tells which starts
    earlier; the string at place k of a piece has the number plus k.
    """
    starts = np.append(0, ends[:-1])
    # Runs of suffixes with ``depth`` common bytes arrive in blocks; the earliest of a run is known at its end.
    least, run = scratch.array(len(text) + 1, np.int64), -1
    least[:] = np.iinfo(np.int64).max
    run_of, out = scratch.array(len(text), np.int64), scratch.array(len(text), bool)

    def number(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece = np.searchsorted(ends, place, "right")
        return order[piece] + place - starts[piece], place + depth <= ends[piece]

    for place, lcp in suffixes(text, depth, scratch):
        runs = run + np.cumsum(lcp < depth)
        run = int(runs[-1])
        run_of[place] = runs
        numbers, whole = number(place)
        np.minimum.at(least, runs[whole], numbers[whole])
    for begin in range(0, len(text), 1 << 20):
        place = np.arange(begin, min(len(text), begin + (1 << 20)))
        numbers, whole = number(place)
        out[place] = whole & (numbers > least[run_of[place]])
    return out


def _sort_shard(depth: int, budget: int):
    """Spans of bytes to remove from the documents of a shard's pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = Scratch(budget)
        try:
            held, docs, places = ShardText(scratch), [], []
            for batch in batches:
                docs.append(batch.column(1).to_numpy())
                places.append(batch.column(2).to_numpy())
                held.add(batch.column(3))
            if not docs or not sum(map(len, docs)):
                return
            docs, places, ends = np.concatenate(docs), np.concatenate(places), np.cumsum(np.concatenate(held.sizes))
            _, rank = np.unique(docs, return_inverse=True)
            gone = repeats(held.text(), ends, (rank << 32) + (places >> 32), depth, scratch)
            starts = np.append(0, ends[:-1])
            for begin in range(0, len(ends), 1 << 14):  # pieces
                some = slice(begin, min(len(ends), begin + (1 << 14)))
                base = int(starts[begin])
                # A piece's last places never start a string, so no run goes across pieces.
                change = np.diff(np.concatenate([[0], gone[base : int(ends[some][-1])].astype(np.int8), [0]]))
                first, last = np.flatnonzero(change == 1) + base, np.flatnonzero(change == -1) + base
                piece = np.searchsorted(ends, first, "right")
                shift = (places[piece] >> 32) - starts[piece]
                mark = (places[piece] & 0xFFFFFF).astype(np.int32)
                columns = [docs[piece], mark, first + shift, last - 1 + depth + shift]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(_SPAN))
        finally:
            scratch.close()

    return work


def removed_spans(
    docs: DataFrame, depth: int = DEPTH, budget: int = BUDGET, hot_pieces: int = HOT_PIECES
) -> DataFrame:
    """doc_id, mark, begin and end (bytes) of spans to remove; spans may overlap.

    ``budget``: bytes that a shard's arrays and queues may take in memory before they go to disk.
    """
    if not 2 * ANCHOR <= depth <= 255:
        raise ValueError(f"depth must be from {2 * ANCHOR} to 255 bytes")
    columns = "anchor", "content", "doc_id", "place"
    # Pieces that are known to repeat only pass through, so they are dealt out evenly.
    deal = F.when(F.col("first"), F.col("anchor")).otherwise(F.xxhash64("doc_id", "place"))
    cut = docs.mapInArrow(_cut(depth), _PIECE).repartition(deal).sortWithinPartitions(*columns)
    found = materialize(cut.mapInArrow(_compare_or_remove, _SORTED), "pieces")
    mark, begin = F.col("place").bitwiseAND(0xFFFFFF).cast("int"), F.shiftright("place", 32)
    strings = F.shiftright("place", 24).bitwiseAND(255)
    whole = found.where("not compare").select(
        "doc_id", mark.alias("mark"), begin.alias("begin"), (begin + strings + depth - 1).alias("end")
    )
    compare = found.where("compare")
    # At most one anchor per HOT_PIECES pieces.
    hot = compare.groupBy("anchor").count().where(F.col("count") > hot_pieces).select("anchor")
    hot = materialize(hot, "hot-anchors")
    cool = compare.join(hot, "anchor", "left_anti")
    size = cool.agg(F.sum(strings + depth - 1)).first()[0] or 0
    shards = _shipped(docs, cool, depth).repartition(max(1, -(-size // SHARD_BYTES)), "anchor")
    spans = whole.unionByName(shards.mapInArrow(_sort_shard(depth, budget), _SPAN))
    if not hot.isEmpty():
        spans = spans.unionByName(_hot_spans(_shipped(docs, compare.join(hot, "anchor", "left_semi"), depth), depth))
    return materialize(spans, "spans")


def _shipped(docs: DataFrame, pieces: DataFrame, depth: int) -> DataFrame:
    """The pieces with their bytes."""
    mark = F.col("place").bitwiseAND(0xFFFFFF).cast("int")
    wanted = pieces.groupBy("doc_id", mark.alias("mark")).agg(F.collect_list(F.struct("anchor", "place")).alias("pieces"))
    texts = nullsafe_join(docs, wanted, ["doc_id", "mark"]).select(
        "doc_id", "text", F.col("pieces.anchor").alias("anchors"), F.col("pieces.place").alias("places")
    )
    return texts.mapInArrow(_cut_out(depth), "anchor long, doc_id long, place long, piece binary")


def _strings(depth: int):
    """Each string of ``depth`` bytes of the pieces: a 128-bit hash, document, mark and start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _byte_values()
        powers = [np.array([pow(b, k, 1 << 64) for k in range(depth)], np.uint64) for b in (_ODD, 0xC2B2AE3D27D4EB4F)]
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                some = batch.slice(begin, 256)
                pieces = some.column(3).to_pylist()
                docs, places = some.column(1).to_numpy(), some.column(2).to_numpy()
                counts = np.array([len(p) - depth + 1 for p in pieces])
                text = values[np.frombuffer(b"".join(pieces), np.uint8)]
                starts = np.cumsum(counts + depth - 1) - (counts + depth - 1)
                owner = np.repeat(np.arange(len(pieces)), counts)
                inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                windows = np.lib.stride_tricks.sliding_window_view(text, depth)[starts[owner] + inside]
                hashes = [(windows * p).sum(axis=1).view(np.int64) for p in powers]
                start = (places[owner] >> 32) + inside
                columns = [*hashes, docs[owner], (places[owner] & 0xFFFFFF).astype(np.int32), start]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_names(_STRING))

    return work


_STRING = "one long, two long, doc_id long, mark int, begin long"


def _hot_spans(pieces: DataFrame, depth: int) -> DataFrame:
    """Spans to remove in pieces of hot anchors: strings are grouped by their hash, with partial
    aggregation, and joined to the first of their group, so no task holds an anchor's pieces."""
    # The pieces are written, and their strings made twice: they are many times as large.
    strings = materialize(pieces, "hot-pieces").mapInArrow(_strings(depth), _STRING)
    place = F.struct("doc_id", "begin")
    first = strings.groupBy("one", "two").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = strings.join(first, ["one", "two"]).where(place != F.col("first"))
    return later.select("doc_id", "mark", "begin", (F.col("begin") + depth).alias("end"))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _take_out(with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(_RESULT) + ["kept"] * with_text
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                text, begin = batch.column(1)[row].as_py() or b"", batch.column(2)[row].values
                spans = 0
                kept = text
                if begin is not None and len(begin):
                    begin, end = begin.to_numpy(), batch.column(3)[row].values.to_numpy()
                    order = np.argsort(begin, kind="stable")
                    begin, reach = begin[order], np.maximum.accumulate(end[order])
                    heads = np.append(True, begin[1:] > reach[:-1])  # spans that touch are one
                    begin, reach = begin[heads], reach[np.append(heads[1:], True)]
                    spans = len(begin)
                    cuts = zip([0, *reach.tolist()], [*begin.tolist(), len(text)])
                    kept = b"".join([text[a:b] for a, b in cuts])
                found = (len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest())
                rows.append((*found, kept) if with_text else found)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return work


#: Bits of a text's hash put behind a doc_id, where ids are small enough to leave room for them.
NAME_BITS = 24


def row_names(docs: DataFrame):
    """Functions (id, text) -> name and name -> id.  A name is a long in the order of the ids that also tells rows
    of one id with different texts apart: with the mark, 48 bits of hashes do for ids below 2^38, and 86 for null ids,
    which come before all others.  Ids above 2^38 leave fewer bits, from 2^62 on none (the mark's 24 remain)."""
    ids = F.col("doc_id").cast("long")
    ends = pick(docs, "doc_id").agg(F.min(ids), F.max(ids)).first()
    free = max(0, min(NAME_BITS, 62 - max(abs(x or 0) for x in ends).bit_length()))
    null_bits = 62 if free else 0
    lowest = F.lit(-(1 << 63)).cast("long")

    def name(doc_id: Column, text: Column) -> Column:
        # Seeded differently from the mark, which is the lowest bits of the hash of the text alone.
        other = F.xxhash64(text, F.lit("name"))
        low = lambda bits: other.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        return F.when(doc_id.isNull(), lowest + low(null_bits)).otherwise(F.shiftleft(doc_id, free).bitwiseOR(low(free)))

    def doc_id(name: Column) -> Column:
        return F.when(name >= F.lit(-(1 << 62)).cast("long") if free else name != lowest, F.shiftright(name, free))

    return name, doc_id


def remove_repeats(docs: DataFrame, depth: int = DEPTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (the remaining bytes) if asked for."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    name, doc_id = row_names(docs)
    rows = pick(docs, "doc_id", "text").select(
        name(F.col("doc_id").cast("long"), text).alias("doc_id"),
        F.xxhash64(text).bitwiseAND(0xFFFFFF).cast("int").alias("mark"),
        text.alias("text"),
    )
    spans = removed_spans(rows, depth).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = nullsafe_join(rows, spans, ["doc_id", "mark"], "left").select(
        "doc_id", "text", F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end")
    )
    out = joined.mapInArrow(_take_out(with_text), _RESULT + (", kept binary" if with_text else ""))
    return out.withColumn("doc_id", doc_id(F.col("doc_id")))
