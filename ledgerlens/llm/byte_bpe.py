"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The texts of a batch become one array of code points, then of classes: letter,
number, white space, other, and a few that hold the look-ahead the pattern
needs (a space before a non-space, an apostrophe before a contraction).  A
small automaton over these classes knows where tokens of the pattern start.
Its step for a class is a function from state to state; such functions compose
associatively and only a few dozen different ones arise, so a table of
compositions turns the run over the whole array into a blocked prefix scan of
table lookups.  No regular expression is used.

The slices between the starts go through a cache of merged pieces.  Slices that
are not in it are merged pair by pair, lowest rank first and leftmost of equal
ones, all new slices of one length side by side.  The byte offset of every token is kept, and decoding copies the bytes of
all tokens to their offsets at once.

Scale: one narrow pass, no shuffle.  The ranks are broadcast as the bytes of
their file (under 1 MB).  A batch is worked through in runs of documents of
bounded length; a longer document is a run of its own.  The cache is cleared
when it reaches its bound.

Defined results: a null text counts as empty and has no tokens; bytes that are
no UTF-8 are read as U+FFFD; repeated rows are encoded each; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_batches, parts, pick, worker_table
from ledgerlens.llm.tables import IntTable

#: Code points that are worked through at once, and slices that are cached.
RUN_CHARS = 1_000_000
CACHED = 100_000
_NEVER = 1 << 62

# The code points that are white space in Unicode.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of a code point in its place.  SPACE_RUN: more white space or the end follows.
END, LETTER, NUMBER, SPACE_RUN, SPACE_BEFORE, SPACE_LAST, OTHER, SHORT, LONG = range(9)
# What the code point before belongs to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, PREFIX, ONE_LEFT, TWO_LEFT = range(8)


def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE_RUN or OTHER for every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE_RUN
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts here, by state and class."""
    step, starts = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    opens = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE_RUN: IN_SPACES, SPACE_BEFORE: PREFIX, SPACE_LAST: FRESH, SHORT: ONE_LEFT, LONG: TWO_LEFT, END: FRESH}
    for kind, state in opens.items():
        step[:, kind] = state
    goes_on = [(IN_LETTERS, LETTER, IN_LETTERS), (IN_NUMBERS, NUMBER, IN_NUMBERS), (IN_SPACES, SPACE_RUN, IN_SPACES)]
    goes_on += [(PREFIX, LETTER, IN_LETTERS), (PREFIX, NUMBER, IN_NUMBERS), (TWO_LEFT, LETTER, ONE_LEFT), (ONE_LEFT, LETTER, FRESH)]
    goes_on += [(state, kind, IN_OTHERS) for state in (PREFIX, IN_OTHERS) for kind in (OTHER, SHORT, LONG)]
    for state, kind, to in goes_on:
        step[state, kind], starts[state, kind] = to, False
    starts[:, END] = False
    return step, starts


def _monoid(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that runs of classes make of the states: the function of each class, the
    table of "first a, then b", and the functions themselves."""
    functions = [tuple(range(step.shape[0]))]
    number = {functions[0]: 0}
    of_class = []
    for kind in range(step.shape[1]):
        f = tuple(int(x) for x in step[:, kind])
        of_class.append(number.setdefault(f, len(functions)))
        if of_class[-1] == len(functions):
            functions.append(f)
    at = 0
    while at < len(functions):
        for g in sorted(set(of_class)):
            f = tuple(functions[g][s] for s in functions[at])
            if number.setdefault(f, len(functions)) == len(functions):
                functions.append(f)
        at += 1
    then = np.array([[number[tuple(b[s] for s in a)] for b in functions] for a in functions])
    return np.array(of_class), then, np.array(functions, np.uint8)


def _scan(items: np.ndarray, then: np.ndarray) -> np.ndarray:
    """For each place, the composition of all items before it (blocked and recursive)."""
    n, width, block = len(items), then.shape[0], 64
    flat = then.ravel()
    if n <= block:
        out, now = np.zeros(n, np.int32), 0
        for i in range(n):
            out[i] = now
            now = flat[now * width + items[i]]
        return out
    lanes = -(-n // block)
    padded = np.zeros(lanes * block, np.int32)
    padded[:n] = items
    by_place = np.ascontiguousarray(padded.reshape(lanes, block).T)
    inside, now = np.empty((block, lanes), np.int32), np.zeros(lanes, np.int32)
    for k in range(block):
        inside[k] = now
        now = flat.take(now * width + by_place[k])
    before = _scan(now, then)
    return flat.take(before[None, :] * width + inside).T.ravel()[:n]


class PreTokenizer:
    """Token starts of texts, for the pattern of contractions, words, numbers, others and white space."""

    def __init__(self) -> None:
        self.classes = code_point_classes()
        step, self.starts = _automaton()
        of_class, then, self.functions = _monoid(step)
        self.of_class, self.then = of_class.astype(np.int32), then.astype(np.int32)

    def token_starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a token starts at each code point; texts end before the places ``ends``, which hold a separator."""
        kinds = self.classes[points]
        kinds[ends] = END
        after = np.append(kinds[1:], END).astype(np.uint8)
        spaces = kinds == SPACE_RUN
        last = spaces & (after != SPACE_RUN) & (after != END)
        kinds[last] = SPACE_LAST
        kinds[last & (points == 0x20)] = SPACE_BEFORE
        quote = np.flatnonzero(points == 0x27)
        quote = quote[kinds[quote] != END]
        if len(quote):
            ahead = np.append(points, np.zeros(3, points.dtype))
            one, two = ahead[quote + 1], ahead[quote + 2]
            inside = self.classes_after(kinds, quote)
            short = np.isin(one, [ord(c) for c in "stmd"]) & inside[0]
            pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
            long = np.any([(one == a) & (two == b) for a, b in pairs], axis=0) & inside[1]
            kinds[quote[short]], kinds[quote[long]] = SHORT, LONG
        state = self.functions[_scan(self.of_class[kinds], self.then), FRESH]
        return self.starts[state, kinds]

    @staticmethod
    def classes_after(kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the text goes on for one and for two places after ``at``."""
        more = np.append(kinds, [END] * 3)
        one = more[at + 1] != END
        return one, one & (more[at + 2] != END)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: merge the pair of lowest rank, leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    end = list(range(1, n + 1))  # where the part that starts here ends

    def pair(i: int) -> tuple | None:
        j = right[i]
        if j < n:
            rank = ranks.get(piece[i : end[j]])
            if rank is not None:
                return rank, i, end[j]
        return None

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or end[right[i]] != to or end[i] >= to:
            continue  # one of the two parts has changed since
        j = right[i]
        alive[j], end[i], right[i] = False, to, right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (left[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Merger:
    """Ids of slices as little-endian bytes; slices of one length are merged together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.held = ranks, {}
        self.width = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        pairs = {
            ranks[t[:k]] * self.width + ranks[t[k:]]: i
            for t, i in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        self.pairs = IntTable(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.pairs.get((a * self.width + b).ravel()).reshape(a.shape)
        return np.where(found < 0, _NEVER, found)

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of one length."""
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)]
        out = [b""] * len(pieces)
        rows, rank = np.arange(len(pieces)), self._rank(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(rank)), at]
            goes_on = low < _NEVER
            for r, final in zip(rows[~goes_on].tolist(), ids[~goes_on].astype("<u4")):
                out[r] = final.tobytes()
            if not goes_on.any():
                return out
            rows, ids, rank, at, low = rows[goes_on], ids[goes_on], rank[goes_on], at[goes_on], low[goes_on]
            every = np.arange(len(rows))
            keep = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), 1)
            ids[every, at] = low
            keep = keep[:, :-1]
            rank = np.take_along_axis(rank, keep + (keep >= at[:, None]), 1)
            for side in (at - 1, at):
                some = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                k = side[some]
                rank[some, k] = self._rank(ids[some, k], ids[some, k + 1])

    def learn(self, slices: set[str]) -> None:
        """Hold the ids of these slices, and forget others if they would be too many."""
        new = slices - self.held.keys()
        if len(self.held) + len(new) > CACHED:
            self.held.clear()
            new = slices
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for s in new:
            piece = s.encode()
            if piece in self.ranks or not 1 < len(piece) <= 40:
                self.held[s] = np.array(merge(piece, self.ranks), "<u4").tobytes()
            else:
                by_length.setdefault(len(piece), []).append((s, piece))
        for same in by_length.values():
            self.held.update(zip([s for s, _ in same], self._together([p for _, p in same])))


class ByteBpe:
    """Encoder and decoder for a file of ranks (base64 of the token's bytes, a space, its id)."""

    def __init__(self, rank_file: bytes) -> None:
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.words = PreTokenizer()
        self.merger = Merger(self.ranks)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four little-endian bytes each."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.flatnonzero(self.words.token_starts(points, ends))
        first = np.searchsorted(starts, np.append(0, ends[:-1] + 1))
        slices: list[list[str]] = []
        for k, text in enumerate(texts):
            begin = int(ends[k]) - len(text)
            cuts = (starts[first[k] : first[k + 1] if k + 1 < len(texts) else len(starts)] - begin).tolist()
            slices.append(list(map(text.__getitem__, map(slice, cuts, [*cuts[1:], len(text)]))))
        held = self.merger.held
        self.merger.learn(set().union(*slices))
        return [b"".join(map(held.__getitem__, s)) for s in slices]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin, and at the end their number."""
        return np.append(0, np.cumsum(self.lengths[ids]))

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of the tokens; any run of tokens can be decoded with its part of the offsets."""
        if not len(ids):
            return b""
        offsets = self.offsets(ids) if offsets is None else offsets - offsets[0]
        source = np.repeat(self.places[ids] - offsets[:-1], self.lengths[ids]) + np.arange(offsets[-1])
        return self.bytes[source].tobytes()


def runs(texts: list[str], most: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most ``most`` code points together; longer ones alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _read(column: pa.Array) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in column.to_pylist()]


def _worker_bpe(rank_file) -> ByteBpe:
    return worker_table(("byte_bpe", hashlib.sha256(rank_file.value).digest()), lambda: ByteBpe(rank_file.value))


def encode_decode(docs: DataFrame, rank_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for.

    ``rank_path`` is read on the driver and broadcast.  ``ids`` are
    little-endian unsigned 32-bit integers in a binary column; ``offsets``
    likewise hold the byte at which each token begins.
    """
    sc = docs.sparkSession.sparkContext
    with open(rank_path, "rb") as f:
        rank_file = sc.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids binary, offsets binary" if keep_ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(rank_file)
        for batch in parts(batches):
            texts, keys = _read(batch.column(1)), batch.column(0)
            for begin, end in runs(texts):
                rows = []
                for encoded in bpe.encode(texts[begin:end]):
                    ids = np.frombuffer(encoded, "<u4")
                    offsets = bpe.offsets(ids)
                    decoded = bpe.decode(ids, offsets)
                    row = [len(ids), hashlib.sha256(encoded).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    rows.append([*row, encoded, offsets[:-1].astype("<u4").tobytes()] if keep_ids else row)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(begin, end - begin), *columns], names=[c.split()[0] for c in schema.split(", ")]
                )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_batches(rows, work, schema)
