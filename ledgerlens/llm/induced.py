"""Suffix order and common-prefix lengths by external induced sorting.

Suffixes are induced in character order: a sorted suffix tells where the suffix
that starts one character earlier goes.  Left of the smallest starts are the
type-L suffixes, induced upwards from the type-S suffixes behind an L (the
"LMS" suffixes); all type-S suffixes are then induced downwards from them.  The
queues between the two hold, per first character, tuples of a position and the
common prefix with the tuple before; together they are a priority queue whose
entries leave in order.  They live in memory up to a budget and on disk beyond.

The LMS suffixes are sorted by recursion on the names of the substrings between
them.  That reduced text is the base case: its suffixes are ranked by doubling,
with a distribution sort that also works on disk.

Common prefixes are only told up to ``depth`` bytes, and suffixes that agree so
far may come in any order; that is all the removal of repeats of ``depth`` bytes
needs, and it bounds the recursion.

All arrays are worked through in blocks.  Scratch files go to Spark's own spill
folder of the executor, belong to one running task and are removed with it.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16
#: Bytes that arrays and queues may hold in memory before they go to disk.
BUDGET = 256 << 20


class Scratch:
    """Arrays that lie in memory up to a budget and in files beyond it."""

    def __init__(self, budget: int = BUDGET) -> None:
        self.budget, self.used, self.folder, self.files = budget, 0, None, 0

    def path(self) -> str:
        if self.folder is None:
            base = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=base)
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if n == 0 or self.used + size <= self.budget:
            self.used += size
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


class Queue:
    """First in, first out, of tuples (position, common prefix); kept after reading, so it can be read backwards."""

    def __init__(self, pool: "Pool") -> None:
        self.pool, self.kept, self.file, self.on_disk, self.read, self.size = pool, [], None, 0, 0, 0

    def add(self, tuples: np.ndarray) -> None:
        if len(tuples):
            self.kept.append(tuples)
            self.size += len(tuples)
            self.pool.grew(self, tuples.nbytes)

    def spill(self) -> None:
        if self.file is None:
            self.file = open(self.pool.scratch.path(), "w+b")
        self.file.seek(0, os.SEEK_END)
        for tuples in self.kept:
            self.file.write(tuples.tobytes())
        self.on_disk, self.kept = self.size, []

    def _slice(self, begin: int, end: int) -> np.ndarray:
        parts = []
        if begin < self.on_disk:
            self.file.seek(begin * TUPLE.itemsize)
            count = min(end, self.on_disk) - begin
            parts.append(np.frombuffer(self.file.read(count * TUPLE.itemsize), TUPLE))
        if end > self.on_disk:
            if len(self.kept) > 1:
                self.kept = [np.concatenate(self.kept)]
            parts.append(self.kept[0][max(0, begin - self.on_disk) : end - self.on_disk])
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def next_block(self) -> np.ndarray | None:
        """The tuples added since, at most a block of them."""
        if self.read == self.size:
            return None
        begin, self.read = self.read, min(self.size, self.read + BLOCK)
        return self._slice(begin, self.read)

    def backwards(self) -> Iterator[np.ndarray]:
        """Blocks from the end on, each with one more tuple behind it where there is one."""
        end = self.size
        while end > 0:
            begin = max(0, end - BLOCK)
            yield self._slice(begin, min(self.size, end + 1))
            end = begin

    def last(self) -> int:
        return int(self._slice(self.size - 1, self.size)["at"][0])


TUPLE = np.dtype([("at", np.int64), ("lcp", np.uint8)])


class Pool:
    """The queues of all first characters, with one budget: the fullest queue goes to disk first."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.held = scratch, 0
        self.queues = [Queue(self) for _ in range(256)]

    def grew(self, queue: Queue, size: int) -> None:
        self.held += size
        if self.held > self.scratch.budget:
            fullest = max(self.queues, key=lambda q: q.size - q.on_disk)
            self.held -= (fullest.size - fullest.on_disk) * TUPLE.itemsize
            fullest.spill()


class RunningMinimum:
    """For each target character, the least common prefix since the last tuple that was sent to it."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.since = np.full(256, 255, np.uint8)
        self.started = np.zeros(256, bool)

    def send(self, lcp: np.ndarray, sender: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the senders by target, the common prefixes of what they send, and the number per target.

        ``lcp``: between a block's neighbours (the first with what came before);
        ``sender``: ascending places in the block; ``char``: their targets.
        """
        order = np.argsort(char, kind="stable")
        at, target = sender[order], char[order]
        counts = np.bincount(target, minlength=256)
        first = np.append(True, target[1:] != target[:-1]) if len(at) else np.zeros(0, bool)
        begin = np.where(first, 0, np.append(0, at[:-1] + 1)) if len(at) else at
        levels = [lcp]
        while len(levels[-1]) > 1 << (len(levels) - 1):
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        least = self._least(levels, begin, at)
        heads, which = np.flatnonzero(first), target[first]
        least[heads] = np.minimum(least[heads], self.since[which])
        out = np.minimum(least.astype(np.int16) + 1, self.depth).astype(np.uint8)
        out[heads[~self.started[which]]] = 0
        self.started[which] = True
        tails = np.append(heads[1:], len(at)) - 1 if len(at) else heads
        self.since = np.minimum(self.since, lcp.min())
        after = at[tails] + 1
        rest = np.full(len(tails), 255, np.uint8)
        some = after < len(lcp)
        rest[some] = self._least(levels, after[some], np.full(int(some.sum()), len(lcp) - 1))
        self.since[which] = rest
        return order, out, counts

    @staticmethod
    def _least(levels: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.uint8)
        size = end - begin + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in range(len(levels)):
            some = np.flatnonzero(level == k)
            if len(some):
                out[some] = np.minimum(levels[k][begin[some]], levels[k][end[some] - (1 << k) + 1])
        return out


def _types(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """True where the suffix is of type S (smaller than the next one); by blocks from the end."""
    n = len(text)
    out = scratch.array(n, bool)
    later = False  # type of the suffix behind the block; the last suffix is of type L
    end = n
    while end > 0:
        begin = max(0, end - (1 << 20))
        here = np.asarray(text[begin:end])
        ahead = np.append(here[1:], text[end] if end < n else here[-1]) if len(here) else here
        smaller, equal = here < ahead, here == ahead
        if end == n:
            equal[-1], smaller[-1] = False, False
        # An equal pair takes the type of the next place that differs.
        place = np.where(equal, len(here), np.arange(len(here)))
        decide = np.minimum.accumulate(place[::-1])[::-1]
        known = np.append(smaller, later)
        out[begin:end] = known[decide]
        later = bool(out[begin])
        end = begin
    return out


def dense_ranks(keys: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """The rank of each key among the distinct keys, and their number; beyond the budget by a distribution to files."""
    n, out = len(keys), scratch.array(len(keys), np.int64)
    if keys.nbytes * 4 <= max(scratch.budget, 1 << 16):
        values, inverse = np.unique(np.asarray(keys), return_inverse=True)
        out[:] = inverse
        return out, len(values)
    share = max(1, scratch.budget // 8 // keys.itemsize)
    sample = np.sort(np.asarray(keys[:: max(1, n // 65_536)]))
    pivots = np.unique(sample[np.linspace(0, len(sample) - 1, -(-n // share) + 1).astype(int)[1:-1]])
    files = [open(scratch.path(), "w+b") for _ in range(len(pivots) + 1)]
    row = np.dtype([("key", keys.dtype), ("at", np.int64)])
    for begin in range(0, n, share):
        part = np.asarray(keys[begin : begin + share])
        rows = np.empty(len(part), row)
        rows["key"], rows["at"] = part, np.arange(begin, begin + len(part))
        to = np.searchsorted(pivots, part, "right")
        rows = rows[order := np.argsort(to, kind="stable")]
        for k, some in enumerate(np.split(rows, np.searchsorted(to[order], np.arange(1, len(files))))):
            files[k].write(some.tobytes())
    rank = 0
    for f in files:
        f.seek(0)
        rows = np.frombuffer(f.read(), row)
        name = f.name
        f.close()
        os.remove(name)
        values, inverse = np.unique(rows["key"], return_inverse=True)
        out[rows["at"]] = inverse + rank
        rank += len(values)
    return out, rank


def _names(text: np.ndarray, lms: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Names, in order, of the substrings from one LMS place to the next (included).

    Where one substring is the beginning of another, the shorter one is
    greater: its last place is of type S and the other's there of type L.
    """
    m, n = len(lms), len(text)
    names, count = scratch.array(m, np.int64), 1
    left, offset, per_key = np.arange(m), 0, 7
    step = max(1, scratch.budget // 128)
    while True:
        keys = scratch.array(len(left), np.int64)
        for b in range(0, len(left), step):
            some = left[b : b + step]
            begin = np.asarray(lms[some])
            last = np.where(some + 1 < m, lms[np.minimum(some + 1, m - 1)], n)
            key = np.zeros(len(some), np.int64)
            for k in range(offset, offset + per_key):
                place = begin + k
                symbol = np.where(place < n, text[np.minimum(place, n - 1)].astype(np.int64) + 1, 0)
                key = key * 258 + np.where((place > last) & (last < n), 257, symbol)
            keys[b : b + step] = key
        first, distinct = dense_ranks(keys, scratch)
        if offset == 0:
            names[:], count = first, distinct
        else:
            # Order by the name so far, then by these places.
            both, _ = dense_ranks(np.asarray(names[left]) * np.int64(distinct) + first, scratch)
            widened = np.asarray(names) * np.int64(len(left) + 1)
            widened[left] += both + 1
            names[:], count = dense_ranks(widened, scratch)
        offset += per_key
        last = np.where(left + 1 < m, lms[np.minimum(left + 1, m - 1)], n)
        left = left[last - lms[left] >= offset - 1]  # the mark behind the substring counts as well
        if not len(left):
            return names, count


def _ranked_by_doubling(names: np.ndarray, count: int, lms: np.ndarray, depth: int, scratch: Scratch) -> np.ndarray:
    """Ranks of the suffixes of the reduced text, as far as ``depth`` bytes tell them apart."""
    m, width = len(names), 1
    while count < m:
        reach = lms[np.minimum(np.arange(m) + width, m - 1)] - lms
        if m <= width or int(reach[: max(0, m - width)].min(initial=depth)) >= depth:
            return names
        keys = np.asarray(names) * np.int64(count + 1)
        keys[: m - width] += np.asarray(names[width:]) + 1
        names, count = dense_ranks(keys, scratch)
        width *= 2
    return names


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of suffixes a and b, at most ``depth``."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    words = np.ndarray((max(0, n - 7),), "<u8", text, strides=(1,)) if n >= 8 else np.zeros(0, "<u8")
    while len(left):
        x, y = a[left] + out[left], b[left] + out[left]
        inside = np.maximum(x, y) < n - 7
        tail = left[~inside]
        for i in tail.tolist():  # at the very end of the text
            k = int(out[i])
            while k < depth and a[i] + k < n and b[i] + k < n and text[a[i] + k] == text[b[i] + k]:
                k += 1
            out[i] = k
        left, x, y = left[inside], x[inside], y[inside]
        differs = words[x] ^ words[y]
        lowest = differs & (~differs + np.uint64(1))
        same = np.where(differs == 0, 8, (np.bitwise_count(lowest - np.uint64(1)) >> 3).astype(np.int64))
        out[left] += same
        left = left[(same == 8) & (out[left] < depth)]
    return np.minimum(out, depth)


def suffixes(text: np.ndarray, depth: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in blocks: positions, and the common prefix with the one before.

    Suffixes that agree in ``depth`` bytes stand together, in any order.
    """
    n = len(text)
    if n == 0:
        return
    small = _types(text, scratch)
    lms_blocks = []
    for begin in range(0, n, 1 << 20):
        end = min(n, begin + (1 << 20))
        before = np.append(small[begin - 1] if begin else True, small[begin : end - 1])
        lms_blocks.append(np.flatnonzero(small[begin:end] & ~before) + begin)
    total = sum(map(len, lms_blocks))
    lms = scratch.array(total, np.int64)
    lms[:] = np.concatenate(lms_blocks) if lms_blocks else 0
    del small, lms_blocks
    ordered, lms_lcp = scratch.array(total, np.int64), scratch.array(total, np.uint8)
    if total:
        names, count = _names(text, lms, scratch)
        ranks = _ranked_by_doubling(names, count, lms, depth, scratch)
        ordered[:] = lms[np.argsort(ranks)]
        for begin in range(1, total, 1 << 20):
            end = min(total, begin + (1 << 20))
            lms_lcp[begin:end] = _common(text, ordered[begin - 1 : end - 1], ordered[begin:end], depth)
        del names, ranks

    def run(at: int) -> int:
        """How often the first character of a suffix repeats, at most ``depth``."""
        here = np.asarray(text[at : at + depth])
        other = np.flatnonzero(here != here[0])
        return int(other[0]) if len(other) else len(here)

    def induce(queues: list[Queue], least: RunningMinimum, at: np.ndarray, lcp: np.ndarray, keep) -> None:
        before = at - 1
        char = text[before]  # place -1 is the last one, and left out
        sender = np.flatnonzero((at > 0) & keep(char, text[np.minimum(at, n - 1)]))
        order, out, counts = least.send(lcp, sender, char[sender])
        sent = np.empty(len(order), TUPLE)
        sent["at"], sent["lcp"] = before[sender][order], out
        end = 0
        for c in np.flatnonzero(counts).tolist():
            begin, end = end, end + int(counts[c])
            queues[c].add(sent[begin:end].copy())

    larges, least = Pool(scratch), RunningMinimum(depth)
    # The empty suffix comes first and induces the last one.
    larges.queues[int(text[n - 1])].add(np.array([(n - 1, 0)], TUPLE))
    least.started[int(text[n - 1])] = True
    starts = np.zeros(257, np.int64)
    for begin in range(0, total, 1 << 20):
        starts[1:] += np.bincount(text[ordered[begin : begin + (1 << 20)]], minlength=256)
    starts = np.cumsum(starts)
    for c in range(256):
        queue, head = larges.queues[c], True
        while (block := queue.next_block()) is not None:
            lcp = block["lcp"].copy()
            if head:
                lcp[0], head = 0, False
            induce(larges.queues, least, block["at"], lcp, np.greater_equal)
        for begin in range(int(starts[c]), int(starts[c + 1]), BLOCK):
            end = min(int(starts[c + 1]), begin + BLOCK)
            at, lcp = np.asarray(ordered[begin:end]), np.array(lms_lcp[begin:end])
            if begin == starts[c]:
                lcp[0] = min(run(queue.last()), run(int(at[0]))) if queue.size else 0
            induce(larges.queues, least, at, lcp, np.greater_equal)

    smalls, least = Pool(scratch), RunningMinimum(depth)
    for c in range(255, -1, -1):
        queue, head = smalls.queues[c], True
        while (block := queue.next_block()) is not None:
            at, lcp = block["at"], block["lcp"].copy()
            if head:
                lcp[0], head = 0, False
            yield at, lcp
            induce(smalls.queues, least, at, lcp, np.less_equal)
        first = True
        for block in larges.queues[c].backwards():
            held = block[: -1] if not first else block
            at = held["at"][::-1]
            # The common prefix with the next larger one is stored with that one.
            lcp = np.append(block["lcp"][-1] if not first else 0, held["lcp"][:0:-1]).astype(np.uint8)
            if first:
                lcp[0] = min(run(int(at[0])), run(queue.last())) if queue.size else 0
                first = False
            yield at, lcp
            induce(smalls.queues, least, at, lcp, np.less)
        queue.kept, queue.pool.held = [], queue.pool.held - (queue.size - queue.on_disk) * TUPLE.itemsize
