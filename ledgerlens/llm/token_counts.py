"""Token counts by prefix dynamic programming over a piece vocabulary.

For every prefix of a text the exact number of tokens of that prefix is found,
from the counts of shorter prefixes: the encoding of a prefix is the encoding
of a shorter one plus one last token.  Of the pieces that end the prefix,
exactly one is right: the one that, behind the last token of what is left, is
not merged differently (pairs of neighbouring tokens decide this alone, and
their answers are kept in a table).  The counts of all prefixes answer how many tokens a
truncated text has, or how much of a text fits a budget, without encoding again.

No piece goes on across a word start, so a text is a row of words whose counts
add up; the counts of a word's prefixes are cached, and those of new words are
found for all words of one length side by side, prefix by prefix.  The vocabulary merges the
pair of highest score, leftmost of equal ones; a character without a piece
counts as its bytes.

Scale: one narrow pass, no shuffle.  The pieces are broadcast (32,000 strings).
Caches are bounded.  ``steps`` holds the counts of all prefixes in one signed
byte per character.

Defined results: a null text counts as empty and has no tokens; bytes that are
no UTF-8 are read as U+FFFD; repeated rows are counted each; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.byte_bpe import runs
from ledgerlens.llm.common import parts, pick, worker_table
from ledgerlens.llm.tables import IntTable

CACHED_WORDS = 250_000
CACHED_PAIRS = 1_000_000
CACHED_CHARS = 16_000_000  # of the words held together
MARK = "▁"  # stands for a space
_UNKNOWN = -1
_NEVER = float("-inf")


def read_pieces(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model, in order of their ids; an empty piece where an id is not for text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    if model.normalize(" a  b ") != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}":
        raise ValueError("only models that keep the text and add one leading space are supported")
    special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [("", 0.0) if special(i) else (model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class PrefixCounter:
    """Counts of all prefixes of words and texts."""

    def __init__(self, pieces: list[tuple[str, float]], with_steps: bool = False) -> None:
        self.pieces = [p for p, _ in pieces]
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p}
        self.scores = {p: s for p, s in pieces if p}
        self.longest = max(map(len, self.ids))
        known = {p for p in self.ids if len(p) == 1}
        for p in self.ids:
            if MARK in p.lstrip(MARK) or not known.issuperset(p) or "\n" in p[1:] or p[:1] == "\n" != p:
                raise ValueError(f"piece {p!r} crosses a word start or has a character without a piece")
        self.with_steps = with_steps
        self.pairs = IntTable()
        self.profiles: dict[int, tuple] = {}
        self.words: dict = {}
        self.held_chars = 0
        self.answers: dict[int, bool] = {}
        self._make_trie()
        self.split = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall

    def _make_trie(self) -> None:
        """Nodes for the beginnings of pieces; edges in a table by node and letter."""
        self.alphabet = sorted({c for p in self.ids for c in p})
        self.letters = np.full(0x110000, -1, np.int32)
        self.letters[[ord(c) for c in self.alphabet]] = np.arange(len(self.alphabet))
        number, edges = {c: i for i, c in enumerate(self.alphabet)}, {}
        pieces = {0: -1}
        for p, i in self.ids.items():
            node = 0
            for c in p:
                node = edges.setdefault(node * len(number) + number[c], len(edges) + 1)
                pieces.setdefault(node, -1)
            pieces[node] = i
        self.trie = IntTable(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self.node_piece = np.fromiter((pieces[n] for n in range(len(pieces))), np.int64, len(pieces))

    def profile(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """How a piece merges by itself: the score of each merge in turn, and the first and the
        last part before each merge and at the end."""
        parts, scores = list(piece), self.scores
        taken, first, last = [], [parts[0]], [parts[-1]]
        while True:
            found = [scores.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            best = max(found, default=_NEVER)
            if best == _NEVER:
                return taken, first, last
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            taken.append(best)
            first.append(parts[0])
            last.append(parts[-1])

    def stays(self, before: int, piece: int) -> bool:
        """Whether two tokens side by side are encoded as just these; ``before`` unknown: the piece alone.

        Both merge on their own, the better next merge first, unless joining
        the parts that touch is better at some time.
        """
        for i in (before, piece):
            if i != _UNKNOWN and i not in self.profiles:
                self.profiles[i] = self.profile(self.pieces[i])
        taken_b, first, _ = self.profiles[piece]
        if first[-1] != self.pieces[piece]:
            return False  # no text gives this piece
        if before == _UNKNOWN:
            return True
        taken_a, _, last = self.profiles[before]
        taken_a, taken_b, scores, i, j = [*taken_a, _NEVER], [*taken_b, _NEVER], self.scores, 0, 0
        while True:
            across, a, b = scores.get(last[i] + first[j], _NEVER), taken_a[i], taken_b[j]
            if across > a and across >= b and across != _NEVER:
                return False
            if a == b == _NEVER:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def counts(self, word: str) -> array:
        """The number of tokens of each prefix, from the empty one on; linear in the word."""
        ids, width, answers = self.ids, len(self.pieces), self.answers
        counts, last = array("i", [0]), array("i", [_UNKNOWN])
        for end in range(1, len(word) + 1):
            if word[end - 1] not in ids:
                counts.append(counts[-1] + len(word[end - 1].encode()))
                last.append(_UNKNOWN)
                continue
            for begin in range(max(0, end - self.longest), end):
                piece = ids.get(word[begin:end])
                if piece is None:
                    continue
                pair = (last[begin] + 1) * width + piece
                fits = answers.get(pair)
                if fits is None:
                    if len(answers) >= CACHED_PAIRS:
                        answers.clear()
                    fits = answers[pair] = self.stays(last[begin], piece)
                if fits:
                    counts.append(counts[begin] + 1)
                    last.append(piece)
                    break
        return counts

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``stays`` for many pairs, by a table of the answers so far."""
        width = len(self.pieces)
        keys = (before + 1) * width + piece
        known = self.pairs.get(keys)
        if (known < 0).any():
            new = np.unique(keys[known < 0])
            if self.pairs.size + len(new) > CACHED_PAIRS:
                self.pairs, new = IntTable(), np.unique(keys)
            self.pairs.add(new, np.array([self.stays(k // width - 1, k % width) for k in new.tolist()], np.int64))
            known = self.pairs.get(keys)
        return known == 1

    def counts_together(self, words: list[str]) -> np.ndarray:
        """``counts`` for words of one length, a row each: prefix by prefix for all words at once."""
        n, length = len(words), len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length)
        letters = self.letters[points]
        unknown_cost = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        counts, last = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), _UNKNOWN, np.int64)
        # Places (word, begin) whose text up to ``end`` begins some piece, and its node in the trie.
        word, begin, node = (np.zeros(0, np.int64) for _ in range(3))
        every = np.arange(n)
        for end in range(1, length + 1):
            word, begin = np.append(word, every), np.append(begin, np.full(n, end - 1))
            node = np.append(node, np.zeros(n, np.int64))
            letter = letters[word, end - 1]
            node = self.trie.get(node * len(self.alphabet) + np.maximum(letter, 0))
            alive = (node >= 0) & (letter >= 0)
            word, begin, node = word[alive], begin[alive], node[alive]
            piece = self.node_piece[node]
            some = np.flatnonzero(piece >= 0)
            some = some[self._fits(last[word[some], begin[some]], piece[some])]
            w = word[some]
            counts[w, end] = counts[w, begin[some]] + 1
            last[w, end] = piece[some]
            odd = np.flatnonzero(letters[:, end - 1] < 0)
            counts[odd, end] = counts[odd, end - 1] + unknown_cost[odd, end - 1]
        return counts

    def learn(self, words: set[str]) -> None:
        """Hold, for these words, the count and the step of the count at each character (one signed
        byte each); forget others if they would be too many."""
        new = words - self.words.keys()
        chars = sum(map(len, new))
        if len(self.words) + len(new) > CACHED_WORDS or self.held_chars + chars > CACHED_CHARS:
            self.words.clear()
            new, self.held_chars, chars = words, 0, sum(map(len, words))
        self.held_chars += chars
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        for length, same in by_length.items():
            if length > 64:
                counts = np.stack([np.frombuffer(self.counts(w), np.int32) for w in same])
            else:
                counts = self.counts_together(same)
            totals = counts[:, -1].tolist()
            if self.with_steps:
                steps = np.diff(counts, axis=1).astype(np.int8)
                self.words.update(zip(same, zip(totals, map(np.ndarray.tobytes, steps))))
            else:
                self.words.update(zip(same, totals))

    def texts(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """Each text's count and, where steps are held, the steps of the counts of its prefixes."""
        split = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*split))
        held = self.words
        if not self.with_steps:
            return [(sum(map(held.__getitem__, words)), b"") for words in split]
        out = []
        for words in split:
            found = [held[w] for w in words]
            steps = np.frombuffer(b"".join(s for _, s in found), np.int8)
            if len(steps):  # the empty text has no leading space
                steps = np.append(steps[0] + steps[1], steps[2:]).astype(np.int8)
            out.append((sum(n for n, _ in found), steps.tobytes()))
        return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, with_steps: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and the steps of all prefix counts if asked for."""
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + (", steps binary" if with_steps else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_table(("pieces", model_path, with_steps), lambda: PrefixCounter(pieces.value, with_steps))
        for batch in parts(batches):
            raw = batch.column(1).to_pylist()
            texts = [(b or b"").decode("utf-8", "replace") for b in raw]
            found = [x for begin, end in runs(texts) for x in counter.texts(texts[begin:end])]
            counts = pa.array([n for n, _ in found], pa.int64())
            columns = [batch.column(0), pa.array([len(b or b"") for b in raw], pa.int64()), counts]
            columns.append(pa.array([n > limit for n, _ in found], pa.bool_()))
            if with_steps:
                columns.append(pa.array([s for _, s in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(work, schema)


def count_of_prefix(steps: bytes | None, length: int) -> int:
    """Tokens of the first ``length`` characters."""
    return int(np.frombuffer(steps or b"", np.int8)[:length].sum(dtype=np.int64))


def longest_prefix(steps: bytes | None, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens (counts may fall from one prefix to the next)."""
    counts = np.cumsum(np.frombuffer(steps or b"", np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_tokens(steps: Column, length: int) -> Column:
    """Column form of ``count_of_prefix``."""
    return F.pandas_udf(lambda s: pd.Series([count_of_prefix(x, length) for x in s]), "long")(steps)


def budget_length(steps: Column, budget: int) -> Column:
    """Column form of ``longest_prefix``."""
    return F.pandas_udf(lambda s: pd.Series([longest_prefix(x, budget) for x in s]), "long")(steps)
