"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A document
is parsed greedily into the longest phrases that occur in that text, and the
language that needs the fewest phrases, normalised as bits per letter
(phrases x log2 of the labelled length / document length), wins.

Text is lower-cased; everything that is no letter counts as one space between
letters.  Each letter of the labelled text has its own symbol; letters that it
lacks are phrases of their own.

The automata of all languages are one table of transitions, and all documents
of a batch are parsed side by side for all languages, one letter at a time; a
missing transition holds, as a negative number, where the next phrase begins.
The table has columns for the ``LETTERS`` most frequent letters; transitions by
the others (there are thousands in Chinese) are kept by state and letter in a
hash table, which is asked only where a text holds such a letter.

Scale: the labelled text is a bounded sample (``SAMPLE_CHARS`` per language, of
whole documents of at most ``SAMPLE_DOC_CHARS`` and, where a language has too
few of them, of pieces spread over longer ones, drawn by a hash of the id), so
the automata have a fixed size; workers build them once from the broadcast
sample.  Predicting is one narrow pass over whole texts, without a shuffle.

Defined results: null texts and texts without a letter give ``und`` and score
0, and so does every text if there is nothing labelled to learn from (the
filter of the pipeline keeps those that have a letter); ties go to the language
that sorts first; a null id is held out of learning; repeated
rows are predicted each; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.byte_bpe import LETTER, code_point_classes, runs
from ledgerlens.llm.common import map_batches, parts, pick, worker_table
from ledgerlens.llm.tables import IntTable

#: Labelled letters per language, the longest document taken whole for them, and how many documents are drawn.
SAMPLE_CHARS = 40_000
SAMPLE_DOC_CHARS = 20_000
SAMPLE_DOCS = 80
#: Where the others are too few, so many longer ones are drawn, of which pieces of this length are taken.
SAMPLE_LONG_DOCS = 20
PIECE_CHARS = 1000
#: Letters with a column in the table of transitions, most frequent first; transitions by other letters are looked up.
LETTERS = 126
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: a third of them, by their id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _pieces(text: Column) -> Column:
    """At most ``SAMPLE_CHARS`` of a text, what is no letter as one space: all of it, or pieces spread evenly over it."""
    text = F.regexp_replace(text, r"\P{L}+", " ")
    n = SAMPLE_CHARS // PIECE_CHARS
    start = lambda k: F.floor(k * (F.length(text) - PIECE_CHARS) / (n - 1)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.substr(text, start(k), F.lit(PIECE_CHARS)))
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(cut, " "))


def labelled_sample(docs: DataFrame) -> dict[str, list[str]]:
    """Labelled texts per language, about ``SAMPLE_CHARS`` long together where there are so many."""
    labelled = pick(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    labelled = labelled.where(F.col("text").rlike(r"\p{L}"))
    length = F.length("text")
    short = length <= SAMPLE_DOC_CHARS
    sizes = labelled.groupBy("lang").agg(
        F.count_if(short).alias("n"), F.coalesce(F.sum(F.when(short, length)), F.lit(0)).alias("chars"), F.count_if(~short).alias("n_long")
    )
    shares, most = {}, {}
    for r in sizes.collect():
        few = r["chars"] < SAMPLE_CHARS  # all of them, then, and long ones as well
        wanted = max(SAMPLE_DOCS, 2 * SAMPLE_CHARS * r["n"] / max(1, r["chars"]))
        shares[r["lang"], False] = min(1.0, wanted / max(1, r["n"]))
        shares[r["lang"], True] = min(1.0, SAMPLE_LONG_DOCS / max(1, r["n_long"])) if few else 0.0
        most[r["lang"], False], most[r["lang"], True] = int(2 * wanted), 2 * SAMPLE_LONG_DOCS
    if not shares:
        return {}
    by_lang = lambda of, long: F.create_map(*[F.lit(v) for (lang, k), x in of.items() if k == long for v in (lang, x)])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("sample")), 11) / F.lit(float(1 << 53))
    rows = labelled.select("lang", "text", draw.alias("draw"), (~short).alias("long"))

    def drawn_from(rows: DataFrame) -> list:
        # Rows that repeat id and text are drawn together, so a bound holds as well: each task keeps no more than this.
        place = F.row_number().over(Window.partitionBy("lang", "long").orderBy("draw", "text"))
        some = rows.withColumn("place", place).where(F.col("place") <= F.when(F.col("long"), by_lang(most, True)).otherwise(by_lang(most, False)))
        return some.select("lang", F.when(F.col("long"), _pieces(F.col("text"))).otherwise(F.col("text")).alias("text"), "draw", "long").collect()

    # Per language at most twice SAMPLE_DOCS texts, or four times SAMPLE_CHARS, and twice SAMPLE_LONG_DOCS times SAMPLE_CHARS.
    drawn = drawn_from(rows.where(F.col("draw") < F.when(F.col("long"), by_lang(shares, True)).otherwise(by_lang(shares, False))))
    missed = sorted({lang for lang, _ in shares} - {r["lang"] for r in drawn})
    if missed:  # few different rows, and none of them drawn: take the first ones
        drawn += drawn_from(rows.where(F.col("lang").isin(missed)))
    out: dict[str, list[str]] = {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["long"], r["draw"], r["text"])):
        texts = out.setdefault(r["lang"], [])
        if sum(map(len, texts)) < SAMPLE_CHARS:
            texts.append(r["text"])
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the empty one."""
    out, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        now = len(out)
        out.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = now
            p = link[p]
        if p >= 0:
            q = out[p][c]
            if length[q] != length[p] + 1:
                copy = len(out)
                out.append(dict(out[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and out[p].get(c) == q:
                    out[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[now] = q
        last = now
    return out


class CrossParser:
    """The automata of all languages as one table, and the parse of many texts at once."""

    def __init__(self, sample: dict[str, list[str]]) -> None:
        self.classes = code_point_classes()
        self.langs = sorted(sample)
        counts = Counter(c for texts in sample.values() for t in texts for c in t.lower())
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if self.classes[ord(c)] == LETTER]
        kind = np.min_scalar_type(len(letters) + 1)
        self.symbol_of = np.where(self.classes == LETTER, len(letters) + 1, 0).astype(kind)  # the last one: in no sample
        self.symbol_of[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.n_symbols = len(letters) + 2
        self.width = min(len(letters), LETTERS) + 2  # in the last column no transition is found
        tables, self.roots, self.bits, base = [], [], [], 0
        rare, rare_begins = [np.zeros((2, 0), np.int64)], []
        for lang in self.langs:
            symbols = self.symbols(" ".join(sample[lang]))
            states = suffix_automaton(symbols.tolist())
            dead = len(states)  # behind a symbol that the language lacks
            begins = np.array([states[0].get(c, dead) for c in range(self.n_symbols)])
            table = np.tile(~((begins[: self.width] + base) * self.width), (dead + 1, 1))
            for s, go in enumerate(states):
                to = np.array([list(go), list(go.values())], np.int64).reshape(2, -1)
                often = to[0] <= LETTERS
                table[s, to[0, often]] = (to[1, often] + base) * self.width
                if not often.all():
                    rare.append(np.array([(s + base) * self.n_symbols + to[0, ~often], to[1, ~often] + base]))
            tables.append(table.astype(np.int32))
            rare_begins.append(begins + base)
            self.roots.append((dead + base) * self.width)  # the first phrase begins like any other
            self.bits.append(np.log2(max(2, len(symbols))))
            base += dead + 1
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.rare, self.rare_begins = IntTable(*np.concatenate(rare, axis=1)), np.array(rare_begins)

    def symbols(self, text: str) -> np.ndarray:
        """The text as letters and single spaces (0)."""
        out = self.symbol_of[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        return out[(out != 0) | (np.append(1, out[:-1]) != 0)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """The number of phrases of each text in each language."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        joined = np.concatenate([*texts, np.zeros(0, np.uint8)])
        column, is_rare = joined, None
        if self.n_symbols > self.width:
            column, is_rare = np.minimum(joined, self.width - 1), (joined > LETTERS) & (joined < self.n_symbols - 1)
        at = (np.cumsum(lengths) - lengths)[order]
        # How many texts have a letter at each place: those are the first ones in this order.
        active = len(texts) - np.searchsorted(lengths[order][::-1], np.arange(lengths.max(initial=0)), "right")
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(texts), 1)
        count = np.zeros_like(state)
        for place, k in enumerate(active.tolist()):
            found = self.table.take(state[:, :k] + column.take(at[:k] + place))
            if is_rare is not None:
                of_rare = np.flatnonzero(is_rare.take(at[:k] + place))
                if len(of_rare):
                    found[:, of_rare] = self._rare_steps(state[:, of_rare], joined.take(at[of_rare] + place))
                absent = np.flatnonzero(joined.take(at[:k] + place) == self.n_symbols - 1)
                found[:, absent] = ~(self.rare_begins[:, -1:] * self.width)
            new = found >> 31  # -1 where a phrase begins
            count[:, :k] -= new
            state[:, :k] = found ^ new
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def _rare_steps(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """What the table would hold for letters without a column."""
        go = self.rare.get((state.astype(np.int64) // self.width * self.n_symbols + symbols).ravel()).reshape(state.shape)
        return np.where(go >= 0, go * self.width, ~(self.rare_begins[:, symbols] * self.width))

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score and whether there is a letter, of each text."""
        parsed = [self.symbols(t) for t in texts]
        if not self.langs:
            return [(UNDETERMINED, 0.0, bool(p.any())) for p in parsed]
        bits = self.phrases(parsed) * np.array(self.bits)[:, None] / np.maximum(1, [len(p) for p in parsed])
        best = bits.argmin(axis=0)
        score = 1 / np.exp2(bits.min(axis=0) - bits).sum(axis=0)
        return [
            (self.langs[b], float(s), True) if p.any() else (UNDETERMINED, 0.0, False)
            for b, s, p in zip(best.tolist(), score.tolist(), parsed)
        ]


def _worker_parser(shared, key: str) -> CrossParser:
    return worker_table(("parser", key), lambda: CrossParser(shared.value))


def _share(docs: DataFrame, sample: dict[str, list[str]] | None):
    sample = labelled_sample(docs) if sample is None else sample
    key = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(sample), key


def _predict(parser: CrossParser, column: pa.Array) -> list[tuple[str, float, bool]]:
    texts = [(b or b"").decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]
    return [found for begin, end in runs(texts, 4_000_000) for found in parser.predict(texts[begin:end])]


def identify_language(docs: DataFrame, sample: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the share of the best language's likelihood per letter).

    Learns from the labelled rows of ``docs`` that are not held out, unless a
    sample (texts per language) is given.
    """
    shared, key = _share(docs, sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _worker_parser(shared, key)
        for batch in parts(batches, 2000):
            found = _predict(parser, batch.column(2))
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("binary").alias("text"),
    )
    return map_batches(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")


def with_known_language(docs: DataFrame, sample: dict[str, list[str]] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, whether or not a language was learnt; a null ``lang``
    becomes the predicted one, where there is such a column.  All other columns stay as they are."""
    shared, key = _share(docs, sample)
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _worker_parser(shared, key)
        for batch in parts(batches, 2000):
            found = _predict(parser, batch.column(at))
            columns = list(batch.columns)
            if lang is not None:
                said = pa.array([None if f[0] == "und" else f[0] for f in found], pa.string())
                columns[lang] = pc.coalesce(columns[lang].cast(pa.string()), said)
            named = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield named.filter(pa.array([f[2] for f in found], pa.bool_()))

    by_place = docs.toDF(*[f"_in{i}" for i in range(len(docs.columns))])
    return map_batches(by_place, work, by_place.schema).toDF(*docs.columns)
