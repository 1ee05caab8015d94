"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The patterns (an assignment to a telling name, an access key, a long
hexadecimal run) always count.  The random field adds spans: each token of a
text gets features of its shape, its neighbours and its file, and the most
likely sequence of the labels outside, begin and inside is found by Viterbi's
algorithm.  Of runs labelled begin or inside, what lies outside the pattern
spans is reported with the kind ``crf``, if it has a letter or digit.

The field is trained here, by gradient ascent on the likelihood of labels that
the patterns give to a bounded sample (``SAMPLE_DOCS`` documents, half of them
with a pattern span where there are so many, however rare they are; drawn by a
hash of id and text; of documents over ``SAMPLE_DOC_CHARS`` windows around the
spans).  In half of the training
windows the telling names are hidden from the features, so that it learns from
shape and place as well.

Features, forward-backward and Viterbi are worked out for many documents side
by side.

Scale: narrow passes over whole texts, without a shuffle of them (one counts the
texts with a span, one draws the sample, one scans); the weights (a few
hundred numbers) are shipped with the task.

Defined results: a null text counts as empty and has no spans (the hash is that
of an empty string); if no text has a pattern span, the field adds nothing;
repeated rows are scanned each; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.byte_bpe import runs
from ledgerlens.llm.common import parts, pick

# Kinds in order, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_LEAST_VALUE, _LEAST_HEX = 6, 24
#: The three patterns with their least lengths, for drawing the sample.
_ANY = "|".join((_ASSIGN.pattern[:-2] + "{%d,})" % _LEAST_VALUE, _ACCESS.pattern, "[0-9a-f]{%d}" % _LEAST_HEX))

SAMPLE_DOCS = 3000
SAMPLE_DOC_CHARS = 20_000
#: On either side of a span in a long document.
EXCERPT_CHARS = 500
WINDOW = 12
EPOCHS = 100
OUTSIDE, BEGIN, INSIDE = range(3)

# Character classes for tokens and their shapes.
_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _JOIN, _EQUALS, _QUOTE, _PUNCT, _FAR = range(10)


def _char_classes() -> np.ndarray:
    out = np.full(129, _PUNCT, np.uint8)  # the last one stands for everything beyond ASCII
    for chars, kind in (("\t\x0b\x0c\r ", _SPACE), ("\n", _LINE), ("=:", _EQUALS), ("\"'`", _QUOTE), ("+/_.-", _JOIN)):
        out[[ord(c) for c in chars]] = kind
    out[ord("a") : ord("z") + 1], out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    out[128] = _FAR
    return out


_CLASSES = _char_classes()
_HEX = np.zeros(129, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def pattern_spans(text: str, points: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; places are code points."""
    if points is None:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = []
    lower = text.encode("utf-8", "replace").lower()
    places = sorted({at for name in _NAMES for at in _find_all(lower, name)})
    end, ascii_only = 0, len(lower) == len(text)
    for at in places:
        start = at if ascii_only else len(lower[:at].decode("utf-8", "replace"))
        if start >= end and (m := _ASSIGN.match(text, start)):
            end = m.end()
            if m.end(2) - m.start(2) >= _LEAST_VALUE:
                out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    hexes = np.concatenate([[0], _HEX[np.minimum(points, 128)], [0]]).astype(np.int8)
    change = np.diff(hexes)
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = last - first >= _LEAST_HEX
    out += [(a, 2, b) for a, b in zip(first[long].tolist(), last[long].tolist())]
    return sorted(out)


def _find_all(text: bytes, name: bytes) -> Iterator[int]:
    at = text.find(name)
    while at >= 0:
        yield at
        at = text.find(name, at + 1)


class Tokens:
    """Tokens of many texts and their features: rows of feature numbers, one column per feature."""

    #: Values of each feature: length, kinds of characters, share of digits, changes between letters and
    #: digits, hexadecimal, telling name in the token, in the one before, in the one behind; what stands
    #: before it (equals sign, quote, line break), and behind it; of the file: names in it, share of digits.
    SIZES = (8, 32, 6, 6, 2, 2, 2, 2, 8, 8, 2, 4)
    STARTS = np.cumsum((0, *SIZES))[:-1]
    WIDTH = sum(SIZES)
    #: Features that tell of names.
    OF_NAMES = (5, 6, 7, 10)

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        low = np.minimum(points, 128)
        kinds = _CLASSES[low]
        sizes = np.array([len(t) + 1 for t in texts])
        self.text_starts = np.cumsum(sizes) - sizes
        inside = (kinds >= _LOWER) & (kinds <= _JOIN) | (kinds == _FAR)
        change = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        self.begin, self.end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        n = len(self.begin)
        self.text = np.searchsorted(self.text_starts, self.begin, "right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))
        if not n:
            self.features = np.zeros((0, len(self.SIZES)), np.int64)
            return
        total = lambda flags: np.append(0, np.cumsum(flags, dtype=np.int32))
        between = lambda sums, a, b: sums[b] - sums[a]
        length = self.end - self.begin
        of = {k: between(total(kinds == k), self.begin, self.end) for k in (_LOWER, _UPPER, _DIGIT, _JOIN, _FAR)}
        digits = kinds == _DIGIT
        turns = between(total(digits[1:] != digits[:-1]), self.begin, self.end - 1)
        hexes = between(total(_HEX[low]), self.begin, self.end) == length
        named = np.zeros(len(points), np.int8)
        lower = joined.encode("utf-8", "replace").lower()
        places = sorted({at for name in _NAMES for at in _find_all(lower, name)})
        last_byte = last_point = 0
        for at in places:
            last_point += len(lower[last_byte:at].decode("utf-8", "replace"))
            last_byte = at
            named[last_point] = 1
        name = (between(total(named), self.begin, self.end) > 0).astype(np.int64)
        gap_from = np.append(0, self.end[:-1])
        marks = sum(
            (between(total(kinds == k), gap_from, self.begin) > 0).astype(np.int64) << i
            for i, k in enumerate((_EQUALS, _QUOTE, _LINE))
        )
        same = self.text[1:] == self.text[:-1]
        before = np.append(0, np.where(same, name[:-1], 0))
        behind = np.append(np.where(same, name[1:], 0), 0)
        file_names = np.bincount(self.text, name, len(texts)) > 0
        file_digits = np.bincount(self.text, of[_DIGIT], len(texts)) / np.maximum(1, np.bincount(self.text, length, len(texts)))
        columns = (
            np.searchsorted([4, 8, 12, 16, 20, 32, 40], length, "right"),
            sum((of[k] > 0).astype(np.int64) << i for i, k in enumerate(of)),
            np.searchsorted([1e-9, 0.2, 0.4, 0.6, 0.9], of[_DIGIT] / length, "right"),
            np.minimum(5, turns // 2),
            hexes.astype(np.int64),
            name,
            before,
            behind,
            marks,
            np.append(np.where(same, marks[1:], 4), 4),
            file_names[self.text].astype(np.int64),
            np.searchsorted([0.01, 0.03, 0.1], file_digits, "right")[self.text],
        )
        self.features = np.stack(columns, axis=1) + self.STARTS

    def labels(self, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
        """The label of each token under the pattern spans of each text; a telling name itself is outside."""
        out = np.zeros(len(self.begin), np.int8)
        for i, found in enumerate(spans):
            for start, _, end in found:
                a = np.searchsorted(self.end, self.text_starts[i] + start, "right")
                b = np.searchsorted(self.begin, self.text_starts[i] + end, "left")
                inside = [t for t in range(a, b) if self.features[t, 5] == self.STARTS[5] or self.end[t] - self.begin[t] > 16]
                out[inside] = INSIDE
                out[inside[:1]] = BEGIN
        return out


class LinearChain:
    """The conditional random field: weights of the features by label, and of neighbouring labels."""

    def __init__(self) -> None:
        self.weights = np.zeros((Tokens.WIDTH, 3))
        self.steps = np.zeros((3, 3))
        self.trained = False

    def _scores(self, features: np.ndarray, hidden: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((*features.shape[:-1], 3))
        for f in range(features.shape[-1]):
            part = self.weights[features[..., f]]
            out += part if hidden is None or f not in Tokens.OF_NAMES else part * ~hidden[:, None, None]
        return out

    def _allowed(self) -> np.ndarray:
        out = self.steps.copy()
        out[OUTSIDE, INSIDE] = -1e9
        return out

    def train(self, features: np.ndarray, labels: np.ndarray) -> None:
        """``features``: windows x tokens x features; ``labels``: windows x tokens.  Adam, full batches."""
        n, length = labels.shape
        hidden = np.arange(n) % 2 == 1
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.weights, self.steps)]
        for epoch in range(1, EPOCHS + 1):
            scores, step = self._scores(features, hidden), self._allowed()
            forward, backward = np.zeros_like(scores), np.zeros_like(scores)
            forward[:, 0] = scores[:, 0]
            forward[:, 0, INSIDE] = -1e9
            for t in range(1, length):
                forward[:, t] = _log_sum(forward[:, t - 1][:, :, None] + step) + scores[:, t]
            for t in range(length - 2, -1, -1):
                backward[:, t] = _log_sum((step + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]).transpose(0, 2, 1))
            whole = _log_sum(forward[:, -1][:, :, None])[:, 0]
            miss = np.eye(3)[labels] - np.exp(forward + backward - whole[:, None, None])
            gradient = np.zeros_like(self.weights)
            for f in range(features.shape[-1]):
                part = miss if f not in Tokens.OF_NAMES else miss * ~hidden[:, None, None]
                np.add.at(gradient, features[..., f], part)
            steps = np.zeros((3, 3))
            for t in range(1, length):
                both = forward[:, t - 1][:, :, None] + step + (scores[:, t] + backward[:, t])[:, None, :]
                steps -= np.exp(both - whole[:, None, None]).sum(axis=0)
                np.add.at(steps, (labels[:, t - 1], labels[:, t]), 1)
            for w, g, m in zip((self.weights, self.steps), (gradient - 0.05 * self.weights, steps), moments):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                w += 0.1 * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.999**epoch)) + 1e-8)
        self.trained = True

    def decode(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The most likely labels of the tokens of many texts; ``counts``: tokens of each text, in order."""
        labels = np.zeros(len(features), np.int8)
        if not len(features) or not self.trained:
            return labels
        scores, step = self._scores(features), self._allowed()
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        active = len(counts) - np.searchsorted(counts[order][::-1], np.arange(counts.max()), "right")
        came = np.zeros((len(features), 3), np.int8)
        best = scores[starts[: active[0]]] + np.array([0, 0, -1e9])
        final = np.zeros(len(counts), np.int8)
        for t in range(1, len(active)):
            k = int(active[t])
            if k < len(best):
                final[k : len(best)] = best[k:].argmax(axis=1)
            ways = best[:k, :, None] + step
            at = starts[:k] + t
            came[at] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[at]
        final[: len(best)] = best.argmax(axis=1)
        now = np.zeros(0, np.int8)
        for t in range(len(active) - 1, -1, -1):
            k = int(active[t])
            now = np.append(now, final[len(now) : k])
            at = starts[:k] + t
            labels[at] = now
            now = came[at, now]
        return labels


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials along axis 1."""
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def train(texts: list[str]) -> LinearChain:
    """A field trained on the windows around the pattern spans of the texts, and on as many others."""
    model, found, labelled = LinearChain(), [], []
    for begin, end in runs(texts):
        tokens = Tokens(texts[begin:end])
        labels = tokens.labels([pattern_spans(t) for t in texts[begin:end]])
        n = len(labels)
        if n < 2 * WINDOW:
            continue
        centres = np.flatnonzero(labels == BEGIN)
        others = np.linspace(WINDOW, n - WINDOW - 1, max(100, len(centres))).astype(int)
        first = np.clip(np.repeat(np.concatenate([centres, others]), 2) - WINDOW // 2, 0, n - WINDOW)
        windows = first[:, None] + np.arange(WINDOW)
        windows = windows[labels[windows[:, 0]] != INSIDE]  # a window does not begin in the middle of a secret
        found.append(tokens.features[windows])
        labelled.append(labels[windows])
    if any(labels.any() for labels in labelled):
        model.train(np.concatenate(found), np.concatenate(labelled))
    return model


def _outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of start .. end outside the sorted spans."""
    for a, _, b in spans:
        if a < end and start < b:
            if start < a:
                yield start, a
            start = b
    if start < end:
        yield start, end


def _parts_of_run(tokens: Tokens, a: int, b: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches of the run of tokens a .. b that lie outside the spans; they begin and end in tokens."""
    shift = int(tokens.text_starts[tokens.text[a]])
    begins, ends = tokens.begin[a : b + 1] - shift, tokens.end[a : b + 1] - shift
    for start, end in _outside(int(begins[0]), int(ends[-1]), base):
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(begins, end, "left") - 1
        if first <= last:
            yield max(start, int(begins[first])), min(end, int(ends[last]))


def secret_spans(texts: list[str], model: LinearChain) -> list[list[tuple[int, str, int]]]:
    """All spans of each text, (start, kind, end), sorted; the field's own come last at a start."""
    tokens = Tokens(texts)
    labels = model.decode(tokens.features, tokens.counts)
    base = [pattern_spans(t) for t in texts]
    out = [[(a, k, b) for a, k, b in found] for found in base]
    secret = np.flatnonzero(labels != OUTSIDE)
    if len(secret):
        head = np.append(True, (secret[1:] != secret[:-1] + 1) | (labels[secret[1:]] == BEGIN) | (tokens.text[secret[1:]] != tokens.text[secret[:-1]]))
        firsts, lasts = secret[head], secret[np.append(np.flatnonzero(head)[1:], len(secret)) - 1]
        for a, b in zip(firsts.tolist(), lasts.tolist()):
            text = int(tokens.text[a])
            for start, end in _parts_of_run(tokens, a, b, base[text]):
                if any(map(str.isalnum, texts[text][start:end])):
                    out[text].append((start, len(KINDS), end))
    names = (*KINDS, "crf")
    return [[(a, names[k], b) for a, k, b in sorted(found)] for found in out]


def excerpt(text: str) -> str:
    """A text of at most ``SAMPLE_DOC_CHARS`` as it is; of a longer one windows around its pattern spans, or spread evenly."""
    if len(text) <= SAMPLE_DOC_CHARS:
        return text
    spans, each = pattern_spans(text), EXCERPT_CHARS
    n = SAMPLE_DOC_CHARS // (4 * each) if spans else SAMPLE_DOC_CHARS // each
    cut = []
    if not spans:
        cut = [(int(a), int(a) + each) for a in np.linspace(0, len(text) - each, n)]
    for i in sorted({int(i) for i in np.linspace(0, len(spans) - 1, n)}) if spans else ():
        start, end = spans[i][0], min(spans[i][2], spans[i][0] + 2 * each)
        a, b = max(0, start - each), min(len(text), end + each)
        # No other span is cut: a window begins behind one and ends before one.
        a = min(start, max([a, *(e for s, _, e in spans if s < a < e)]))
        b = max(end, min([b, *(s for s, _, e in spans if s < b < e)]))
        if cut and a < cut[-1][1]:
            cut[-1] = cut[-1][0], max(b, cut[-1][1])
        else:
            cut.append((a, b))
    return "\n".join(text[a:b] for a, b in cut)


def sample_texts(docs: DataFrame) -> list[str]:
    """About ``SAMPLE_DOCS`` texts, half of them with a pattern span if there are so many; drawn by a hash of id and text."""
    rows = pick(docs, "doc_id", "text").where("text is not null").select("text", F.col("text").rlike(_ANY).alias("hit"), "doc_id")
    counts = {r["hit"]: r["n"] for r in rows.groupBy("hit").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text", F.lit("secrets")), 11) / F.lit(float(1 << 53))
    shares = [min(1.0, SAMPLE_DOCS / 2 / max(1, counts.get(hit, 0))) for hit in (False, True)]
    rows = rows.select("hit", F.col("text").cast("binary").alias("text"), draw.alias("draw"))

    def bounded(rows: DataFrame) -> DataFrame:
        # Rows that repeat id and text are drawn together, so a bound holds as well: each task keeps no more than this.
        place = F.row_number().over(Window.partitionBy("hit").orderBy("draw", "text"))
        return rows.withColumn("place", place).where(F.col("place") <= SAMPLE_DOCS).select("text", "draw")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [excerpt(b.decode("utf-8", "replace")) for b in batch.column(0).to_pylist()]
            texts = [t.encode("utf-8", "replace") for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), batch.column(1)], names=["text", "draw"])

    sampled = lambda rows: bounded(rows).mapInArrow(work, "text binary, draw double").collect()
    found = sampled(rows.where(F.col("draw") < F.when(F.col("hit"), shares[1]).otherwise(shares[0])))
    if len(found) < min(SAMPLE_DOCS, sum(counts.values())) // 8:  # few different rows: take the first ones
        found = sampled(rows)
    return [bytes(r["text"]).decode() for r in sorted(found, key=lambda r: (r["draw"], bytes(r["text"])))]


def scan_secrets(docs: DataFrame, model: LinearChain | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans; trains on a sample of ``docs`` unless given a model."""
    model = train(sample_texts(docs)) if model is None else model
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    listed = lambda found: ",".join(f"{kind}:{a}:{b}" for a, kind, b in found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [(b or b"").decode("utf-8", "replace") for b in batch.column(1).to_pylist()]
            for begin, end in runs(texts, 2_000_000):
                found = secret_spans(texts[begin:end], model)
                base = [[s for s in spans if s[1] != "crf"] for spans in found]
                columns = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
                columns.append(pa.array([hashlib.sha256(listed(spans).encode()).hexdigest() for spans in base]))
                columns.append(pa.array([listed(spans) for spans in found], pa.string()))
                part = batch.column(0).slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([part, *columns], names=[c.split()[0] for c in schema.split(", ")])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(work, schema)
