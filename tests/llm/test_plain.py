"""Licence recognition and the k-d tree against plain versions."""

import random
import re
from collections import Counter

import pytest

from ledgerlens.llm.licenses import RULES, SENTENCES, Recogniser, scan_licenses
from ledgerlens.llm.sharding import DIMENSIONS, TOLERANCE, kd_tree

from .conftest import texts_of
from .test_dedup import ASCII


def plain_units(text):
    """(start, end, words) of the parts between line ends and sentence marks, letter by letter."""
    cuts = [0]
    for k, c in enumerate(text):
        behind = text[k + 1 : k + 2]
        if c == "\n" or c in ".!?;" and (not behind or behind.isspace() or behind in "\"')]"):
            cuts.append(k + 1)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        words = list(re.finditer("[a-z0-9]+(?:[.+-][a-z0-9]+)*", text[a:b].translate(ASCII)))
        if words:
            out.append((a + words[0].start(), a + words[-1].end(), [w[0] for w in words]))
    return out


def plain_scan(text, sentences, rules):
    """Every row of units is compared with every sentence; then every rule at every place."""
    known = {name: [w for u in plain_units(s) for w in u[2]] for name, s in sentences.items()}
    longest = max(map(len, known.values()))
    units, found, i = plain_units(text or ""), [], 0
    while i < len(units):
        best, words = None, []
        for j in range(i, len(units)):
            words = words + units[j][2]
            if len(words) > longest:
                break
            for name, wanted in known.items():
                if words == wanted:
                    best = j, name
        if best:
            found.append((units[i][0], units[best[0]][1], best[1]))
            i = best[0]
        i += 1
    names, spans, loose, at = [f[2] for f in found], [], [], 0
    while at < len(names):
        fits = [r for r in rules if names[at : at + len(r[1])] == list(r[1])]
        if fits:
            spans.append((fits[0][0], found[at][0], found[at + len(fits[0][1]) - 1][1]))
            at += len(fits[0][1])
        else:
            loose.append(names[at])
            at += 1
    return len(found), ",".join(sorted({s[0] for s in spans})), ",".join("%s:%d:%d" % s for s in spans), ",".join(loose)


def noticed(draw, sequences):
    """A text of notices, whole, cut short or with other words between, wrapped at any place and in any case."""
    out = []
    for _ in range(draw.randrange(1, 5)):
        kind = draw.random()
        sentences = [SENTENCES[s] for s in draw.choice(sequences)]
        if kind < 0.2:
            sentences = sentences[:-1]
        elif kind < 0.3:
            sentences.insert(draw.randrange(len(sentences) + 1), "Copyright (c) 2019 Some Body;")
        elif kind < 0.4:
            sentences[0] = sentences[0].replace(" the ", " a ")
        out += [s.upper() if draw.random() < 0.2 else s for s in sentences]
        out.append(draw.choice(["", "Nothing known here.", "some code = 1; // v. 2.0", "it's (so) said!"]))
    text = draw.choice([" ", "\n"]).join(out)
    return "".join(draw.choice(["\n", "\n  ", "  ", " "]) if c == " " and draw.random() < 0.1 else c for c in text)


def test_licences_against_a_plain_matcher(spark):
    draw = random.Random(4)
    sequences = [r[1] for r in RULES]
    rows = [(draw.choice([None, k // 3]), noticed(draw, sequences)) for k in range(150)]
    rows += rows[:20]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_sentences"], r["licenses"], r["spans"], r["unmatched"]) for r in scan_licenses(docs).collect())
    expected = Counter((i, *plain_scan(t, SENTENCES, RULES)) for i, t in rows)
    assert got == expected
    many = Counter(len(x[3].split(",")) for x in expected.elements() if x[3])
    assert sum(many.values()) > 80 and max(many) > 1  # notices of several sentences are among them


@pytest.mark.parametrize("table", ["awkward", "nothing"])
def test_licences_on_awkward_rows(table, request):
    docs = request.getfixturevalue(table)
    got = Counter((r["doc_id"], r["n_sentences"], r["licenses"], r["spans"], r["unmatched"]) for r in scan_licenses(docs).collect())
    assert got == Counter((i, *plain_scan(t, SENTENCES, RULES)) for i, t in texts_of(docs))


def test_licence_at_the_end_of_a_very_long_text():
    text = "a line of code without an end\n" * 100_000 + "\n".join(SENTENCES[s] for s in RULES[0][1])
    recogniser = Recogniser()
    found, loose = recogniser.licenses(recogniser.sentences(text))
    assert [f[0] for f in found] == ["MIT"] and found[0][1] == 3_000_000 and not loose


@pytest.mark.parametrize("leaves", [1, 2, 7, 24])
def test_kd_tree_against_plain_medians(spark, leaves):
    """Every split is along the widest dimension, and no other cut comes nearer to the wanted bytes by more than the tolerance."""
    draw = random.Random(leaves)
    code = lambda x: (x << 31) | draw.getrandbits(31)
    units = [
        {
            "bytes": draw.randrange(1, 400) ** 2 // 100 + 8,
            "lang": code(draw.choice([5, 5, 5, 900, 2_000_000_000])),
            "source": code(draw.getrandbits(3) << 27),
            "length": code(int(draw.gauss(1e9, 1e8))),
            "place": code(k * 1_000_000),
        }
        for k in range(2000)
    ]
    points = spark.createDataFrame([tuple(u.values()) for u in units], "bytes long, lang long, source long, length long, place long")
    tree, number = kd_tree(points, leaves)
    assert sorted(number.values()) == list(range(leaves)) and not set(tree) & set(number)
    extent = lambda some, c: max(u[c] for u in some) - min(u[c] for u in some)
    whole = {c: max(1, extent(units, c)) for c in DIMENSIONS}
    close = TOLERANCE * sum(u["bytes"] for u in units) / leaves

    def walk(node, some, k):
        if k == 1:
            assert node in number
            return
        dimension, cut = tree[node]
        assert dimension == max(DIMENSIONS, key=lambda c: extent(some, c) / whole[c])
        goal = sum(u["bytes"] for u in some) * (k // 2) / k
        off, best, below = abs(sum(u["bytes"] for u in some if u[dimension] < cut) - goal), goal, 0
        for u in sorted(some, key=lambda u: u[dimension]):  # no two tie
            below += u["bytes"]
            best = min(best, abs(below - goal))
        assert off <= max(best, close) + 1e-6
        walk(2 * node, [u for u in some if u[dimension] < cut], k // 2)
        walk(2 * node + 1, [u for u in some if u[dimension] >= cut], k - k // 2)

    walk(1, units, leaves)
