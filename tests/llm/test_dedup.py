"""Exact dedup, suffix dedup and SimHash against plain versions."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import exact_dedup as exact_dedup_module
from ledgerlens.llm import induced
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.exact_dedup import build_index, build_perfect_hash, digests, exact_dedup, look_up, slots
from ledgerlens.llm.induced import Scratch, suffixes
from ledgerlens.llm import simhash
from ledgerlens.llm.simhash import GrayIndex, bit_orders, fingerprint, links_within, simhash_groups
from ledgerlens.llm.suffix_dedup import Cutter, remove_repeats

from .conftest import texts_of

ASCII = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_groups(rows):
    out = defaultdict(list)
    for i, t in rows:
        out[(t or "").translate(ASCII)].append(i)
    return out


def test_perfect_hash_is_minimal():
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    sizes, bits = build_perfect_hash(keys)
    assert sorted(slots(keys, sizes, bits).tolist()) == list(range(5000))


@pytest.mark.parametrize("table", ["awkward", "small_docs", "nothing"])
def test_exact_dedup(table, request):
    docs = request.getfixturevalue(table)
    rows = texts_of(docs)
    groups = plain_groups(rows)
    expected = []
    for i, t in rows:
        low = (t or "").translate(ASCII)
        keep = max((x for x in groups[low] if x is not None), default=None)
        expected.append((i, keep, len(groups[low]), i == keep, hashlib.sha256(low.encode()).hexdigest()))
    got = [tuple(r)[:5] for r in exact_dedup(docs).collect()]
    assert Counter(got) == Counter(expected)


def test_hot_digests_without_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup_module, "BUCKET_ROWS", 50)
    rows = [(None, "same")] * 400 + [(3, "Same")] * 400 + [(None, f"t{k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect())
    assert got == {(None, 3, 800, False): 400, (3, 3, 800, True): 400, (None, None, 1, True): 200}
    new = digests(docs)
    seen = []
    monkeypatch.setattr(exact_dedup_module, "_look_up", lambda docs, index: docs[["doc_id", "digest"]].assign(member=True, winner=len(docs), group_size=0))
    found = look_up(new, build_index(new, 4), 4)
    assert found.agg({"winner": "max"}).collect()[0][0] < 300  # of 800 lookups of one digest, in 17 chunks


def test_history_removes_repeats_and_groups_the_rest(spark):
    old = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(10, "a"), (11, "c"), (12, "C"), (13, "d"), (14, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:4] + (r["in_history"],) for r in exact_dedup(new, old).collect()}
    assert got == {
        10: (2, 2, False, True),
        11: (12, 2, False, False),
        12: (12, 2, True, False),
        13: (13, 1, True, False),
        14: (14, 1, True, False),
    }


def sorted_plainly(text, depth):
    n = len(text)
    order = sorted(range(n), key=lambda i: text[i:], reverse=True)
    common = [0] * n
    for k in range(1, n):
        a, b = text[order[k - 1] :], text[order[k] :]
        while common[k] < min(len(a), len(b), depth) and a[common[k]] == b[common[k]]:
            common[k] += 1
    return order, common


@pytest.mark.parametrize("budget", [0, 300, 1 << 20])
def test_induced_order_and_common_prefixes(budget, monkeypatch):
    monkeypatch.setattr(induced, "BLOCK", 7)
    rnd = random.Random(budget)
    for _ in range(150):
        text = bytes(rnd.choice(rnd.choice([b"a", b"ab", b"abc", bytes(range(256))])) for _ in range(rnd.randrange(1, 90)))
        text += text[3:40] + b"a" * rnd.randrange(9)
        depth = rnd.choice([1, 3, 8, 200])
        scratch = Scratch(budget)
        at, lcp = (np.concatenate(c).tolist() for c in zip(*suffixes(np.frombuffer(text, np.uint8), depth, scratch)))
        scratch.close()
        assert sorted(at) == list(range(len(text)))
        starts = [text[i : i + depth] for i in at]
        assert starts == sorted(starts, reverse=True)
        if depth == 200:
            assert (at, lcp) == sorted_plainly(text, depth)


def test_equal_strings_have_equal_anchors():
    rnd = random.Random(4)
    common = bytes(rnd.choice(b"abcdef ") for _ in range(150))
    one = bytes(rnd.choice(b"abc ") for _ in range(333)) + common + b"xyz" * 40
    two = b"qq" + common
    anchors = []
    for texts, base in (([one], 333), ([b"z" * 500, two, b"y"], 2)):
        owner, start, strings, anchor, _ = Cutter(100).pieces(texts)
        which = 0 if len(texts) == 1 else 1
        by_place = {s + k: a for o, s, n, a in zip(owner, start, strings, anchor) if o == which for k in range(n)}
        anchors.append([by_place[base + k] for k in range(51)])
        assert len(by_place) == len(texts[which]) - 99
    assert anchors[0] == anchors[1]


def removed_plainly(rows, depth):
    """Rows in order of id; the strings seen so far tell what repeats."""
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - depth + 1):
            first = seen.setdefault(data[k : k + depth], (i, k))
            if first != (i, k):
                gone[k : k + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("table", ["awkward", "small_docs", "nothing"])
def test_remove_repeats(table, request):
    docs = request.getfixturevalue(table)
    got = Counter(tuple(r) for r in remove_repeats(docs, 100).collect())
    assert got == Counter(removed_plainly(texts_of(docs), 100))


def test_remove_repeats_on_disk_and_with_hot_anchors(spark, monkeypatch):
    """A budget of nothing sends texts, queues and results to disk; hot passages, overlaps and long runs."""
    from ledgerlens.llm import suffix_dedup

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    hot = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(30))) + hot + word() * 2) for i in range(60)]
    rows += [(100, "a" * 700), (101, "b" + "a" * 350), (102, ("xyz" * 90) + hot[:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = Counter(removed_plainly(rows, 100))
    original = suffix_dedup._sort_shard
    monkeypatch.setattr(suffix_dedup, "_sort_shard", lambda depth, budget: original(depth, 0))
    assert Counter(tuple(r) for r in remove_repeats(docs, 100).collect()) == expected
    # The same with anchors that count as hot from three pieces on.
    hot_from = suffix_dedup.removed_spans
    monkeypatch.setattr(suffix_dedup, "removed_spans", lambda docs, depth: hot_from(docs, depth, hot_pieces=2))
    assert Counter(tuple(r) for r in remove_repeats(docs, 100).collect()) == expected


def test_kept_text(spark):
    text = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "AB" + text + "CD")], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(docs, 100, with_text=True).collect()}
    assert got == {1: text.encode(), 2: b"ABCD"}


def plain_fingerprint(text, words):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    shingles = [" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, distance):
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


@pytest.mark.parametrize("table", ["awkward", "small_docs", "nothing"])
def test_simhash_groups(table, request):
    docs = request.getfixturevalue(table)
    rows = texts_of(docs)
    codes = [plain_fingerprint(t, 4) for _, t in rows]
    roots = plain_components(codes, 4)
    smallest = {}
    for (i, _), r in zip(rows, roots):
        smallest[r] = min((x for x in (smallest.get(r), i) if x is not None), default=None)
    expected = Counter((i, "%016x" % c, smallest[r]) for (i, _), c, r in zip(rows, codes, roots))
    assert Counter(tuple(x) for x in simhash_groups(docs).collect()) == expected


def test_fingerprint_of_wordless_text_is_zero():
    assert fingerprint(b"") == fingerprint(b" \n\t") == bytes(8)


def test_gray_index_finds_all_near_codes():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rnd.choice(64, k, replace=False))) for b in base for k in range(1, 8)]
    codes = np.unique(np.append(base, near))
    index = GrayIndex(codes)
    query, node = index.within(base, 4)
    got = {(int(base[q]), int(index.codes[n])) for q, n in zip(query, node)}
    assert got == {(int(b), int(c)) for b in base for c in codes if (int(b) ^ int(c)).bit_count() <= 4}


def test_near_codes_agree_on_top_of_some_order():
    rnd = np.random.default_rng(3)
    for distance, rows in [(0, 10), (1, 10), (4, 10), (4, 1 << 40), (7, 1 << 30), (30, 10)]:
        orders = bit_orders(distance, rows)
        codes = rnd.integers(0, 1 << 64, 200, dtype=np.uint64)
        flips = [sum(1 << int(x) for x in rnd.choice(64, distance, replace=False)) for _ in codes]
        near = codes ^ np.array(flips, np.uint64)
        found = np.zeros(len(codes), bool)
        for order in orders:
            assert (order.restored(order.moved(codes)) == codes).all()
            found |= (order.moved(codes) ^ order.moved(near)) & np.uint64(order.top_bits) == 0
        assert found.all()
    assert len(bit_orders(4, 1 << 20)) == 5 and len(bit_orders(4, 1 << 33)) == 15


@pytest.mark.parametrize("distance, block_rows, widest", [(4, 1 << 18, 1 << 20), (4, 40, 200), (1, 100, 500), (0, 100, 500), (18, 300, 1000)])
def test_links_within_over_many_blocks(spark, monkeypatch, distance, block_rows, widest):
    """Clusters, and a hot group that shares most segments, over blocks that one key fills many times."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(simhash, "WIDEST", widest)
    rnd = np.random.default_rng(7)
    base = rnd.integers(0, 1 << 64, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rnd.choice(64, k, replace=False))) for b in base for k in (1, 3, 4, 5, 6)]
    hot = base[0] ^ (rnd.integers(0, 1 << 14, 500, dtype=np.uint64) << np.uint64(rnd.integers(0, 50)))
    codes = np.unique(np.concatenate([base, near, hot, np.array([0, 1, 1 << 63], np.uint64)]))
    distinct = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fingerprint long")
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links_within(distinct, distance).collect()]
    place = {int(c): i for i, c in enumerate(codes)}
    parent = list(range(len(codes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        a, b = root(place[a]), root(place[b])
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(codes))] == plain_components([int(c) for c in codes], distance)


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(2).shuffle(links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200, 202: 200}
    assert got == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_one_id_with_equal_marks_keep_their_own_bytes(spark):
    """Texts whose 24-bit marks agree, under one id and under none, of which one only holds a repeat."""
    draw = random.Random(11)
    passage = "".join(draw.choice(string.ascii_lowercase) for _ in range(130))
    mark = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFF
    plain, found, k = {}, [], 0
    for k in range(14_000):
        text = f"{k} " + "".join(draw.choice(string.ascii_lowercase) for _ in range(160))
        plain[mark(text)] = text
    while len(found) < 8:
        k += 1
        text = f"{passage} {k} tail"
        if mark(text) in plain:
            found.append((text, plain[mark(text)]))
    rows = [(-5, passage)]
    for i, (a, b) in enumerate(found):
        rows += [(None if i % 2 else 7, t) for t in (a, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], bytes(r["kept"]).decode()): r["n_removed"] for r in remove_repeats(docs, 100, with_text=True).collect()}
    assert len(got) == len(rows)
    for i, (_, b) in enumerate(found):
        assert got[None if i % 2 else 7, b] == 0
    # The null ids come first, so of all nine rows with the passage one of theirs keeps it.
    removed = sorted(n for n in got.values() if n)
    assert len(removed) == 8 and removed[0] >= 130 and got[-5, ""] == 130
