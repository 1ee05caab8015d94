"""HyperMinHash near-dedup, LAESA clustering and the filter audit against plain versions."""

import hashlib
import math
import random
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import common
from ledgerlens.llm import hyperminhash as H
from ledgerlens.llm.clusters import choose_pivots, cluster_vectors, nearest, pivot_distances
from ledgerlens.llm.filter_audit import audit_documents, audit_masks, lehmer_rank, removal_intervals

from .conftest import texts_of


def shingle_set(text, words):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return frozenset()
    width = min(words, len(tokens))
    return frozenset(tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1))


def plain_near(rows, words, percent):
    sets = [shingle_set(t, words) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            group[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("table", ["awkward", "small_docs", "nothing"])
def test_near_duplicates(table, request):
    docs = request.getfixturevalue(table)
    got = Counter(tuple(r) for r in H.near_duplicates(docs, words=3, percent=85).collect())
    assert got == plain_near(texts_of(docs), 3, 85)


def chained(n, seed, words=120):
    """Copies of one text, each with some words changed, so that many are linked with some others only."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(draw.randrange(9)):
            text[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        rows.append((i if i % 7 else None, " ".join(text)))
    return rows


@pytest.mark.parametrize("block_rows", [1000, 16])
def test_a_large_group_of_near_copies_loses_no_link(spark, monkeypatch, block_rows):
    monkeypatch.setattr(H, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(H, "LEADER_ROUNDS", 1)
    rows = chained(220, 3) + chained(150, 4)
    rows = [(None if i is None else i + 1000 * (k >= 220), t) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in H.near_duplicates(docs, words=3, percent=85).collect())
    assert got == plain_near(rows, 3, 85)


def test_registers_keep_zeros_and_mantissa():
    values = [0, 1, 1 << 11, (1 << 64) - 1, 1 << 63, (1 << 62) | (1 << 61), 0x0000123456789ABC]
    got = H.compressed(np.array(values, np.uint64)).tolist()
    for v, r in zip(values, got):
        upper = v >> 11
        zeros = 53 - upper.bit_length()
        behind = ((upper << zeros) & ((1 << 52) - 1)) >> (52 - H.MANTISSA) if upper else 0
        assert r == (zeros << H.MANTISSA | behind)


def test_sketches_equal_the_least_hash_of_each_set(monkeypatch):
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 1 << 63, n, np.uint64)) for n in (1, 700, 3, 1, 90)]
    starts = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    change, factor = H._functions(H.BUCKETS)
    for held in (1 << 15, 64, 1):
        monkeypatch.setattr(H, "HASHED", held)
        got = H.sketches(np.concatenate(sets), starts)
        for row, s in zip(got, sets):
            least = ((s[:, None] ^ change) * factor).min(axis=0)
            assert (row == H.compressed(least)).all()


def test_estimates_are_near_and_corrected():
    draw = np.random.default_rng(7)
    for n, shared in ((2000, 1800), (60, 55), (500, 0)):
        pool = draw.integers(0, 1 << 63, 2 * n, np.uint64) * np.uint64(2)
        one, two = pool[:n], pool[n - shared : 2 * n - shared]
        a, b = (H.sketches(np.unique(s), np.array([0])) for s in (one, two))
        found = H.estimate((a == b).sum(axis=1), np.array([n]), np.array([n]))[0]
        assert abs(found - shared / (2 * n - shared)) < 0.13
    # Chance agreement against counting: the least of n and of m hashes in the same cell.
    least = lambda n: draw.random((200_000, n)).min(axis=1)
    for n, m in ((1, 1), (5, 8)):
        a, b = ((least(k) * 2.0**64).astype(np.uint64) for k in (n, m))
        assert H.chance_equal(n, m) == pytest.approx((H.compressed(a) == H.compressed(b)).mean(), rel=0.35)


def test_text_filter_lets_wanted_rows_through(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(None, "text of none"), (3, "text 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = H.row_key(F.col("doc_id"), F.col("text"))
    wanted = docs.where("doc_id % 50 = 3 or doc_id is null").select(F.encode("text", "UTF-8").alias("entry"), key.alias("row_key")).distinct()
    got = H.texts_of_entries(docs, wanted).collect()
    assert len(got) == 11 and all(r["entry"] == r["text"] for r in got)


def plain_clusters(rows, n_clusters, dims, scale, rounds, seed):
    kept = [
        (i, [math.floor(scale * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in starts[:n_clusters]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((distance(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, v in kept:
            held[place(v)[1]].append(v)
        centroids = [[sum(x) // len(h) for x in zip(*h)] if h else c for h, c in zip(held, centroids)]
    placed = [(i, *place(v)[::-1]) for i, v in kept] if centroids else []
    inertia = Counter()
    for _, k, d in placed:
        inertia[k] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), name[k]) for i, k, d in placed)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("EMBEDDING"), F.lit(2).alias("cluster"))


def test_clusters_of_the_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = Counter(tuple(r) for r in cluster_vectors(df).drop("centroid").collect())
    assert got == plain_clusters(rows, 40, 64, 256, 5, 2)


def test_clusters_of_awkward_vectors(spark):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.5, 0.0, 0.25, 3.0]) for _ in range(4)]) for i in range(60)]
    rows += [(70, None), (71, [1.0]), (72, [1.0, None, 1.0, 1.0]), (73, [1.0, float("nan"), 1.0, 1.0]), (74, [1.0, float("inf"), 0.0, 0.0])]
    rows += [(75, []), (None, [0.5, 0.5, 0.5, 0.5]), (3, [9.0, 9.0, 9.0, 9.0]), (3, rows[3][1]), (76, [1000.0, -1000.0, 0.0, 0.0])]
    got = Counter(tuple(r) for r in cluster_vectors(vectors(spark, rows), 7, 4, 256, 5, 2).drop("centroid").collect())
    assert got == plain_clusters(rows, 7, 4, 256, 5, 2)
    assert cluster_vectors(vectors(spark, rows[60:65]), 7, 4).collect() == []
    few = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0])]
    assert {r["cluster"] for r in cluster_vectors(vectors(spark, few), 7, 4).collect()} == {0}


def test_pivots_never_lose_the_nearest_centroid():
    draw = np.random.default_rng(3)
    for spread in (3, 1000, 10**6):
        vs, cs = draw.integers(-spread, spread, (400, 8)), draw.integers(-spread, spread, (25, 8))
        cs[7] = cs[3]
        pivots = choose_pivots(cs, 5)
        table = pivot_distances(vs, pivots).astype(np.float32).astype(np.float64)
        cluster, distance = nearest(vs, table, cs, pivots)
        exact = ((vs[:, None] - cs[None]) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_lehmer_ranks_and_intervals():
    orders = list(permutations(range(4)))
    assert [lehmer_rank(o, 4) for o in orders] == list(range(24))
    expected = Counter()
    for mask in range(1, 16):
        for rank, order in enumerate(orders):
            expected[mask, next(k for k, f in enumerate(order) if mask >> f & 1) + 1, rank] += 1
    got = Counter((m, s, r) for m, s, a, b in removal_intervals(4) for r in range(a, b))
    assert got == expected


def plain_audit(rows, labels):
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = []
    for i, t, part in rows:
        t = t or ""
        words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", t) if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and i > ids[t]}
        docs.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, lines, removed = [d for d in docs if d[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed[f] += len(gone)
                failing = sum(f in d[1] for d in mine)
                lines.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine),
                              sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        out += [(*line[:-1], removed[line[-1]]) for line in lines]
    return Counter(out)


@pytest.mark.parametrize("table", ["awkward", "small_docs", "nothing"])
def test_filter_audit(spark, table, request):
    docs = request.getfixturevalue(table)
    if table == "small_docs":
        labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    else:
        said = [(2, 1, None), (4, 0, 1), (5, 1, 1), (5, None, 0), (None, 1, 1), (7, 1, 0), (99, 1, 1)]
        labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int").select("*", F.lit(0).alias("QUALITY"))
    by_place = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = [docs.columns.index(c) for c in ("doc_id", "text", "source")]
    rows = [tuple(r[i] for i in at) for r in by_place.collect()]
    said = [tuple(r)[:3] for r in labels.collect()]
    got = Counter(tuple(r)[:10] for r in audit_documents(docs, labels).collect())
    assert got == plain_audit(rows, said)


def test_audit_of_other_filters(spark):
    counts = spark.createDataFrame([("x", 0, 5, 1, 0), ("x", 3, 4, 1, 2), ("x", 4, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"]) for r in audit_masks(counts, "FGH").collect()}
    assert len(got) == 18 and got["GFH", 1] == (6, 4, 0, 0) and got["GFH", 2] == (6, 0, 4, 0) and got["GFH", 3] == (5, 1, 0, 1)
    with pytest.raises(ValueError):
        audit_masks(counts, "BA")


def test_a_worker_holds_the_table_of_one_operator(spark):
    """One worker runs several operators in turn; the fingerprints drop what the others left."""

    def work(batches):
        list(batches)
        built = []
        for key in ("parser", "parser", "bpe", "parser"):
            assert common.worker_table(key, lambda: built.append(key) or [key]) == [key]
            assert list(common._worker_tables()) == [key]
        common.drop_worker_tables()
        yield pa.RecordBatch.from_arrays([pa.array(built), pa.array([len(common._worker_tables())] * 3)], names=["built", "left"])

    got = spark.range(1).repartition(1).mapInArrow(work, "built string, left long").collect()
    assert [tuple(r) for r in got] == [("parser", 0), ("bpe", 0), ("parser", 0)]


def test_batches_to_workers_are_bounded_by_bytes(spark):
    """Also where 10,000 rows are far more; all rows come, and a bound that the session has stays."""

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    setting, before = common._BATCH_SETTING, spark.conf.get(common._BATCH_SETTING, None)
    rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("some words "), 500).alias("text"))
    try:
        spark.conf.unset(setting)
        got = common.map_batches(rows, work, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 1.1 * common.BATCH_BYTES
        spark.conf.set(setting, "1m")
        got = common.map_batches(rows, work, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 1.1 * 2**20
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
