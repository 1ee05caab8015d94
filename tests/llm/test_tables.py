"""Decontamination, sharding, the pipeline and the registered queries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from ledgerlens.llm.byte_bpe import ByteBpe
from ledgerlens.llm.decontaminate import contamination, matches
from ledgerlens.llm.queries import LLM_QUERIES, tokenizer
from ledgerlens.llm.sharding import kd_shards

from .conftest import PASSAGE, texts_of
from .test_dedup import ASCII, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def plain_contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        for k in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[k : k + 10])].add(item)
    out = []
    for i, text in rows:
        words, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(words[k : k + n])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        n_items = len([x for x in found if x is not None])
        out.append((i, len(words), len(hit), n_items, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, PASSAGE), (2, "Hello, world!"), (3, None), (4, "---"), (2, "jumps over the lazy dog while seven wizards box a"), (None, "so on w5 and"), (10, PASSAGE)]


@pytest.mark.parametrize("table", ["awkward", "nothing"])
def test_contamination(table, request, spark):
    docs = request.getfixturevalue(table)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter(tuple(r) for r in contamination(docs, items).collect())
    assert got == Counter(plain_contamination(texts_of(docs), ITEMS))


def test_rows_of_one_id_share_no_candidates(spark):
    items = [(1, PASSAGE), (2, "so on we go")]
    rows = [(i, f"{PASSAGE} number {k % 40}") for k in range(300) for i in (None, 7)]
    rows += [(i, f"clean text {k} so on") for k in range(300) for i in (None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == Counter(plain_contamination(rows, items))
    assert sum(n for r, n in got.items() if r[5]) == 600
    found = matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(r["doc_id"] for r in found.collect()) == {None: 300 * 12, 7: 300 * 12}


def test_empty_benchmark(spark, awkward):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in contamination(awkward, items).collect()} == {False}


def test_proximity_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    docs = [(1, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y"), (2, "alpha beta XX gamma delta epsilon zeta eta theta iota kappa"), (3, "alpha " * 30)]
    docs = spark.createDataFrame([*docs, (4, "common words only")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["kind"]) for r in matches(docs, items, slack=2).collect())
    assert got[(1, "phrase")] == 1 and got[(2, "phrase")] == 0
    assert (2, "near") in got and not any(d == 4 for d, _ in got)


def test_decontamination_runs_no_python(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("table", ["awkward", "small_docs"])
def test_kd_shards(table, request):
    docs = request.getfixturevalue(table)
    rows = kd_shards(docs, n_shards=4).collect()
    size = lambda t: len((t or "").encode()) + 8
    expected = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in texts_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if table == "small_docs":
        weights = Counter()
        for r in rows:
            weights[r["shard"]] += r["size"]
        mean, largest = sum(weights.values()) / 4, max(r["size"] for r in rows)
        assert len(weights) == 4 and all(abs(w - mean) <= max(0.1 * mean, largest) for w in weights.values())


def test_kd_shards_by_target_and_with_a_hot_group(spark, nothing):
    """A third of the rows are one text, from one source: shards stay near equal, other copies together."""
    rows = [(i, "hot " * 50 if i % 3 == 0 else f"text {i // 4} " * 20, "en", "src0" if i % 2 else "src1") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = kd_shards(docs, target_bytes=40_000).collect()
    weights, places = Counter(), defaultdict(set)
    for r in got:
        weights[r["shard"]] += r["size"]
        places[r["text_crc32"]].add(r["shard"])
    mean = sum(weights.values()) / len(weights)
    assert len(weights) == -(-sum(weights.values()) // 40_000)
    assert max(weights.values()) < 1.15 * mean and min(weights.values()) > 0.85 * mean
    hot = zlib.crc32(("hot " * 50).encode())
    assert all(len(s) == 1 for c, s in places.items() if c != hot)
    assert kd_shards(nothing, n_shards=4).count() == 0


def test_registered_queries():
    assert {n.split("_")[0] for n in LLM_QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(LLM_QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "byte-level BPE" and len(corpus_pipeline.STAGES) == 5


def plain_pipeline(rows, items):
    """Ids that each stage keeps, in the order of the stages."""
    with_letter = {i: t for i, t in rows if any(c.isalpha() for c in t or "")}
    by_text = {}
    for i, t in sorted(with_letter.items()):
        by_text[t.translate(ASCII)] = i
    kept = {i: with_letter[i] for i in by_text.values()}
    ids = sorted(kept)
    roots = plain_components([plain_fingerprint(kept[i], 4) for i in ids], 4)
    kept = {ids[r]: kept[ids[r]] for r in set(roots)}
    dirty = {r[0] for r in plain_contamination(list(kept.items()), items) if r[5]}
    return {i: t for i, t in kept.items() if i not in dirty}


def test_pipeline(spark):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = plain_pipeline(docs, items)
    assert set(got) == set(expected)
    bpe = ByteBpe(open(tokenizer("byte_bpe_multi_50k.tiktoken"), "rb").read())
    ids = sorted(expected)
    assert [bytes(got[i]["ids"]) for i in ids] == bpe.encode([expected[i] for i in ids])


def test_pipeline_stages_on_awkward_rows(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == awkward.columns, name
    assert {r[0] for r in docs.collect()} >= {6, 9, 11}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_pipeline_decides_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first()["text"]
    pad = lambda word: " ".join(f"{word}{k}" for k in range(60))
    near = pad("near")
    rows = [
        (None, pad("clean")),
        (None, f"{pad('dirty')} {item}"),
        (None, f"{item} {pad('other')}"),
        (None, pad("copy").upper()),  # a copy but for its case of a document with an id
        (1, pad("copy")),
        (None, near + "\n"),  # near copies of a document with an id
        (None, near + " "),
        (2, near),
        (None, pad("group")),  # a group of null ids only
        (None, pad("group") + " "),
        (None, pad("Case")),
        (None, pad("case")),
        (3, pad("mine")),  # an id with several texts
        (3, f"{pad('yours')} {item}"),
    ]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    left = sorted((i or 0, t.strip().lower()) for i, t in texts_of(docs))
    assert left == [(0, pad("case")), (0, pad("clean")), (0, pad("group")), (1, pad("copy")), (2, near), (3, pad("mine"))]


def test_pipeline_on_an_empty_table(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
