"""Exact deduplication by a minimal perfect hash over historical digests.

The history is a set of documents that were taken in before.  Its distinct
digests (SHA-256 of the normalised text) are dealt to buckets of bounded size,
and each bucket gets a minimal perfect hash: every digest hashes to a slot of
its own, ``n`` digests to the slots ``0 .. n-1``.  A slot holds the full digest
and the locator of the document that wins its group.  A perfect hash sends
digests it has never seen to some slot as well, so a lookup compares all 32
bytes; what differs is not a member.  Members are repeats of the history;
nonmembers are grouped among themselves by their digest.

Scale: only (id, digest) rows are shuffled, never texts.  Group sizes come from
partial aggregation.  Lookups meet a bucket in chunks of bounded size, to each
of which the bucket's index is copied, so a digest that a third of all rows
share is looked up by many tasks.

Defined results: a null text counts as empty; empty texts form a group; rows
that repeat both id and text are one document and get the same verdict each; a
null id never wins against another id, and a group of null ids only has a null
``keep_id`` and is kept; empty tables give empty results; other columns are
not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, pick, row_key
from ledgerlens.session import materialize

#: Digests per bucket and lookups per chunk: bounds what a task holds (about 50 bytes each).
BUCKET_ROWS = 200_000
#: Slots tried per key that is still unplaced, per level of the hash.
GAMMA = 2.0

_INDEX = "bucket int, level_sizes array<long>, level_bits binary, digests binary, winners array<long>, sizes array<long>"
_FOUND = "doc_id long, digest binary, member boolean, winner long, group_size long"


def digests(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id and the SHA-256 of the text with A-Z lower-cased, as ``digest`` (32 bytes); if ``keyed``, the row key as well."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    more = [row_key(F.col("doc_id"), F.col("text")).alias("row_key")] if keyed else []
    return pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *more
    )


def _words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(keys).view("<u8").reshape(len(keys), 4)
    return words[:, 0], words[:, 1] | np.uint64(1)


def _level_position(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall at a level; digests are uniform bits already, so a multiply and a shift mix them enough."""
    with np.errstate(over="ignore"):
        x = a + b * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(20)) % np.uint64(size)


def build_perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits (bool) of a minimal perfect hash for distinct rows of 32 bytes.

    A level takes the keys that fall alone on a position; the others go on to
    the next level.  A key's slot is the number of set bits before its own.
    """
    a, b = _words(keys)
    left, sizes, bits = np.arange(len(keys)), [], []
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _level_position(a[left], b[left], len(sizes), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for keys that no level takes (surely no members)."""
    a, b = _words(keys)
    rank = np.cumsum(bits) - 1
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _level_position(a[left], b[left], level, size).astype(np.int64)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(pdf["digest"])
    sizes, bits = build_perfect_hash(keys)
    order = np.empty(len(keys), np.int64)
    order[slots(keys, sizes, bits)] = np.arange(len(keys))
    row = {
        "bucket": int(pdf["bucket"].iloc[0]), "level_sizes": sizes, "level_bits": np.packbits(bits).tobytes(),
        "digests": keys[order].tobytes(), "winners": pdf["winner"].to_numpy()[order].tolist(),
        "sizes": pdf["group_size"].to_numpy()[order].tolist(),
    }
    row["winners"] = [None if w is None or w != w else int(w) for w in row["winners"]]
    return pd.DataFrame([row])


def _look_up(docs: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = docs[["doc_id", "digest"]].copy()
    out["member"], out["winner"], out["group_size"] = False, None, None
    if not len(index) or not len(docs):
        return out
    x = index.iloc[0]
    sizes = [int(n) for n in x["level_sizes"]]
    bits = np.unpackbits(np.frombuffer(x["level_bits"], np.uint8))[: sum(sizes)].astype(bool)
    held, keys = np.frombuffer(x["digests"], np.uint8).reshape(-1, 32), _keys(docs["digest"])
    slot = slots(keys, sizes, bits)
    member = (slot >= 0) & (held[slot] == keys).all(axis=1)
    out["member"] = member
    out["winner"] = pd.array(np.array(x["winners"], object)[slot], "Int64")
    out["group_size"] = pd.array(np.array(x["sizes"])[slot], "Int64")
    out.loc[~member, ["winner", "group_size"]] = None
    return out


def _bucket(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("bucket")


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """One row per bucket: the perfect hash and its slots over the distinct digests of ``history``.

    ``history`` has doc_id and digest; the largest id of a digest wins.
    """
    distinct = history.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("group_size"))
    return distinct.select("*", _bucket(n_buckets)).groupBy("bucket").applyInPandas(_build, _INDEX)


def look_up(docs: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """doc_id, digest, member, and for members the winner and group size of the history."""
    # Dealt by place in the written table, since ids may be null or repeat.
    placed = docs.select("doc_id", "digest", _bucket(n_buckets), F.monotonically_increasing_id().alias("_place"))
    # One row per bucket: how many chunks of bounded size its lookups make.
    chunks = placed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("_chunks"))
    chunk = F.pmod(F.xxhash64("_place"), F.col("_chunks")).cast("int")
    dealt = placed.join(chunks, "bucket").select("doc_id", "digest", "bucket", chunk.alias("chunk"))
    copies = index.join(chunks, "bucket").select(
        *index.columns, F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk")
    )
    return (
        dealt.groupBy("bucket", "chunk").cogroup(copies.groupBy("bucket", "chunk")).applyInPandas(_look_up, _FOUND)
    )


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    Without ``history`` the table is its own history: every document is looked
    up among the distinct digests of the whole table, and the largest id of a
    digest wins.  With a history of earlier documents, a repeat of one of them
    is dropped and points to the winner in the history; what the history does
    not hold is grouped by itself.  ``group_size`` counts rows of the history
    for members and rows of ``docs`` for the others.
    """
    new = materialize(digests(docs), "digests")
    old = new if history is None else materialize(digests(history), "history-digests")
    n_buckets = -(-max(1, old.count()) // BUCKET_ROWS)
    index = materialize(build_index(old, n_buckets), "digest-index")
    found = materialize(look_up(new, index, n_buckets), "digest-lookups")
    members, others = found.where("member"), found.where("not member").select("doc_id", "digest")
    apart = others.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("group_size"))
    every = members.unionByName(others.join(apart, "digest").withColumn("member", F.lit(False)))
    stays = F.col("winner").eqNullSafe(F.col("doc_id"))
    if history is not None:
        stays = stays & ~F.col("member")
    return every.select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        "group_size",
        stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )
