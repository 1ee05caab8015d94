"""How filters of a corpus act on each other, over every order in which they may run.

A document is reduced to its mask, the set of filters it fails.  In an order it
is removed by the first filter of its mask, so all orders that begin with the
same filters that it passes, followed by the same filter that it fails, remove
it at the same step.  Orders are numbered by their Lehmer rank (the place among
all permutations in lexicographic order), where those with a common beginning
are one interval of ranks.  For every mask these intervals are known from the
number of filters alone.  The counts of a mask are added at the rank where an
interval begins and subtracted at the rank behind it; a prefix sum over the
ranks then gives what each step of each order removes.

Scale: texts are read once and never shuffled.  Rows of (id, part, mask) and
text hashes are, 50 bytes a document; counts per (part, mask) are partially
aggregated, so a part with a third of all rows costs a few rows per task.  What
follows is 2^n masks and n! ranks a part, whatever the size of the table (n
filters; the intervals, at most 2^n * n! * e, are the only broadcast).

Defined results: null and empty texts are equal and have no words; a null part
counts as the empty string; a null id is never smaller than another one, so its
row neither fails the filter on copies nor makes others fail it; rows that
repeat an id and text do not fail it either unless a smaller id has the text; a
document with several labels counts as good (toxic) if one of them says so;
null ids have no label; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import pick
from ledgerlens.session import materialize

#: The five filters of ``audit_documents``, in bit order.
LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_UPPER_PERCENT = 5
SYMBOLS = "[#$%&*|]"

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_GAP = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters on a text alone that it fails: 1 few words, 2 few distinct words, 4 capitals, 8 symbols."""
    words = F.split(F.btrim(text, F.lit(_SPACE)), _GAP)
    blank = F.btrim(text, F.lit(_SPACE)) == ""
    n_words = F.when(blank, 0).otherwise(F.size(words))
    distinct = F.when(blank, 0).otherwise(F.size(F.array_distinct(words)))
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n_words < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT_PERCENT * n_words,
        100 * upper > MOST_UPPER_PERCENT * F.char_length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def document_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and mask of the five filters, one row per document, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text", part).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("alone"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    rows = materialize(rows, "audit-texts")
    # Only texts that several rows have; the hot ones are a single row here, and the join splits their rows.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marked = rows.join(firsts.select("digest", "first"), "digest", "left").select(
        "doc_id", "part", (F.col("alone") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask")
    )
    return materialize(marked, "audit-masks")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents have it: n, good (quality 1) and toxic ones."""
    said = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null")
    said = said.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )
    every = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    labelled = masks.join(said, F.col("doc_id") == F.col("_id")).groupBy("part", "mask").agg(
        F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    return every.join(labelled, ["part", "mask"], "left").select(
        "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )


def removal_intervals(n_filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): the orders that remove a document with the mask at the step.

    A beginning of ``step - 1`` passed filters and one failed filter covers
    ``(n - step)!`` ranks in a row; the Lehmer digits of the beginning, each
    times the factorial of the places behind it, give the first.
    """
    found = []
    for mask in range(1, 1 << n_filters):
        failed = [f for f in range(n_filters) if mask >> f & 1]
        passed = [f for f in range(n_filters) if not mask >> f & 1]
        for step in range(1, len(passed) + 2):
            width = math.factorial(n_filters - step)
            for head in permutations(passed, step - 1):
                for last in failed:
                    begin = lehmer_rank((*head, last), n_filters)
                    found.append((mask, step, begin, begin + width))
    return found


def lehmer_rank(beginning: tuple[int, ...], n: int) -> int:
    """The smallest lexicographic rank, among the permutations of 0 .. n-1, of one with this beginning."""
    rank = 0
    for place, f in enumerate(beginning):
        digit = f - sum(g < f for g in beginning[:place])
        rank += digit * math.factorial(n - 1 - place)
    return rank


def _orders(spark: SparkSession, letters: str) -> DataFrame:
    """rank, step, filter_order, filter and its bit, for every order and step."""
    rows = [
        (rank, step + 1, "".join(order), f, 1 << letters.index(f))
        for rank, order in enumerate(permutations(letters))
        for step, f in enumerate(order)
    ]
    return spark.createDataFrame(rows, "rank int, step int, filter_order string, filter string, bit int")


def audit_masks(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of counts (part, mask, n, good, toxic): one row per part, order and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley, rank and filter; ``letters`` names the
    filters in alphabetical order, the first having bit 1.
    """
    if list(letters) != sorted(set(letters)):
        raise ValueError(f"letters must be distinct and in order: {letters!r}")
    spark = counts.sparkSession
    counts = materialize(counts, "audit-counts")
    spans = spark.createDataFrame(removal_intervals(len(letters)), "mask int, step int, begin int, behind int")
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("at"), F.lit(s).alias("sign")) for c, s in (("begin", 1), ("behind", -1))]))
    amounts = ["n", "good", "toxic"]
    deltas = (
        counts.join(F.broadcast(spans), "mask")
        .select("part", "step", ends.alias("end"), *amounts)
        .groupBy("part", "step", F.col("end.at").alias("rank"))
        .agg(*[F.sum(F.col("end.sign") * F.col(a)).alias(a) for a in amounts])
    )
    # Of a part: all documents, and per filter those that fail it and those that fail nothing else.
    bits = [1 << i for i in range(len(letters))]
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.create_map(*[x for b in bits for x in (F.lit(b), F.sum(F.when(F.col("mask").bitwiseAND(b) > 0, F.col("n")).otherwise(0)))]).alias("failing"),
        F.create_map(*[x for b in bits for x in (F.lit(b), F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)))]).alias("only"),
    )
    # n! * n rows a part: the result's own rows.
    ranks, steps = F.sequence(F.lit(0), F.lit(math.factorial(len(letters)) - 1)), F.sequence(F.lit(1), F.lit(len(letters)))
    grid = totals.withColumn("rank", F.explode(ranks)).withColumn("step", F.explode(steps))
    grid = grid.join(F.broadcast(_orders(spark, letters)), ["rank", "step"])
    rows = grid.join(deltas, ["part", "step", "rank"], "left")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "part", "rank", "step", "filter_order", "filter", "total",
        F.col("failing")[F.col("bit")].alias("failing"), F.col("only")[F.col("bit")].alias("only"),
        *[F.sum(F.coalesce(a, F.lit(0))).over(along).cast("long").alias(a) for a in amounts],
    )
    down = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("n").over(down)).cast("long").alias("kept"),
        F.col("n").alias("removed"),
        # Failing documents that this step does not remove went before, since it removes all that are left.
        (F.col("failing") - F.col("n")).cast("long").alias("redundant"),
        F.col("only").cast("long").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).cast("long").alias("shapley"),
        "rank", "filter",
    )


def audit_documents(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters over all documents, per value of the column ``part``."""
    return audit_masks(mask_counts(document_masks(docs, part), labels))
