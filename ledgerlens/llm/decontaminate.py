"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

A benchmark item is cut into windows of consecutive words.  The corpus is
indexed: one posting (term, document, position) for every occurrence of a term
that is among the rarest of some window, where "rarest" is by the number of
occurrences in the corpus.  A window's occurrences are found by intersecting
the posting lists of its rarest terms, each position less the term's offset in
the window, and by comparing all words at the places that are left.  Places
where the rare terms stand near each other, but not at their offsets, give
proximity matches.

Scale: four scans of the texts (term counts, postings, comparison, word
counts).  Only texts with candidates are compared: a table of at most
``MARKS`` marks of their rows is broadcast and sorts out the others before
anything is shuffled.  Rows are told apart by a 128-bit hash of id and text, so
rows of one id or none share no list.  Words are counted with map-side combination.  The benchmark's terms are joined from a written table,
so Spark broadcasts them while that table is small (its size is known) and
shuffles otherwise.  A window of only frequent words has long posting lists;
those joins are inner joins, whose hot terms adaptive execution splits.
Per-document lists are bounded by the document's length.

Defined results: a null or wordless text has no words and no hits; an item
without words has no window; an item shorter than a window is one window of all
its words; benchmark rows that repeat an id are all searched and count as one
item; an item with a null id gives hits but is not listed; repeated documents
get a row each; empty tables give no hits or no rows; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, pick
from ledgerlens.session import materialize

WINDOW_WORDS = 10
#: Rarest terms of a window whose posting lists are intersected.
LISTS = 2
#: Different marks of rows with candidates; a table of so many small numbers is broadcast.
MARKS = 1 << 18
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words (runs of letters, digits and anything beyond ASCII), in order."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Distinct windows: phrase (words joined by spaces), its words and the ids of its items."""
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(size - 1), F.lit(1))))
    return (
        pick(benchmark, "item_id", "text")
        .select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .select("item_id", "words", start.alias("start"))
        .select("item_id", F.slice("words", F.col("start"), size).alias("words"))
        .groupBy(F.array_join("words", " ").alias("phrase"))
        .agg(F.first("words").alias("words"), F.collect_set("item_id").alias("items"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, which tells rows of different id or text apart."""
    docs, more = pick(docs, "doc_id", "text"), F.lit("row")
    return docs.select(
        "doc_id", "text", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(more, "doc_id", "text").alias("b")).alias("row")
    )


def _terms_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, position and term of every occurrence of the wanted terms (a distinct column ``term``)."""
    every = docs.select("row", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return every.join(wanted, "term", "left_semi")


def rarest_terms(docs: DataFrame, windows: DataFrame, lists: int) -> DataFrame:
    """For each window the offset and term of its ``lists`` rarest words: phrase, list (0 is rarest), offset, term."""
    places = windows.select("phrase", F.posexplode("words").alias("offset", "term"))
    terms = materialize(places.select("term").distinct(), "benchmark-terms")
    counts = _terms_of(docs, terms).groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))
    rarest = Window.partitionBy("phrase").orderBy("occurrences", "term", "offset")  # at most a window's words
    return (
        places.join(counts, "term", "left")
        .withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
        .withColumn("list", F.row_number().over(rarest) - 1)
        .where(F.col("list") < lists)
        .select("phrase", "list", "offset", "term")
    )


def candidate_starts(docs: DataFrame, windows: DataFrame, lists: int = LISTS, slack: int = 0) -> DataFrame:
    """row, phrase, start (0-based word) and exact: places where the window's rarest terms meet.

    ``exact`` places have the rare terms at their offsets.  With ``slack``
    there are also the places of the rarest term with the next one at most so
    many words off its offset.
    """
    rare = materialize(rarest_terms(docs, windows, lists), "rare-terms")
    wanted = materialize(rare.select("term").distinct(), "index-terms")
    postings = materialize(_terms_of(docs, wanted), "postings")
    found = postings.join(rare, "term").select(
        "list", "row", "phrase", (F.col("position") - F.col("offset")).alias("start")
    )
    found = found.where(F.col("start") >= -slack)
    lengths = rare.groupBy("phrase").agg(F.max("list").alias("last"))  # one-word windows have one list
    at = found.where("list = 0").drop("list").distinct().join(lengths, "phrase")
    alone, out = at.where("last = 0").drop("last"), at.where("last > 0").drop("last")
    starts = []
    if slack:
        block = F.floor(F.col("start") / (slack + 1))
        near = found.where("list = 1").select(
            F.col("row").alias("_row"), F.col("phrase").alias("_phrase"), F.col("start").alias("_start"),
            F.explode(F.array(block - 1, block, block + 1)).alias("_block"),
        )
        meets = (
            (F.col("row") == F.col("_row"))
            & (F.col("phrase") == F.col("_phrase"))
            & (block == F.col("_block"))
            & (F.abs(F.col("start") - F.col("_start")) <= slack)
        )
        starts.append(out.join(near, meets, "left_semi").withColumn("exact", F.lit(False)))
    for k in range(1, lists):
        other = found.where(F.col("list") == k).select(
            F.col("row").alias("_row"), F.col("phrase").alias("_phrase"), F.col("start").alias("_start")
        )
        meets = (
            (F.col("row") == F.col("_row"))
            & (F.col("phrase") == F.col("_phrase"))
            & (F.col("start") == F.col("_start"))
        )
        short = lengths.where(F.col("last") < k).select(F.col("phrase").alias("_phrase"))  # too few words for this list
        both = out.join(other, meets, "left_semi")
        out = both if k == 1 else both.unionByName(out.join(short, F.col("phrase") == F.col("_phrase"), "left_semi"))
    starts.append(out.unionByName(alone).withColumn("exact", F.lit(True)))
    both = starts[0] if len(starts) == 1 else starts[0].unionByName(starts[1])
    return both.groupBy("row", "phrase", "start").agg(F.max("exact").alias("exact"))


def _with_matches(docs: DataFrame, candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, row and the checked candidates of the documents that have any: whether the window stands there."""
    lists = materialize(
        candidates.join(windows.select("phrase", "items", F.size("words").alias("length")), "phrase")
        .groupBy(F.col("row").alias("_row"))
        .agg(F.collect_list(F.struct("phrase", "start", "length", "items", "exact")).alias("candidates")),
        "candidate-lists",
    )
    mark = lambda row: F.pmod(F.col(row)["a"], F.lit(MARKS)).cast("int")
    marks = lists.select(mark("_row").alias("_mark")).distinct()
    stands = lambda w, c: F.array_join(F.slice(w, c["start"] + 1, c["length"]), " ") == c["phrase"]
    match = lambda w, c: (c["start"] >= 0) & c["exact"] & F.when(c["start"] >= 0, stands(w, c)).otherwise(False)
    # The list of one list of words binds the words, so that a text is split once and not for each candidate.
    checked = F.transform(
        F.array(words(F.col("text"))),
        lambda w: F.transform("candidates", lambda c: c.withField("phrase_match", match(w, c))),
    )
    return (
        docs.join(F.broadcast(marks), mark("row") == F.col("_mark"), "left_semi")
        .join(lists, F.col("row") == F.col("_row"))
        .select("doc_id", "row", checked[0].alias("checked"))
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, slack: int = 0) -> DataFrame:
    """One row per match: doc_id, phrase, items, start (0-based word of the document), kind.

    ``phrase`` matches are occurrences of whole windows; with ``slack``,
    ``near`` matches have the window's two rarest terms at most so many words
    off their distance in the window, and no phrase match at that place.
    """
    docs = _keyed(docs)
    windows = materialize(item_windows(benchmark, window), "windows")
    candidates = candidate_starts(docs, windows, slack=slack)
    every = _with_matches(docs, candidates, windows).select("doc_id", F.explode("checked").alias("m"))
    kind = F.when(F.col("m.phrase_match"), "phrase").otherwise("near")
    out = every.select("doc_id", "m.phrase", "m.items", "m.start", kind.alias("kind"))
    return out if slack else out.where("kind = 'phrase'")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = _keyed(docs)
    windows = materialize(item_windows(benchmark, window), "windows")
    found = _with_matches(docs, candidate_starts(docs, windows), windows)
    hits = F.filter("checked", lambda m: m["phrase_match"])
    places = F.array_distinct(
        F.flatten(F.transform("hits", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1)))
    )
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda m: m["items"]))))
    hit = (
        found.select(F.col("row").alias("_row"), hits.alias("hits"))
        .where(F.size("hits") > 0)
        .select("_row", F.size(places).cast("long").alias("n_hit"), items.alias("items"))
        .dropDuplicates(["_row"])  # rows that repeat id and text have the same hits
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        docs.select("doc_id", "row", F.size(words(F.col("text"))).cast("long").alias("n_words"))
        .join(hit, F.col("row") == F.col("_row"), "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), listed.alias("items"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )
