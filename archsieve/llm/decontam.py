"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. Each benchmark item falls into
windows of ``WINDOW`` words (an item of fewer words is one window). All test terms are counted in the whole
corpus; a window is looked up by its two rarest words. The index stores the postings (term, document,
position) of these words. A posting minus the word's place in the item is an alignment; alignments that
enough of an item's rare words agree on are compared with the text word by word, and every window that
occurs there is a hit.

Items and texts are folded alike: only A-Z is lowered, so letters beyond it are found as they are written. Null texts have no words. Null and empty items have no windows. Repeated items count once by their id,
items without an id mark words but are not listed. Repeated rows give repeated results. Benchmark tables of any
size work: each is broadcast only up to a checked number of bytes, and joined by shuffles beyond it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from archsieve.llm.common import keyed, stored

WINDOW = 13
#: What is no word character.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bytes of a table of the benchmark up to which it is broadcast; its rows count with ROW_BYTES each beside their texts.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term of one posting that every document has; it carries the number of words.
DOCUMENT = ""


def folded(text: Column) -> Column:
    """A text with A-Z lower-cased; it does not depend on what stands around a letter, as lower() does for the Greek sigma."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def pieces(text: Column) -> Column:
    """The words of a text, with an empty string before and after where the text starts or ends with a gap."""
    return F.split(text, GAP)


def n_words(words: Column) -> Column:
    return (F.size(words) - (words[0] == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, words, first, size): a row for each window of each different item; words of the whole item."""
    exact = F.filter(pieces(folded(F.col("text"))), lambda w: w != "")
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).select("item_id", exact.alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", F.array_join("words", " ")))
    size = F.least(F.size("words"), F.lit(window))
    return items.select("item", "item_id", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("first"))


def sized(df: DataFrame, *texts: Column) -> DataFrame:
    """A hint to broadcast a stored table of the benchmark, if it is small by its bytes. texts: its columns of unbounded size."""
    size = F.lit(ROW_BYTES).cast("long") + functools.reduce(Column.__add__, [F.coalesce(t.cast("long"), F.lit(0)) for t in texts], F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def anchors(docs: DataFrame, found: DataFrame, rare: int = 2, text: str = "text") -> DataFrame:
    """(item, term, place): the places in each item of the rarest words of its windows.
    Windows with a word that the corpus lacks have none."""
    items = found.select("item", "words").distinct()
    places = items.select("item", F.posexplode("words").alias("place", "word")).select("item", "place", F.col("word").alias("term"))
    terms = stored(places.select("term").distinct(), "test-terms")
    counted = docs.select(F.explode(pieces(folded(F.col(text)))).alias("term")).join(sized(terms, F.octet_length("term")), "term").groupBy("term").agg(F.count("*").alias("n"))
    weighed = places.join(counted, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inside = found.select("item", "first", "size").join(weighed, "item").where("place >= first and place < first + size")
    ranked = inside.withColumn("least", F.min("n").over(W.partitionBy("item", "first"))).where("least > 0").withColumn("rank", F.row_number().over(W.partitionBy("item", "first").orderBy("n", "term", "place")))
    return stored(ranked.where(F.col("rank") <= rare).select("item", "term", "place").distinct(), "test-anchors")


def index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored postings (term, doc_id, _k, _c, n_words, position) of the terms, and one DOCUMENT posting a document."""
    words = pieces(folded(docs[text]))
    base = docs.select(docs[doc_id].alias("doc_id"), *keyed(docs, doc_id, text), words.alias("words")).select("doc_id", "_k", "_c", n_words(F.col("words")).alias("n_words"), "words")
    # the sign is appended after all words, so it never moves a position
    postings = base.select("doc_id", "_k", "_c", "n_words", F.posexplode(F.concat("words", F.array(F.lit("\x00")))).alias("position", "term"))
    wanted = stored(terms.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit("\x00"))), "anchor-terms")
    kept = postings.join(sized(wanted, F.octet_length("term")), "term").withColumn("term", F.when(F.col("term") == "\x00", DOCUMENT).otherwise(F.col("term")))
    return stored(kept, "postings")


def phrase_matches(docs: DataFrame, postings: DataFrame, found: DataFrame, places: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _k, _c, item, item_id, start, size): every occurrence of every window, start in words of ``pieces``."""
    # items that the corpus can hold, by their anchors: the words of all others stay where they are
    items = found.select("item", "item_id", "words", "size").distinct()
    items = stored(items.join(places.select("item").distinct(), "item", "left_semi"), "test-items")
    at = postings.where(F.col("term") != DOCUMENT).join(sized(places, F.octet_length("term")), "term").select("doc_id", "_k", "_c", "item", "place", (F.col("position") - F.col("place")).alias("shift"))
    # a true occurrence holds both rare words of its window (one, if the window is one word)
    aligned = at.groupBy("doc_id", "_k", "_c", "item", "shift").agg(F.count_distinct("place").alias("agree"))
    aligned = aligned.join(sized(items.select("item", "size", F.size("words").alias("long"))), "item").where(F.col("agree") >= F.least(F.lit(2), F.col("size")))
    candidates = aligned.groupBy("_k", "_c").agg(F.collect_list(F.struct("item", "shift", "long")).alias("alignments"))
    words = pieces(folded(F.col("text")))
    bodies = docs.select(docs[doc_id].alias("doc_id"), *keyed(docs, doc_id, text), docs[text].alias("text"))
    near = bodies.join(candidates, ["_k", "_c"]).select("doc_id", "_k", "_c", words.alias("body"), "alignments")
    # only the stretch beside the item travels on, never the text
    beside = F.transform("alignments", lambda x: F.struct(x["item"].alias("item"), x["shift"].alias("shift"), F.greatest(x["shift"], F.lit(0)).alias("begin"), F.slice("body", F.greatest(x["shift"], F.lit(0)) + 1, x["long"]).alias("body")))
    pairs = near.select("doc_id", "_k", "_c", F.explode(beside).alias("x")).select("doc_id", "_k", "_c", "x.*")
    words_bytes = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 8)
    stretch = pairs.join(sized(items, words_bytes), "item").select("doc_id", "_k", "_c", "item", "item_id", "words", "size", "shift", "begin", "body")
    offset = F.col("begin") - F.col("shift")  # words of the item before the text's first
    starts = F.filter(
        F.sequence(F.lit(0), F.size("words") - F.col("size")),
        lambda w: F.when(w >= offset, F.slice("body", w - offset + 1, F.col("size")) == F.slice("words", w + 1, F.col("size"))).otherwise(F.lit(False)),
    )
    return stretch.select("doc_id", "_k", "_c", "item", "item_id", "size", "shift", F.explode(starts).alias("first")).select("doc_id", "_k", "_c", "item", "item_id", (F.col("shift") + F.col("first")).alias("start"), "size").distinct()


def proximity_matches(postings: DataFrame, places: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item, start): places where all rare words of an item stand within ``slop`` words, counted from the
    item's first rare word by name. Lists are joined from that one word on, never word with word."""
    terms = places.select("item", "term").distinct()
    whole = terms.groupBy("item").agg(F.count("*").alias("terms"), F.min("term").alias("lead"))
    at = postings.where(F.col("term") != DOCUMENT).join(terms, "term")
    lead = at.join(whole, "item").where("term = lead").select("doc_id", "_k", "_c", "item", "terms", F.col("position").alias("start"))
    near = lead.join(at.select("_k", "_c", "item", "term", "position"), ["_k", "_c", "item"]).where(F.abs(F.col("position") - F.col("start")) <= slop)
    return near.groupBy("doc_id", "_k", "_c", "item", "start", "terms").agg(F.count_distinct("term").alias("n")).where("n = terms").select("doc_id", "item", "start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, _k, _c, n_words, n_hit, items, contaminated) of every row."""
    found = stored(windows(benchmark, window), "test-windows")
    places = anchors(docs, found, text=text)
    postings = index(docs, places, doc_id, text)
    hits = stored(phrase_matches(docs, postings, found, places, doc_id, text), "phrase-matches")
    # words covered by windows: each window adds what lies beyond all earlier ones
    by = W.partitionBy("_k", "_c").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(by.rowsBetween(W.unboundedPreceding, -1))
    spans = hits.select("_k", "_c", "start", "size").distinct().withColumn("reach", F.coalesce(reach, F.lit(-1)))
    hit = spans.groupBy("_k", "_c").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", "reach"))).cast("long").alias("n_hit"))
    named = hits.select("_k", "_c", "item_id").distinct().groupBy("_k", "_c").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    rows_of = postings.where(F.col("term") == DOCUMENT).select("doc_id", "_k", "_c", "n_words")
    out = rows_of.join(hit, ["_k", "_c"], "left").join(named, ["_k", "_c"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "_k", "_c", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
