"""Benchmark decontamination by a distributed positional inverted index.

Words: runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is ten
consecutive words of an item, or all of an item with fewer. The steps, all on built-in functions:

1.  Document counts of the test vocabulary over the whole corpus.
2.  Each window is represented by its `RAREST` rarest terms (a window with a term that no
    document has cannot occur). Postings (term, document, positions) of these terms are stored:
    the index. It is partitioned by document, so that no posting moves and no frequent term
    gathers in one task, and sorted by term within files, so that a lookup skips row groups.
3.  The rarest term's list, shifted by its offset in the window, gives starting points; the
    lists of the other stored terms, shifted likewise, are intersected with them.
4.  What is left is confirmed on the words of the text.

`proximity` answers from an index of all terms of the phrases asked which documents have them within
a span; the index of step 2 has too few terms for it, and no query returns it.

Nulls and ties: a null text or an item without words has no windows and no hits; a null doc_id
is a document like others. Rows that repeat (doc_id, text) share their findings and are each
returned. Items that share a window are each reported. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locusframe.llm.common import ascii_lower, digest, small, within
from locusframe.session import materialise

WINDOW = 10
RAREST = 3
#: Rows of test vocabulary, windows or candidate documents that may travel to every task.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of a text; null for a null text."""
    return F.array_remove(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h tells rows of one doc_id with different texts apart."""
    return docs.select("doc_id", F.xxhash64("text", F.lit(2)).alias("h"), "text")


def split(rows: DataFrame) -> DataFrame:
    """`rows` with their words in place of the text."""
    return rows.select("doc_id", "h", words_of(F.col("text")).alias("words"))


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: (window, terms, item_ids)."""
    parts = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0 AND item_id IS NOT NULL")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    rows = parts.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("terms"))
    return rows.groupBy("terms").agg(F.collect_set("item_id").alias("item_ids")).select(
        F.sha2(F.array_join("terms", " "), 256).alias("window"), "terms", "item_ids"
    )


def term_counts(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n): documents that contain each term of the vocabulary."""
    terms = words.select(F.explode(F.array_distinct("words")).alias("term"))
    return terms.join(small(vocabulary, BROADCAST_ROWS), "term").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, keep: int = RAREST) -> DataFrame:
    """(window, term, offset, place): the `keep` rarest terms of each window that can occur."""
    terms = windows.select("window", F.size("terms").alias("width"), F.posexplode("terms").alias("offset", "term"))
    known = terms.join(counts, "term", "left")
    rank = W.partitionBy("window").orderBy(F.col("n").asc_nulls_first(), "term", "offset")  # ten rows at most
    ranked = known.withColumn("place", F.row_number().over(rank)).withColumn(
        "never", F.max(F.col("n").isNull()).over(W.partitionBy("window"))
    )
    return ranked.where(f"place <= {keep} AND NOT never").select("window", "term", "offset", "place")


def build_index(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, doc_id, h, at) of the given terms; `at` counts from 0."""
    rows = words.select("doc_id", "h", F.posexplode("words").alias("at", "term"))
    postings = rows.join(small(terms.select("term").distinct(), BROADCAST_ROWS), "term").select("term", "doc_id", "h", "at")
    return materialise(postings.sortWithinPartitions("term"))


def starts_of(index: DataFrame, rare: DataFrame) -> DataFrame:
    """(window, doc_id, h, start): where all stored terms of a window stand at their offsets."""
    needed = rare.groupBy("window").agg(F.max("place").alias("needed"))
    lists = rare.join(needed, "window")
    first = small(lists.where("place = 1"), BROADCAST_ROWS)
    found = index.join(first, "term").select("window", "needed", "doc_id", "h", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
    # One row for each place (repeated documents repeat their postings), so that counts compare.
    found = materialise(found.distinct())
    place = 2
    while place <= RAREST:
        following = small(lists.where(f"place = {place}").select("window", "term", "offset"), BROADCAST_ROWS)
        other = index.join(following, "term").select("window", "doc_id", "h", (F.col("at") - F.col("offset")).alias("start"))
        # Only documents with a starting point take part.
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("window", "doc_id", "h", "start")]
        condition = same[0] & same[1] & same[2] & same[3]
        kept = found.where(f"needed >= {place}").alias("a").join(other.alias("b"), condition, "left_semi")
        found = kept.unionByName(found.where(f"needed < {place}"))
        place += 1
    return found.select("window", "doc_id", "h", "start")


def occurrences(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Confirmed (doc_id, h, start, size, item_ids) of every place where a window occurs."""
    words = split(keyed(docs))
    windows = materialise(windows_of(items, width))
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    counts = materialise(term_counts(words, vocabulary))
    rare = materialise(rarest_terms(windows, counts))
    index = build_index(words, rare)
    starts = materialise(starts_of(index, rare))
    return confirm(keyed(docs), starts, windows)


def confirm(rows: DataFrame, starts: DataFrame, windows: DataFrame) -> DataFrame:
    """Starting points at which the text has all words of the window."""
    places = starts.groupBy("doc_id", "h", "window").agg(F.collect_list("start").alias("starts"))
    named = places.join(small(windows, BROADCAST_ROWS), "window")
    candidates = starts.select("doc_id", "h").distinct()
    c = F.broadcast(candidates) if within(candidates, BROADCAST_ROWS) else candidates
    same = F.col("w.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("w.h") == F.col("c.h"))
    texts = split(rows.alias("w").join(c.alias("c"), same, "left_semi").dropDuplicates(["doc_id", "h"]))
    same = F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.h") == F.col("p.h"))
    both = texts.alias("t").join(named.alias("p"), same).select("p.doc_id", "p.h", "t.words", "p.starts", "p.terms", "p.item_ids")
    good = F.filter("starts", lambda s: F.slice("words", s + 1, F.size("terms")) == F.col("terms"))
    return both.select("doc_id", "h", F.explode(good).alias("start"), F.size("terms").alias("size"), "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (array), contaminated; and the row's key `h`."""
    found = materialise(occurrences(docs, items, width))
    hit = found.select("doc_id", "h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
    hits = hit.distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    named = found.select("doc_id", "h", F.explode("item_ids").alias("item")).distinct()
    items_of = named.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    per_doc = hits.alias("a").join(items_of.alias("b"), same).select("a.doc_id", "a.h", "a.n_hit", "b.items")
    per_doc = materialise(per_doc)
    per_doc = small(per_doc, BROADCAST_ROWS)
    rows = split(keyed(docs)).select("doc_id", "h", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"))
    rows = rows.withColumn("n_words", F.greatest("n_words", F.lit(0).cast("long")))
    return rows.alias("a").join(per_doc.alias("b"), same, "left").select(
        "a.doc_id", "a.h", "a.n_words",
        F.coalesce("b.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("b.items", F.array().cast("array<string>")).alias("items"),
    ).select(
        "doc_id", "h", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        digest(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def proximity(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """(phrase, doc_id, h, at): places of a phrase's first-listed term in a stretch of `span` words with all its terms.

    phrases: (phrase, terms). The index must hold postings of all their terms.
    """
    terms = phrases.select("phrase", F.array_distinct("terms").alias("t")).select("phrase", F.size("t").alias("n"), F.posexplode("t").alias("place", "term"))
    lists = index.join(small(terms, BROADCAST_ROWS), "term").select("phrase", "n", "place", "doc_id", "h", "at").distinct()
    first, rest = lists.alias("a"), lists.alias("b")
    # A stretch that has all terms can start at one of them.
    near = (
        (F.col("a.phrase") == F.col("b.phrase")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
        & (F.col("b.at") >= F.col("a.at")) & (F.col("b.at") - F.col("a.at") < span)
    )
    met = first.join(rest, near).groupBy("a.phrase", "a.n", "a.doc_id", "a.h", "a.at").agg(
        F.count_distinct("b.place").alias("met"), F.collect_set(F.when(F.col("b.place") == 0, F.col("b.at"))).alias("leads")
    )
    return met.where("met = n").select("phrase", "doc_id", "h", F.explode("leads").alias("at")).distinct()
