"""Spelling variants: words one inserted, deleted or replaced letter apart, and the frequent form of each.

Relational trie frontier. A word pair one edit apart shares the first or the last half of the longer
word, so every word is read forwards and backwards and the search starts at the node its first half
leads to. States (word, position, node, edits) meet the trie's edge table one level at a time: an
unedited state follows its own letter and branches into one replaced or deleted letter; an edited
one must follow the word. Words of each length have a trie of their own, and an edge below which a
single word lies carries that word, so a state that takes it ends there and is checked in full.
Replacements are sought from the smaller of two letters and deletions from the longer word.

Runs beyond LONG letters would make a level for each letter; they meet by the hashes of all their
one-deletion variants instead, checked in full as well.

A null text holds no words and a null id is spelt ''. Rows count as often as they repeat, an empty
table gives no rows, texts of any length are read whole, and columns other than doc_id and text are
not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import slices, tidy
from locusframe.session import materialise

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # a-z and U+00C0 to U+00FF in UTF-8
#: Of (document, run) hashes, those divisible by this lose a letter.
DAMAGE = 31
SHORTEST = 7
LEAST = 2
#: A form is this many times as frequent as the word it stands for.
RATIO = 10
LONG = 64
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
#: Forms grow RATIO times a step, so a chain within 64-bit counts has fewer than 2 ** DOUBLINGS steps.
DOUBLINGS = 5


def _points(word: bytes) -> int:
    """Code points of a run: all beyond ASCII take two bytes, the first of them C3."""
    return len(word) - word.count(b"\xc3")


def damaged(word: bytes, h: int) -> bytes:
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _counted(batches):
    held: Counter = Counter()

    def out():
        words = [w for w in held if _points(w) >= SHORTEST]
        for start in range(0, len(words), 50_000):
            part = words[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])

    for batch in slices(batches):
        for doc_id, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            runs = Counter(RUN.findall(text.lower()))
            start = zlib.crc32(doc_id + b":")
            for word in [w for w in runs if zlib.crc32(w, start) % DAMAGE == 0]:
                n = runs.pop(word)
                held[damaged(word, zlib.crc32(word, start))] += n
            held.update(runs)
            if len(held) >= HELD:
                yield from out()
                held.clear()
    yield from out()


def words(docs: DataFrame) -> DataFrame:
    """id, word, n: the distinct runs of SHORTEST letters or more, damaged as above, that stand LEAST times or more. Written."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "text")])
    counted = text.mapInArrow(tidy(_counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counted.where(F.col("n") >= LEAST).select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def _letter(text: Column, at: Column) -> Column:
    """The letter at a position counted from 0; '' beyond the end."""
    return F.substring(text, at + 1, F.lit(1))


def _after(text: Column, at: Column) -> Column:
    return F.substring(text, at + 1, F.lit(1 << 30))


def _without(text: Column, at: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at), _after(text, at + 1))


def _node(back: Column, length: Column, text: Column, depth: Column) -> Column:
    return F.xxhash64(back, length, F.substring(text, F.lit(1), depth))


def _read(table: DataFrame) -> DataFrame:
    """Each word forwards and backwards: back, o (the word as read), id, length."""
    ways = F.explode(F.array(*[F.struct(F.lit(b).alias("back"), (F.reverse("word") if b else F.col("word")).alias("o")) for b in (False, True)]))
    return table.select(ways.alias("r"), "id").select("r.back", "r.o", "id", F.char_length("r.o").alias("length"))


def _edges(table: DataFrame) -> DataFrame:
    """The tries below each word's first half: depth, node, letter, only, goal. Written by depth.

    `only` is the word below the edge if there is but one, and `goal` then the hash of what follows
    in it; else `goal` is the next node.
    """
    back, length, o, depth = F.col("back"), F.col("length"), F.col("o"), F.col("depth")
    below = F.explode(F.sequence(F.floor(length / 2).cast("int"), length - 1)).alias("depth")
    steps = _read(table).select("back", "o", "id", "length", below).select(
        "depth", _node(back, length, o, depth).alias("node"), _letter(o, depth).alias("letter"),
        _node(back, length, o, depth + 1).alias("child"), F.xxhash64(_after(o, depth + 1)).alias("rest"), "id",
    )
    grouped = steps.groupBy("depth", "node", "letter", "child").agg(F.count("*").alias("below"), F.min("id").alias("id"), F.min("rest").alias("rest"))
    single = F.col("below") == 1
    return materialise(
        grouped.select("depth", "node", "letter", F.when(single, F.col("id")).alias("only"), F.when(single, F.col("rest")).otherwise(F.col("child")).alias("goal")),
        "depth",
    )


def _starts(table: DataFrame, depth: int) -> DataFrame:
    """Unedited states that begin at this depth, in the trie of their own length and in that of one letter less."""
    first = _read(table).where(F.floor(F.col("length") / 2) == depth)
    tries = F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("trie")
    return first.select("back", "o", "id", "length", tries).where(F.col("trie") >= SHORTEST).select(
        "back", "o", "id", (F.col("trie") < F.col("length")).alias("shorter"), F.lit(None).cast("int").alias("edit"),
        _node(F.col("back"), F.col("trie"), F.col("o"), F.lit(depth)).alias("node"),
    )


def _level(states: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """States one level down, written; those at a single word (`only` not null) are pairs to check.

    An edited state after a deletion stands one letter further in its word than in the trie.
    """
    o, letter, fresh, shorter, only = F.col("o"), F.col("letter"), F.col("edit").isNull(), F.col("shorter"), F.col("only")
    here, then = _letter(o, F.lit(depth)), _letter(o, F.lit(depth + 1))
    # Unedited in the trie of its own length, a state that comes to a single word has come to its own.
    follows = fresh & (letter == here) & (shorter | only.isNull())
    # Of equal letters in a row the last is the one deleted.
    edits = fresh & F.when(shorter, (letter == then) & (here != then)).otherwise(letter > here)
    goes_on = ~fresh & (letter == F.when(shorter, then).otherwise(here))
    ends = only.isNull() | follows | (F.col("goal") == F.xxhash64(_after(o, F.lit(depth + 1) + shorter.cast("int"))))
    return materialise(states.join(edges, "node").where((follows | edits | goes_on) & ends).select(
        "back", "o", "id", "shorter", F.when(edits, F.lit(depth)).otherwise(F.col("edit")).alias("edit"), F.col("goal").alias("node"), "only",
    ))


def _one_apart(o: Column, word: Column, edit: Column) -> Column:
    """Whether `word` is `o` with the letter at `edit` (null: any) deleted, or with that letter replaced."""
    drops = F.when(edit.isNull(), F.exists(F.sequence(F.lit(0), F.char_length(o) - 1), lambda i: _without(o, i) == word)).otherwise(_without(o, edit) == word)
    swaps = (_letter(o, edit) != _letter(word, edit)) & (_without(o, edit) == _without(word, edit))
    return F.when(F.char_length(word) < F.char_length(o), drops).otherwise(F.coalesce(swaps, F.lit(False)))


def trie_pairs(table: DataFrame) -> DataFrame:
    """id, near: words of up to LONG letters one edit apart, each pair in one order. Repeats a pair found both ways.

    A level's states are written before the next begins, so a lost executor costs one level.
    """
    edges, columns = _edges(table), ["back", "o", "id", "shorter", "edit", "node"]
    longest = table.agg(F.max(F.char_length("word"))).first()[0] or 0
    found, going = table.select("id", F.col("id").alias("near")).limit(0), None
    for depth in range(SHORTEST // 2, longest):
        states = _starts(table, depth)
        if going is not None:
            states = states.unionByName(going.where("only IS NULL").select(*columns))
        going = _level(states, edges.where(F.col("depth") == depth).drop("depth"), depth)
        met = going.where("only IS NOT NULL").select("back", "o", "id", "edit", F.col("only").alias("near"))
        named = met.join(table.select(F.col("id").alias("near"), F.col("word").alias("as_read")), "near")
        other = F.when(F.col("back"), F.reverse("as_read")).otherwise(F.col("as_read"))
        found = found.unionByName(named.where(_one_apart(F.col("o"), other, F.col("edit"))).select("id", "near"))
    return found


#: Fixed values of the polynomial hash: a Mersenne prime and an odd base.
PRIME, BASE = (1 << 61) - 1, 1_000_003_000_037


def _variants(batches):
    """id, length, at, h: hashes of each word less the letter at each place, and at -1 of the whole word."""
    names = ["id", "length", "at", "h"]
    for batch in slices(batches, 10):
        for word_id, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, whole, head, tail, power = len(word), 0, 0, 0, 1
            for c in word:
                whole = (whole * BASE + ord(c)) % PRIME
            tails = [0]
            for c in reversed(word):  # hash of each ending, as it stands at the end of a word
                tail = (tail + ord(c) * power) % PRIME
                power = power * BASE % PRIME
                tails.append(tail)
            hashes, shift = [whole], pow(BASE, n - 1, PRIME)
            inverse = pow(BASE, -1, PRIME)
            for i, c in enumerate(word):
                hashes.append((head * shift + tails[n - 1 - i]) % PRIME)
                head = (head * BASE + ord(c)) % PRIME
                shift = shift * inverse % PRIME
            for start in range(0, n + 1, 50_000):
                part = hashes[start : start + 50_000]
                rows = [pa.array([word_id] * len(part), pa.int64()), pa.array([n] * len(part), pa.int32()), pa.array(range(start - 1, start - 1 + len(part)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(part, pa.int64())], names=names)


def variant_pairs(table: DataFrame) -> DataFrame:
    """id, near: words of any length one edit apart, met by the hashes of their one-deletion variants."""
    hashed = materialise(table.select("id", "word").mapInArrow(tidy(_variants), "id long, length int, at int, h long"))
    less, whole = hashed.where("at >= 0"), hashed.where("at < 0")
    other = less.select(F.col("id").alias("near"), "length", "at", "h")
    replaced = less.join(other, ["length", "at", "h"]).where("id < near").select("id", "near", "at")
    shorter = whole.select(F.col("id").alias("near"), (F.col("length") + 1).alias("length"), "h")
    deleted = less.groupBy("id", "length", "h").agg(F.min("at").alias("at")).join(shorter, ["length", "h"]).select("id", "near", "at")
    named = lambda c: table.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    met = replaced.unionByName(deleted).join(named("id"), "id").join(named("near"), "near")
    return met.where(_one_apart(F.col("id_word"), F.col("near_word"), F.col("at"))).select("id", "near")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word: see the module and `RATIO`.

    The form is the near word of largest n (ties: the smallest) if that n is RATIO times the word's;
    root follows forms to the last.
    """
    table = words(docs)
    size = F.char_length("word")
    pairs = trie_pairs(table.where(size <= LONG)).unionByName(variant_pairs(table.where(size >= LONG)))
    pairs = materialise(pairs.select(F.least("id", "near").alias("id"), F.greatest("id", "near").alias("near")).distinct())
    links = pairs.unionByName(pairs.select(F.col("near").alias("id"), F.col("id").alias("near")))
    named = links.join(table.select(F.col("id").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n")), "near")
    best = named.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_word").alias("word"), "near")).alias("best"))
    judged = table.join(best, "id", "left").withColumn("formed", F.coalesce(-F.col("best.n") >= RATIO * F.col("n"), F.lit(False)))
    judged = materialise(judged.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("formed"), F.col("best.word")).alias("form"),
        F.when(F.col("formed"), -F.col("best.n")).alias("form_n"), F.when(F.col("formed"), F.col("best.near")).alias("up"),
    ))
    ups = judged.where("up IS NOT NULL").select("id", "up")
    for _ in range(DOUBLINGS):
        ups = materialise(ups.alias("a").join(ups.select(F.col("id").alias("up"), F.col("up").alias("further")), "up", "left").select("id", F.coalesce("further", "up").alias("up")))
    roots = ups.join(table.select(F.col("id").alias("up"), F.col("word").alias("root")), "up").select("id", "root")
    return judged.join(roots, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
