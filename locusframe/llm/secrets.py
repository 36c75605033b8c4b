"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Two first-order Markov models of characters, one of random strings and one of ordinary
identifiers, are counted from labelled samples; transitions fall back on the frequency of the
second character, with add-one smoothing. A run of 20 or more characters of `[A-Za-z0-9+/_=-]`
whose mean log2 likelihood ratio per transition reaches the threshold is reported as `random`,
unless it overlaps a match of the patterns. The models judge the matches of the patterns too:
those whose value scores below the threshold stay spans and are counted as `n_ordinary`. All
built-in functions.

`fit` takes its labelled samples from the corpus, none of them from the runs to be judged: values
that the patterns found are random strings; words and numbers of 8 to 19 characters, shorter than
a run, of texts without a match are ordinary. Of each label at most `SAMPLES` distinct
values take part, one from each of as many buckets of a hash. This is the documented bound of
the fit; every text is searched. A fifth of the samples is held out: the threshold is the
score that loses least there (share of random strings missed plus `FALSE_WEIGHT` times the share of
ordinary ones reported; of equally good scores the middle), and precision and recall are measured
there. Without held-out samples of both labels the threshold is `MIN_BITS`.

Nulls and ties: a null text is empty. Rows that repeat (doc_id, text) share their findings and
are each returned; a null doc_id is a document like others. Without samples a model is uniform.
An empty table gives no rows. A very long text costs n log n in its matches and stays one row.
Other columns are ignored.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import digest
from locusframe.llm.spans import SPAN, apart, joined, of_kind, spans
from locusframe.session import materialise

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of the words that stand for ordinary identifiers; runs to be judged are longer.
ORDINARY = (8, 19)
MIN_BITS = 1.0
#: What an ordinary string reported costs against a random one missed: far more strings are ordinary.
FALSE_WEIGHT = 10
HELD_OUT = 5
#: Weight of a character's own frequency against its frequency after another.
BACKOFF = 8
SAMPLES = 20_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns that are long enough; value is what is secret."""
    assign = F.filter(spans(text, ASSIGN, "assign", 2), lambda s: F.char_length(s["value"]) >= 8)
    access = F.filter(spans(text, ACCESS, "access"), lambda s: F.char_length(s["value"]) >= 16)
    return F.concat(assign, access, spans(text, HEX, "hex"))


def train(samples: DataFrame) -> list[float]:
    """log2 ratios of transitions, at 128 * code of the first character + code of the second.

    samples: (value, label) with label 1 for random strings, 0 for identifiers. A value counts a
    transition once, so that no long value outweighs the others. At most 2 * 128 * 128 counts reach the driver.
    """
    codes = F.transform(F.split("value", "", -1), F.ascii)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a * 128 + b)
    rows = samples.where("value IS NOT NULL AND label IN (0, 1) AND char_length(value) > 1").select("label", F.explode(F.array_distinct(pairs)).alias("pair"))
    counts = {(r.label, r.pair): r.n for r in rows.where("pair BETWEEN 0 AND 16383").groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    places = [ord(c) for c in _ALPHABET]
    ratios = [0.0] * (128 * 128)
    models = []
    for label in (0, 1):
        into = {b: sum(counts.get((label, a * 128 + b), 0) for a in places) + 1 for b in places}
        total = sum(into.values())
        model = {}
        for a in places:
            row = [counts.get((label, a * 128 + b), 0) for b in places]
            for b, n in zip(places, row):
                model[a * 128 + b] = (n + BACKOFF * into[b] / total) / (sum(row) + BACKOFF)
        models.append(model)
    for pair in models[0]:
        ratios[pair] = round(math.log2(models[1][pair] / models[0][pair]), 6)
    return ratios


def randomness(value: Column, ratios: list[float]) -> Column:
    """Mean log2 likelihood ratio per transition of an ASCII string."""
    model = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    codes = F.transform(F.split(value, "", -1), F.ascii)
    steps = F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.size(codes)), lambda a, b: F.get(model, a * 128 + b))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return total / F.greatest(F.char_length(value) - 1, F.lit(1))


def _chosen(values: DataFrame, limit: int) -> DataFrame:
    """(value): distinct values, the one of least hash from each of `limit` buckets; no more than `limit` rows a task are exchanged."""
    keyed = values.select("value", F.xxhash64("value", F.lit(3)).alias("h"))
    least = materialise(keyed.groupBy(F.pmod("h", F.lit(limit)).alias("bucket")).agg(F.min("h").alias("h")).select("h"))
    return keyed.join(F.broadcast(least), "h").select("value").distinct()  # at most `limit` numbers


def samples_of(docs: DataFrame, found: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """Stored (value, label, held): values of the patterns' matches and words of texts without any."""
    known = found.select(F.explode("base.value").alias("value"))
    words = F.filter(F.split("text", "[^A-Za-z0-9+/_=-]+", -1), lambda w: F.char_length(w).between(*ORDINARY))
    free = docs.select("text").where(~F.col("text").rlike(ASSIGN) & ~F.col("text").rlike(ACCESS) & ~F.col("text").rlike(HEX))
    plain = free.select(F.explode(F.array_distinct(words)).alias("value"))
    both = _chosen(known, limit).withColumn("label", F.lit(1)).union(_chosen(plain, limit).withColumn("label", F.lit(0)))
    return materialise(both.withColumn("held", F.pmod(F.xxhash64("value", F.lit(11)), F.lit(HELD_OUT)) == 0))


class Model(NamedTuple):
    """Ratios of `train`, threshold, and both rates on the held-out samples (nan without any)."""

    ratios: list[float]
    min_bits: float
    precision: float
    recall: float


def threshold(scores: list[tuple[float, int]]) -> float:
    """The score of least loss; `MIN_BITS` if a label is missing."""
    n = [sum(1 for _, label in scores if label == k) for k in (0, 1)]
    if not min(n):
        return MIN_BITS
    scores = sorted(scores)
    missed, kept, best = 0, n[0], []
    # A cut below each distinct score, and one above all.
    cuts = sorted({x for x, _ in scores})
    at = 0
    for low, high in zip([cuts[0] - 1.0, *cuts], [*cuts, cuts[-1] + 1.0]):
        while at < len(scores) and scores[at][0] <= low:
            missed, kept, at = missed + scores[at][1], kept - (1 - scores[at][1]), at + 1
        best.append((missed / n[1] + FALSE_WEIGHT * kept / n[0], (low + high) / 2))
    least = min(loss for loss, _ in best)
    equal = [cut for loss, cut in best if loss == least]
    return round((equal[0] + equal[-1]) / 2, 6)


def fit(docs: DataFrame, found: DataFrame, limit: int = SAMPLES) -> Model:
    """Models of the corpus; `found` as of `located`. No more than 2 * `limit` scores reach the driver."""
    samples = samples_of(docs, found, limit)
    ratios = train(samples.where("NOT held"))
    held = [(r.bits, r.label) for r in samples.where("held").select(randomness(F.col("value"), ratios).alias("bits"), "label").collect()]
    cut = threshold(held)
    right, reported, random = sum(x >= cut and y == 1 for x, y in held), sum(x >= cut for x, _ in held), sum(y for _, y in held)
    return Model(ratios, cut, right / reported if reported else math.nan, right / random if random else math.nan)


def located(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, h, base, runs) of texts with any: `runs` are long runs that overlap no base span."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text", F.lit(3)).alias("h"), text.alias("text"))
    rows = rows.select("doc_id", "h", base_spans(F.col("text")).alias("base"), spans(F.col("text"), RUN, "random").alias("all")).where("size(base) > 0 OR size(all) > 0")
    return materialise(rows.select("doc_id", "h", "base", apart(F.col("all"), F.col("base")).alias("runs")))


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, min_bits: float | None = None) -> DataFrame:
    """doc_id, base and added spans, n_ordinary; one row per row of docs. Fits models to the corpus without `ratios`."""
    found = located(docs)
    model = fit(docs, found) if ratios is None else Model(ratios, MIN_BITS, math.nan, math.nan)
    least = model.min_bits if min_bits is None else min_bits
    judged = found.dropDuplicates(["doc_id", "h"]).select(
        "doc_id", "h", "base", F.filter("runs", lambda s: randomness(s["value"], model.ratios) >= least).alias("added"),
        F.size(F.filter("base", lambda s: randomness(s["value"], model.ratios) < least)).cast("long").alias("n_ordinary"),
    )
    judged = materialise(judged)
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    rows = docs.select("doc_id", F.xxhash64("text", F.lit(3)).alias("h"))
    none = F.array().cast(SPAN)
    # Findings have any length, so that whether they are broadcast is left to their measured size.
    return rows.alias("a").join(judged.alias("b"), same, "left").select(
        "a.doc_id", F.coalesce("b.base", none).alias("base"), F.coalesce("b.added", none).alias("added"),
        F.coalesce("b.n_ordinary", F.lit(0).cast("long")).alias("n_ordinary"),
    )


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans."""
    count = [of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        "doc_id", *count, F.size("added").cast("long").alias("n_random"), "n_ordinary",
        digest(joined(F.col("base"), KINDS)).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"),
    )
