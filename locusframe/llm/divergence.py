"""How the wording of one source departs from other sources and from its whole language.

In-mapper stripes: a task folds whole documents into hash stripes, term -> (documents, occurrences
by source), and spills them when they fill up; stripes of a term meet sorted by key and are merged
as they stream by. Buckets of merged stripes then yield the divergences directly.

A null text, lang or source counts as ''. Terms are runs of letters and of everything beyond
ASCII, only A-Z lower-cased. Each row is a document, also where rows repeat. A text of any length is
folded whole. An empty table gives no rows; a language without kept terms gives pairs of value 0
and no terms. Columns other than lang, source and text are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import slices, tidy
from locusframe.session import materialise

TERM = re.compile(rb"[a-z\x80-\xff]+")  # of UTF-8, lower-cased
#: Documents of its language that a term needs.
MIN_DOCUMENTS = 10
#: (term, source) entries that a task holds before it spills its stripes.
SPILL = 500_000
#: Kept terms of a language that one bucket holds.
BUCKET = 20_000
#: Dense cells (terms x sources) worked on at once in a bucket.
CELLS = 1_000_000
#: Terms reported of each group.
TOP = 10
SCALE = 1_000_000_000

STRIPE = "lang string, term string, documents long, sources array<string>, counts array<long>"
_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("documents", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
FOUND = "lang string, source string, part string, item string, value long"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class _Stripes:
    """What a task has folded: documents by term, and occurrences by source and term, of each language."""

    def __init__(self):
        self.documents: dict[bytes, Counter] = {}
        self.counts: dict[tuple[bytes, bytes], Counter] = {}
        self.size = 0

    def fold(self, lang: bytes, source: bytes, text: bytes) -> None:
        terms = TERM.findall(text.lower())
        documents = self.documents.setdefault(lang, Counter())
        counts = self.counts.setdefault((lang, source), Counter())
        before = len(counts)
        counts.update(terms)
        documents.update(set(terms))
        self.size += len(counts) - before

    def spill(self, rows: int = 50_000):
        for lang, documents in self.documents.items():
            terms = list(documents)
            at = {term: i for i, term in enumerate(terms)}
            own = [(source, c) for (of, source), c in self.counts.items() if of == lang and c]
            if not own:
                continue
            term = np.concatenate([np.fromiter(map(at.__getitem__, c), np.int64, len(c)) for _, c in own])
            source = np.repeat(np.arange(len(own)), [len(c) for _, c in own])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in own])
            order = np.argsort(term, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))]).astype(np.int32)
            names = pa.array([s for s, _ in own], pa.string()).take(pa.array(source[order]))
            stripe = pa.RecordBatch.from_arrays(
                [
                    pa.array([lang], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))), pa.array(terms, pa.string()),
                    pa.array(np.fromiter(documents.values(), np.int64, len(terms))),
                    pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(count[order])),
                ],
                schema=_STRIPE,
            )
            for start in range(0, len(terms), rows):
                yield stripe.slice(start, rows)
        self.__init__()


def _folded(batches):
    held = _Stripes()
    for batch in slices(batches):
        for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            held.fold(lang, source, text)
            if held.size >= SPILL:
                yield from held.spill()
    yield from held.spill()


def _met(batch: pa.RecordBatch, least: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Sorted stripes with those of a key added up: the complete ones of `least` documents or more, and the last key's."""
    n = batch.num_rows
    first = np.ones(n, bool)
    for name in ("lang", "term"):
        column = batch[name]
        changed = pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        first[1:] = changed if name == "lang" else first[1:] | changed
    starts = np.flatnonzero(first)
    documents = np.add.reduceat(batch["documents"].to_numpy(), starts)
    stay = documents >= least
    stay[-1] = True  # its key may go on in the next batch
    place = np.cumsum(stay) - 1
    group = np.cumsum(first) - 1
    of = np.repeat(group, pc.list_value_length(batch["sources"]).to_numpy(zero_copy_only=False))
    sources = batch["sources"].flatten().dictionary_encode()
    code, count = sources.indices.to_numpy().astype(np.int64), batch["counts"].flatten().to_numpy()
    kept = stay[of]
    key = place[of[kept]] * len(sources.dictionary) + code[kept]
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[kept][order]
    cells = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    totals, key = np.add.reduceat(count, cells), key[cells]
    ends = np.concatenate([[0], np.cumsum(np.bincount(key // len(sources.dictionary), minlength=int(stay.sum())))]).astype(np.int32)
    rows = pa.array(starts[stay])
    out = pa.RecordBatch.from_arrays(
        [
            batch["lang"].take(rows), batch["term"].take(rows), pa.array(documents[stay]),
            pa.ListArray.from_arrays(ends, sources.dictionary.take(pa.array(key % len(sources.dictionary)))), pa.ListArray.from_arrays(ends, pa.array(totals)),
        ],
        schema=_STRIPE,
    )
    return out.slice(0, out.num_rows - 1), out.slice(out.num_rows - 1)


def _merged(least: int):
    """Sorted stripes to one stripe a key, of terms in at least `least` documents."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.cast(_STRIPE)
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            whole, held = _met(batch, least)
            if whole.num_rows:
                yield whole
        if held is not None and held["documents"][0].as_py() >= least:
            yield held

    return run


def stripes(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, documents, sources, counts: one merged stripe of each kept term. Written."""
    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = text.mapInArrow(tidy(_folded), STRIPE).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return materialise(parts.mapInArrow(tidy(_merged(least)), STRIPE))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total) in 64 bits; SCALE is applied in two exact steps."""
    a, b = 31_250, SCALE // 31_250
    whole, rest = np.divmod((count + 2) * a, total)
    return 1 + whole * b + rest * b // total


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _bucket(key, held: pa.Table, groups: pa.Table) -> pa.Table:
    """Divergences of one bucket of stripes: summed for each pair of sources, and the TOP terms of each source.

    Most terms miss most sources, whose share is then the same for all such terms: a pair's sum
    starts from that constant, and terms correct it only where one of the two sources has them.
    """
    order = np.argsort(np.array(groups["source"].to_pylist(), dtype=object), kind="stable")
    groups = groups.take(pa.array(order))
    lang, names = groups["lang"][0].as_py(), groups["source"].to_pylist()
    at = {s: i for i, s in enumerate(names)}
    own, kept, whole = groups["n"].to_numpy(), groups["kept"][0].as_py(), groups["lang_n"][0].as_py()
    total = np.maximum(own + 2 * kept, 1)
    absent = share(np.zeros_like(own), total)
    terms = held["term"].to_pylist()
    base = divergence(absent[:, None], absent[None, :])
    pair = base * len(terms)
    best: list[list] = [[] for _ in names]
    sources, counts = held["sources"].to_pylist(), held["counts"].to_pylist()
    step = max(1, CELLS // len(names))
    for start in range(0, len(terms), step):
        stop = min(start + step, len(terms))
        count = np.zeros((stop - start, len(names)), np.int64)
        for i in range(start, stop):
            count[i - start, [at[s] for s in sources[i]]] = counts[i]
        p, q = share(count, total), share(count.sum(1), np.int64(whole + 2 * kept))
        for s in range(len(names)):
            rows = np.flatnonzero(count[:, s])
            change = divergence(p[rows, s][:, None], p[rows]) - base[s]
            pair[s] += change.sum(0)
            pair[:, s] += np.where(count[rows] > 0, 0, change).sum(0)  # the other source has such terms in its own turn
            over = rows[p[rows, s] > q[rows]]
            value = divergence(p[over, s], q[over])
            if len(over) > TOP:  # ties with the last stay in
                cut = np.partition(value, -TOP)[-TOP]
                over, value = over[value >= cut], value[value >= cut]
            best[s] = heapq.nsmallest(TOP, best[s] + [(-int(v), terms[start + i]) for i, v in zip(over, value, strict=True)])
    out = [(lang, a, "pair", b, int(pair[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    out += [(lang, names[s], "term", term, -v) for s, top in enumerate(best) for v, term in top]
    return pa.Table.from_pylist([dict(zip(_FOUND.names, row, strict=True)) for row in out], schema=_FOUND)


def divergences(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows against each other source of the language, and
    the TOP `term` rows against the language. Values are exact integers; ties go by item.

    A task holds the sums of all pairs of one language's sources, as many as the result has.
    """
    held = stripes(docs, least)
    entries = held.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    counted = entries.groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(counted, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(held.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    langs = materialise(langs.withColumn("kept", F.coalesce("kept", F.lit(0).cast("long"))).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("kept") / BUCKET)).cast("long")))
    place = F.pmod(F.xxhash64("term"), F.col("buckets"))
    dealt = held.join(langs, "lang").select("lang", place.alias("bucket"), "term", "sources", "counts")
    asked = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), "source", "n", "lang_n", "kept")
    found = dealt.groupBy("lang", "bucket").cogroup(asked.groupBy("lang", "bucket")).applyInArrow(_bucket, FOUND)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
