"""Quality rules: an isolation forest over rule statistics, calibrated with labelled rows.

Statistics of a text (words: runs without white space): word_chars, n_symbols, n_dup_lines,
n_repeat_words and n_words, turned into rates. The base rule fails texts of fewer than
`min_words` words or with more than half their words in repeated three-word windows.

The forest: `TREES` trees of random splits, each over a seeded sample of `SAMPLE` rows from the
fitting table. Short average path lengths mark anomalous documents. The fitting table is the
labelled documents, `FIT_ROWS` of them at most, chosen by a seeded hash of the id; this is the
documented bound of the fit; of rows that repeat an id, the one of least statistics takes part. Trees grow on the good ones, with cuts over the range of good and bad. The threshold is the least score above
which at most `GOOD_LOST` of the good labelled rows lie, so that clean documents stay. Without
good labelled rows there is no forest and the base rule alone decides.

Nulls and ties: a null text has no words and fails the base rule. Labels of null, of unknown
ids and repeated labels are harmless; an id with differing labels counts as bad. Rows that
repeat a document are each returned. Other columns are kept where a caller asks for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.llm.common import prepare, slices, tidy

MIN_WORDS = 50
TREES, SAMPLE, DEPTH, FIT_ROWS = 100, 256, 12, 20_000
GOOD_LOST = 0.002
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def statistics_of(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()  # of bytes: ASCII white space alone
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode())
    symbols = len(_SYMBOLS.findall(joined))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeated = 0
    if n > 2:
        ids: dict[bytes, int] = {}
        coded = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pair = np.unique(coded[:-1] * len(ids) + coded[1:], return_inverse=True)[1]
        _, window, count = np.unique(pair[:-1] * len(ids) + coded[2:], return_inverse=True, return_counts=True)
        hit = count[window] > 1
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[i : n - 2 + i] |= hit
        repeated = int(inside.sum())
    return n, chars, symbols, dup, repeated


def rates(stats: np.ndarray) -> np.ndarray:
    """Features of the forest from the five statistics (one row each)."""
    n = np.maximum(stats[:, 0], 1)
    return np.column_stack(
        [np.log(n), stats[:, 1] / n, np.sqrt(stats[:, 2] / n), np.sqrt(stats[:, 3] / n), np.sqrt(stats[:, 4] / n)]
    ).astype(np.float64)


class Forest:
    """Isolation forest as flat arrays: feature, cut, children and path length per node.

    Trees hold `rows`; cuts fall anywhere between `low` and `high`, the range of all fitted rows,
    so that regions without any of `rows` are cut off early.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.trees = []
        size = min(SAMPLE, len(rows))
        for _ in range(TREES):
            nodes: list[list[float]] = []

            def grow(part, low, high, depth):
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, depth + self._rest(len(part))])
                open_ = np.flatnonzero(high > low)
                if depth < DEPTH and len(part) > 1 and len(open_):
                    f = int(rng.choice(open_))
                    cut = float(rng.uniform(low[f], high[f]))
                    left, below, above = part[:, f] < cut, high.copy(), low.copy()
                    below[f] = above[f] = cut
                    nodes[at] = [f, cut, grow(part[left], low, below, depth + 1), grow(part[~left], above, high, depth + 1), 0.0]
                return at

            grow(rows[rng.choice(len(rows), size, replace=False)], low, high, 0)
            self.trees.append(np.array(nodes))
        self.scale = max(self._rest(size), 1.0)

    @staticmethod
    def _rest(n: int) -> float:
        """Mean path length of an unsuccessful search among n rows."""
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def scores(trees: list[np.ndarray], scale: float, rows: np.ndarray) -> np.ndarray:
    """Near 1: anomalous; under 0.5: ordinary."""
    depth = np.zeros(len(rows))
    index = np.arange(len(rows))
    for nodes in trees:
        at = np.zeros(len(rows), np.int64)
        while True:
            f = nodes[at, 0].astype(np.int64)
            inner = f >= 0
            if not inner.any():
                break
            go = np.where(rows[index, np.maximum(f, 0)] < nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(np.int64)
            at = np.where(inner, go, at)
        depth += nodes[at, 4]
    return 2.0 ** (-depth / len(trees) / scale)


def _table(docs: DataFrame, extra: list[str], judge: Callable[[np.ndarray], list[pa.Array]] | None = None) -> DataFrame:
    """`extra` columns and the five statistics of each row; with `judge`, anomaly, base_failed and kept."""
    wanted = docs.select(*[F.col(f"`{c}`") for c in extra], F.col("text").cast("binary").alias("_quality_text"))
    fields = [wanted.schema[c] for c in extra] + [T.StructField(c, T.LongType()) for c in STATISTICS]
    if judge:
        fields += [T.StructField("anomaly", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    names = [f.name for f in fields]

    @tidy
    def count(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            stats = [statistics_of(x) for x in batch.column(len(extra)).to_pylist()]
            columns = [pa.array([s[i] for s in stats], pa.int64()) for i in range(len(STATISTICS))]
            verdict = judge(np.array(stats, np.float64)) if judge else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], *columns, *verdict], names)

    return wanted.mapInArrow(count, T.StructType(fields))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Forest, float] | None:
    """Forest and threshold from at most `fit_rows` labelled documents."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(fit_rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    passed = _table(known, ["doc_id", "_quality"]).where(~base_failed())
    # One row an id, so that rows which repeat it push no other id out: at most `fit_rows`.
    once = passed.groupBy("doc_id", "_quality").agg(F.min(F.struct(*STATISTICS)).alias("_least")).select("_quality", "_least.*")
    rows = once.orderBy("_quality", *STATISTICS).toPandas()
    good = rows[rows["_quality"] == 1][STATISTICS].to_numpy(np.float64)
    if not len(good):
        return None
    every = rates(rows[STATISTICS].to_numpy(np.float64))
    forest = Forest(rates(good), every.min(axis=0), every.max(axis=0))
    ranked = np.sort(scores(forest.trees, forest.scale, rates(good)))
    lost = int(len(ranked) * GOOD_LOST)
    return forest, float(ranked[len(ranked) - 1 - lost])


def quality(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` of docs (doc_id by default), statistics, score, base_failed and kept."""
    prepare(docs.sparkSession)
    carry = ["doc_id"] if carry is None else carry
    model = fit(docs, labels)
    # Plain arrays: executors need not know the class.
    sent = docs.sparkSession.sparkContext.broadcast(model and (model[0].trees, model[0].scale, model[1]))

    def judge(stats: np.ndarray) -> list[pa.Array]:
        failed = (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > 50 * stats[:, 0])
        if sent.value is None:
            return [pa.array(np.zeros(len(stats))), pa.array(failed), pa.array(~failed)]
        score = scores(sent.value[0], sent.value[1], rates(stats))
        return [pa.array(score), pa.array(failed), pa.array(~failed & (score <= sent.value[2]))]

    return _table(docs, carry, judge)
