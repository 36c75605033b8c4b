"""Cross-entropy difference of matched language models.

Two interpolated bigram models of words, one of target documents and one of the whole corpus,
have the same order, smoothing and vocabulary: all words of the corpus (A-Z lower-cased, split
at white space). Per token the loss is -log2 of

    weight * c(previous, word) / c(previous) + (1 - weight) * (c(word) + 1) / (N + vocabulary + 1)

and a document's score is the mean of target loss minus background loss: low for documents that
look like the target. A text's first token follows its start, which counts once a text that has
tokens. All words and all word pairs of all texts are counted, whatever their number: the models
grow with the corpus.

Scale: texts become blocks of some `BLOCK` tokens, written once with their words numbered within
the block. A block's distinct words and pairs, as 64-bit hashes with their counts in the block,
go to buckets by hash, are summed there, and the sums go back to the blocks that asked. So a
frequent word or pair is one entry a block, and no task holds more than a bucket or a block. Two
of a billion distinct pairs share a hash with probability about 0.03.

Nulls and ties: a null or empty text has no tokens, zero losses and a null score. Documents
without a label are background alone; a null doc_id is never a target document. Rows that
repeat a document count as often as they occur. Without target documents the target model is the
uniform law.
"""

from __future__ import annotations

import os
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.llm.common import prepare, slices, small, tidy
from locusframe.session import materialise

WEIGHT = 0.6
#: Tokens or distinct words at which a block ends (after the text that reaches them).
BLOCK, BLOCK_WORDS = 600_000, 200_000
#: Buckets are a power of two, at least 2**BUCKET_BITS, and hold about BUCKET_KEYS entries at most.
BUCKET_BITS, BUCKET_KEYS = 9, 2**21
#: Target ids (8 bytes) that may travel to every task; more are joined by shuffle.
TARGETS = 2_000_000
#: Stands for the start of a text among the hashes.
START = np.uint64(0x9E3779B97F4A7C15)


class Numbered(dict):
    """Words numbered in order of appearance."""

    def __missing__(self, word):
        self[word] = at = len(self)
        return at


def packed(values: np.ndarray) -> bytes:
    """Compressed, bytes of equal rank side by side."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return len(planes[0]).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not data:
        return np.empty(0, kind)
    size = int.from_bytes(data[:4], "little") * kind.itemsize
    planes = np.frombuffer(pa.decompress(data[4:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def steps(hashes: np.ndarray) -> np.ndarray:
    """Differences modulo 2**64, small where hashes are sorted; np.cumsum turns them back."""
    return np.diff(hashes, prepend=np.uint64(0))


def mixed(previous: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of word hashes."""
    x = previous * np.uint64(0xD6E8FEB86659FD93) + (word ^ (word >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks_of(docs: DataFrame) -> DataFrame:
    """Stored blocks of docs (doc_id, text, target): ids, lengths and labels of texts, word hashes, numbered tokens."""

    @tidy
    def code(batches):
        words, ids, lengths, labels, tokens, held = Numbered(), [], [], [], [], 0

        def block():
            hashes = np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in words], np.uint64)
            coded = np.concatenate(tokens)
            order = np.lexsort((hashes, -np.bincount(coded, minlength=len(hashes))))  # frequent words get small numbers
            hashes, coded = hashes[order], np.argsort(order)[coded].astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(os.urandom(8), "little") >> 1], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
                    *[pa.array([x], pa.binary()) for x in (packed(np.array(lengths, np.int32)), np.array(labels, np.int8).tobytes(), packed(steps(hashes)), packed(coded))],
                    pa.array([len(words) + len(coded)], pa.int64()),
                ],
                ["block", "ids", "lengths", "labels", "hashes", "tokens", "most"],
            )

        for batch in slices(batches, 50):
            ids.append(batch.column(0))
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = (text or b"").lower().split()
                tokens.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                lengths.append(len(found))
                labels.append(label)
                held += len(found)
            if held >= BLOCK or len(words) >= BLOCK_WORDS:
                yield block()
                words, ids, lengths, labels, tokens, held = Numbered(), [], [], [], [], 0
        if lengths:
            yield block()

    kind = docs.schema["doc_id"].dataType
    fields = [
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
        *[T.StructField(c, T.BinaryType()) for c in ("lengths", "labels", "hashes", "tokens")], T.StructField("most", T.LongType()),
    ]
    return materialise(docs.select("doc_id", F.col("text").cast("binary"), "target").mapInArrow(code, T.StructType(fields)))


class Block:
    """A stored block: its tokens, its distinct pairs, and the hashes of its words and pairs, sorted."""

    def __init__(self, row: dict):
        self.lengths, self.labels = unpacked(row["lengths"], np.int32), np.frombuffer(row["labels"], np.int8)
        self.hashes, self.tokens = np.cumsum(unpacked(row["hashes"], np.uint64)), unpacked(row["tokens"], np.int32)
        n, size = len(self.tokens), np.int64(len(self.hashes) + 1)
        previous = np.empty(n, np.int64)
        previous[1:] = self.tokens[:-1]
        first = (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]
        previous[first] = size - 1
        pairs, self.pair_of, self.n_pairs = np.unique(previous * size + self.tokens, return_inverse=True, return_counts=True)
        self.previous, self.word = pairs // size, pairs % size
        every = np.append(self.hashes, START)
        # The start of a text stands after the pairs: it is no word of the vocabulary.
        self.keys = self.hashes, np.append(mixed(every[self.previous], self.hashes[self.word]), START)
        self.order = [np.argsort(k) for k in self.keys]

    def counts(self):
        """(background, target) counts of words and of pairs, sorted as the hashes are."""
        label = np.repeat(self.labels, self.lengths)
        marked = label > 0
        some = self.lengths > 0
        words = np.bincount(self.tokens, minlength=len(self.hashes)), np.bincount(self.tokens[marked], minlength=len(self.hashes))
        pairs = (
            np.append(self.n_pairs, some.sum()),
            np.append(np.bincount(self.pair_of[marked], minlength=len(self.n_pairs)), (some & (self.labels > 0)).sum()),
        )
        return [[c[o].astype(np.uint32) for c in cs] for cs, o in zip((words, pairs), self.order)]


def asked(blocks: DataFrame, bits: int) -> DataFrame:
    """What each block asks of each bucket: hashes of words, then of pairs, with their counts in the block."""
    edges = (np.arange(1, 2**bits, dtype=np.uint64) << np.uint64(64 - bits))

    @tidy
    def ask(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = Block(row)
                keys = [k[o] for k, o in zip(own.keys, own.order)]
                (wn, wt), (pn, pt) = own.counts()
                w, p = [np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]).astype(int) for k in keys]
                part = lambda a, b, i: np.concatenate([a[w[i] : w[i + 1]], b[p[i] : p[i + 1]]])
                hashes = lambda a, b, i: np.concatenate([steps(a[w[i] : w[i + 1]]), steps(b[p[i] : p[i + 1]])])
                every = range(2**bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(2**bits, dtype=np.int32)), pa.array(np.full(2**bits, row["block"], np.int64)), pa.array(np.diff(w).astype(np.int32)),
                        *[pa.array([packed(f(a, b, i)) for i in every], pa.binary()) for f, a, b in ((hashes, *keys), (part, wn, pn), (part, wt, pt))],
                    ],
                    ["bucket", "block", "words", "keys", "n", "t"],
                )

    needed = blocks.select("block", "lengths", "labels", "hashes", "tokens")
    return needed.mapInArrow(ask, "bucket int, block long, words int, keys binary, n binary, t binary")


def answered(rows: DataFrame) -> DataFrame:
    """Sums over all blocks for what each asked, and each bucket's distinct words and tokens."""

    def answer(table: pa.Table) -> pa.Table:
        words = table.column("words").to_pylist()
        keys = [unpacked(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = [[unpacked(x, np.uint32) for x in table.column(c).to_pylist()] for c in ("n", "t")]
        sums, vocabulary, tokens = [], 0, [0, 0]
        for part in (lambda x, w: x[:w], lambda x, w: x[w:]):
            every = [np.cumsum(part(k, w)) for k, w in zip(keys, words)]
            distinct, place = np.unique(np.concatenate(every), return_inverse=True)
            ends = np.cumsum([len(k) for k in every])[:-1]
            totals = [
                np.bincount(place, np.concatenate([part(c, w) for c, w in zip(cs, words)]), len(distinct)).astype(np.uint64) for cs in counts
            ]
            if not sums:
                vocabulary, tokens = len(distinct), [int(x.sum()) for x in totals]
            sums.append([np.split(x[place], ends) for x in totals])
        out = [pa.array([packed(np.concatenate(x)) for x in zip(sums[0][i], sums[1][i])], pa.binary()) for i in (0, 1)]
        same = [pa.array(np.full(len(words), x, np.int64)) for x in (vocabulary, *tokens)]
        return pa.Table.from_arrays([*[table.column(c) for c in ("bucket", "block", "words")], *same, *out], ["bucket", "block", "words", "vocabulary", "n_all", "t_all", "n", "t"])

    return rows.groupBy("bucket").applyInArrow(answer, "bucket int, block long, words int, vocabulary long, n_all long, t_all long, n binary, t binary")


def score(docs: DataFrame, target_ids: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """doc_id, n_tokens, target_loss and background_loss (bits a token), score; one row per row of docs."""
    prepare(docs.sparkSession)
    marked = target_ids.select(F.col("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("target", F.lit(True))
    named = docs.select("doc_id", "text").join(small(marked, TARGETS), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    blocks = blocks_of(named)
    most = blocks.agg(F.sum("most")).first()[0] or 0
    bits = max(BUCKET_BITS, int(most // BUCKET_KEYS).bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "background_loss", "target_loss"]

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Block(left.drop_columns(["ids"]).to_pylist()[0])
        right = right.sort_by("bucket")
        words = right.column("words").to_pylist()
        vocabulary = sum(right.column("vocabulary").to_pylist())
        text = np.repeat(np.arange(len(own.lengths)), own.lengths)
        found = []
        for c in ("n", "t"):
            n = sum(right.column(f"{c}_all").to_pylist())
            rows = [unpacked(x, np.uint64) for x in right.column(c).to_pylist()]
            unigram, pair = np.empty(len(own.keys[0])), np.empty(len(own.keys[1]))
            unigram[own.order[0]] = np.concatenate([x[:w] for x, w in zip(rows, words)])
            pair[own.order[1]] = np.concatenate([x[w:] for x, w in zip(rows, words)])
            context = np.maximum(np.append(unigram, pair[-1]), 1)
            p = (1 - weight) * (unigram[own.word] + 1) / (n + vocabulary + 1) + weight * pair[:-1] / context[own.previous]
            found.append(np.bincount(text, -np.log2(p)[own.pair_of], len(own.lengths)) / np.maximum(own.lengths, 1))
        ids = left.column("ids").combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(own.lengths.astype(np.int64)), *map(pa.array, found)], names)

    answers = answered(asked(blocks, bits))
    rows = blocks.drop("most").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        losses, f"doc_id {kind}, n_tokens long, background_loss double, target_loss double"
    )
    return rows.select(
        "doc_id", "n_tokens", "target_loss", "background_loss",
        F.when(F.col("n_tokens") > 0, F.col("target_loss") - F.col("background_loss")).alias("score"),
    )
