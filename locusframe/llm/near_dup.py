"""Near-duplicate detection with HyperMinHash registers.

A document's set is its distinct five-word shingles (words: runs without white space, A-Z
lower-cased; fewer than five words: the whole sequence is one shingle). Two documents are
linked if 100 * intersection >= 75 * union. The result is the component of each document in
that graph, found without writing out the pairs of a group:

1.  Every document gets 128 registers. Its shingle hashes are dealt over the registers; each
    keeps its minimum as a leading-zero count and ten mantissa bits. A register that got none
    takes the minimum of all shingles under a hash function of its own, so that registers
    agree with probability J at any set size.
2.  Equal sets are one class; only its smallest doc_id goes on.
3.  Registers are banded in fours. Of 32 bands, at least one agrees with probability
    1 - (1 - 0.75**4)**32 > 0.99999 for a pair at the threshold, more above it.
4.  In each bucket the smallest id leads. Each member is tested against its most frequent and
    its smallest leader: collision-corrected estimate of J first, then the full sets. Most
    groups are connected after that.
5.  Buckets in which members of different components are left, and were not just tested, are
    searched in full: blocks of bounded size, pairs of blocks where a bucket holds several.
    Within a task counts of shared shingles come from an inverted list, and only links that
    join two components leave the task. No pair of different components in a bucket is left out.
6.  Components by repeated minimum and pointer jumping over checkpointed tables.

Nulls and ties: a null or wordless text has an empty set and is linked with nothing; a null
doc_id is never linked, its component is null and it is kept. Rows that repeat a doc_id are one
node of the graph, with all their sets. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import prepare, slices, small, tidy
from locusframe.session import materialise

REGISTERS = 128
BAND = 4
MANTISSA = 10
SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
#: The estimate's standard error at J = 0.75 is 0.038; five of them.
SLACK = 0.19
#: Rows of a bucket, and shingles, that one side of a block holds on average.
BLOCK = 1500
BLOCK_SHINGLES = 1_500_000
#: Ids (8 bytes) that may travel to every task; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20).integers(1, 2**63, REGISTERS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Shingle hashes of a text; keeps the hashes of recent words."""

    def __init__(self, kept: int = 120_000):
        import xxhash

        self.hash, self.kept, self.words = xxhash.xxh64_intdigest, kept, {}

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes."""
        words = (text or b"").lower().split()  # of bytes: A-Z and ASCII white space alone
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > self.kept:
            known.clear()
        hashes = np.empty(len(words), np.uint64)
        try:
            hashes[:] = [known[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self.hash(w)
            hashes[:] = [known[w] for w in words]
        width = min(SHINGLE, len(words))
        n = len(words) - width + 1
        rolled = np.full(n, width, np.uint64)
        for i in range(width):
            rolled = rolled * _MULTIPLIER + _mix(hashes[i : n + i])
        return np.unique(_mix(rolled))


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits: source (1), leading zeros (5), mantissa (10)."""
    bits = np.uint64(REGISTERS.bit_length() - 1)
    spread = _mix(shingles ^ _MULTIPLIER)
    bucket = (spread >> (np.uint64(64) - bits)).astype(np.int64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    value = spread << bits
    np.minimum.at(least, bucket, value)
    empty = np.ones(REGISTERS, bool)
    empty[bucket] = False
    for i in np.flatnonzero(empty):
        least[i] = _mix(shingles ^ _SEEDS[i]).min()
    # Exact up to the 53 bits of a double; only the leading one and ten bits below it are used.
    fraction, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 31).astype(np.uint16)
    mantissa = np.minimum(((fraction - 0.5) * 2 * 2**MANTISSA), 2**MANTISSA - 1).astype(np.uint16)
    return (empty.astype(np.uint16) << np.uint16(15)) | (zeros << np.uint16(MANTISSA)) | mantissa


def accidental(n: float, m: float) -> float:
    """Probability that registers of disjoint sets of n and m shingles agree."""
    z = np.arange(0, 32)

    def law(size: float) -> np.ndarray:
        rate = max(size / REGISTERS, 1.0) if size > REGISTERS else size
        upper, lower = 2.0**-z, np.where(z < 31, 2.0 ** -(z + 1), 0)
        return np.exp(-rate * lower) - np.exp(-rate * upper)

    return float((law(n) * law(m)).sum() / 2**MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard similarity from registers, corrected for accidental agreement."""
    by_chance = accidental(n, m)
    return (float((a == b).mean()) - by_chance) / (1 - by_chance)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The definition, on full sets."""
    if not len(a) or not len(b):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _set_digest(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    value = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (value >> 64) - 2**63, (value & (2**64 - 1)) - 2**63


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (d1, d2) and registers (null for empty sets)."""

    @tidy
    def sign(batches):
        hasher = Hasher()
        for batch in slices(batches):
            n, d1, d2, regs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = hasher.shingles(text)
                a, b = _set_digest(s)
                n.append(len(s)), d1.append(a), d2.append(b)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "regs"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, id, size): one row for each band of each class."""
    per_doc = REGISTERS // BAND
    marks = np.arange(1, per_doc + 1, dtype=np.uint64) * _MULTIPLIER

    @tidy
    def band(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, per_doc)
            keys = _mix(_mix(regs) ^ marks).view(np.int64).ravel()
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), per_doc)
            sizes = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), per_doc)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), pa.array(sizes)], ["key", "id", "size"])

    return reps.select("id", "regs", "size").mapInArrow(band, "key long, id long, size long")


def _candidates(buckets: DataFrame) -> DataFrame:
    """(id, leader): each member with its most frequent and its smallest leader."""
    shared = buckets.where("id != leader").groupBy("id", "leader").agg(F.count("*").alias("n"))
    best = shared.groupBy("id").agg(F.max_by("leader", F.struct("n", "leader")).alias("often"), F.min("leader").alias("least"))
    return best.select("id", F.explode(F.array_distinct(F.array("often", "least"))).alias("leader"))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts (binary) of the named documents."""
    wanted = small(ids.distinct(), BROADCAST_IDS)
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(wanted, "id", "left_semi")


def _verify(pairs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Links (id, leader) among the candidate pairs.

    A leader's text goes once to each share of up to BLOCK of its members, next to theirs.
    """
    shares = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares"))
    dealt = pairs.join(shares, "leader").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
    members = texts.join(dealt, "id").select("leader", "share", "id", "text")
    leads = texts.withColumnRenamed("id", "leader").join(shares, "leader").select(
        "leader", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("leader").alias("id"), "text"
    )

    @tidy
    def check(batches):
        hasher, at, sets, lead = Hasher(), None, {}, []
        for batch in batches:
            found, leaders = [], []
            for leader, share, own, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (leader, share):
                    at, lead = (leader, share), []
                s = hasher.shingles(text)
                if not len(s):
                    continue
                if own == leader:  # sorted before the members
                    lead.append((s, registers(s)))
                    continue
                r = None
                for other, theirs in lead:
                    if min(len(s), len(other)) * DENOMINATOR < max(len(s), len(other)) * NUMERATOR:
                        continue
                    r = registers(s) if r is None else r
                    if estimate(r, theirs, len(s), len(other)) >= NUMERATOR / DENOMINATOR - SLACK and linked(s, other):
                        found.append(own), leaders.append(leader)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(leaders, pa.int64())], ["id", "leader"])

    together = leads.unionByName(members).withColumn("member", (F.col("id") != F.col("leader")).cast("int"))
    placed = together.repartition(parts, "leader", "share").sortWithinPartitions("leader", "share", "member", "id")
    return placed.select("leader", "share", "id", "text").mapInArrow(check, "id long, leader long")


def _search_blocks(buckets: DataFrame, labels: DataFrame, tested: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Links between components that are left together in a bucket."""
    named = (
        buckets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    )
    state = named.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("size"),
        F.max("id").alias("last"), F.min("id").alias("first"),
        # Buckets with the same members need one search.
        F.bit_xor(F.xxhash64("id")).alias("who"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("who2"),
    ).where("low != high")
    pairs = tested.select(F.col("leader").alias("first"), F.col("id").alias("last"), F.lit(2).cast("long").alias("n"))
    open_ = state.join(pairs, ["first", "last", "n"], "left_anti")
    once = open_.groupBy("who", "who2", "n").agg(F.min("key").alias("key"), F.any_value("size").alias("size")).select(
        "key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    dealt = named.join(once, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int"))
    # A row of block i meets the blocks j: tasks (min, max); one block: the single task (0, 0).
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "id"
    )
    with_text = spread.join(texts, "id")

    def search(rows):
        """Union-find over one task's rows; yields links that joined two components."""
        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        labels_ = [r[1] for r in rows]
        sets = [r[2] for r in rows]
        regs = np.stack([r[3] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        sizes = np.array([len(s) for s in sets])
        values, counts = np.unique(np.array(labels_), return_counts=True)
        largest = values[counts.argmax()]
        two = len({r[4] for r in rows}) > 1
        for x, label in enumerate(labels_):
            if label == largest:
                continue  # every pair with another component is seen from its other side
            others = np.array([find(v) for v in labels_]) != find(label)
            if two:  # pairs within a block are searched where it is alone
                others &= np.array([r[4] != rows[x][4] for r in rows])
            near = (regs[others] == regs[x]).mean(axis=1) >= NUMERATOR / DENOMINATOR - SLACK
            others[np.flatnonzero(others)[~near]] = False
            if not others.any():
                continue
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            hits = np.concatenate([owner[a:b] for a, b in zip(lo, hi)])
            common = np.bincount(hits, minlength=len(rows))
            good = others & (DENOMINATOR * common >= NUMERATOR * (sizes + sizes[x] - common))
            for y in np.flatnonzero(good):
                a, b = find(label), find(labels_[y])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    yield rows[x][0], rows[y][0]

    @tidy
    def blocks(batches):
        hasher, at, rows = Hasher(), None, []
        for batch in batches:
            left, right = [], []

            def close():
                if len({r[1] for r in rows}) > 1:
                    for a, b in search(rows):
                        left.append(a), right.append(b)
                rows.clear()

            for key, i, j, own, label, id_, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (key, i, j):
                    close()
                    at = (key, i, j)
                s = hasher.shingles(text)
                if len(s):
                    rows.append((id_, label, s, registers(s), own))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["id", "leader"])
        left, right = [], []
        if len({r[1] for r in rows}) > 1:
            for a, b in search(rows):
                left.append(a), right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["id", "leader"])

    placed = with_text.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return placed.select("key", "i", "j", "own", "label", "id", "text").mapInArrow(blocks, "id long, leader long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over the undirected edges (id, leader).

    Each round takes the least label among a node's neighbours and then that label's own
    label, so that distances halve; every round is a checkpointed table.
    """
    both = edges.select(F.col("id").alias("a"), F.col("leader").alias("b"))
    both = materialise(both.union(both.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("id"), "label").checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = step.join(jump, "label").select("id", "old", F.least("label", "far").alias("label")).checkpoint()
        if not moved.where("label < old").limit(1).count():
            return moved.select("id", "label")
        labels = moved.select("id", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept; one row per row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = materialise(signatures(docs))
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("id"), F.any_value("regs").alias("regs"), F.any_value("n_shingles").alias("size")
    )
    classes = materialise(classes)
    keyed = materialise(_bands(classes))
    leaders = keyed.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = materialise(keyed.join(leaders, "key"))
    pairs = materialise(_candidates(buckets))
    texts = materialise(_texts(docs, buckets.select("id")))
    first = materialise(_verify(pairs, texts, parts))
    labels = components(first)
    rest = _search_blocks(buckets.select("key", "id", "size"), labels, pairs, texts, parts)
    rest = materialise(rest)
    if rest.limit(1).count():
        labels = components(first.union(rest))
    of_class = classes.select("d1", "d2", "id").join(labels, "id", "left").select("d1", "d2", F.coalesce("label", "id").alias("component"))
    # Rows without a node of the graph meet no class.
    key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("d1")).alias("d1")
    out = signed.select("doc_id", "n_shingles", key, "d2").join(of_class, ["d1", "d2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
