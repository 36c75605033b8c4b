"""BPE encoding and decoding through a table of distinct words.

1.  Texts are normalised and split into words as the tokenizer file says. Each distinct word is
    encoded once; where its ids are kept depends on how frequent it is.
2.  The most frequent words, `HOT_WORDS` at most, are the part of the table that travels to the
    tasks. They are counted in a sample of about `SAMPLED` documents, chosen by hash. The sample
    decides where a word is looked up, never what comes out. There a text becomes a packed list
    of ranks, with gaps for other words.
3.  All occurrences of the other words, with their positions, are brought together by word; each
    word is encoded where its occurrences meet, and its ids go back to their text by document
    and position, next to the packed ranks.
4.  Ids of a text are the ids of its words in order; pieces come from the id-to-piece table of
    the tokenizer file (bounded by the file) and decoding joins them.

Nulls and ties: a null text is encoded as the empty one: no ids. A null doc_id is a document
like others. Rows that repeat (doc_id, text) are each returned. Strings of special tokens inside
a text become their ids, as in the library. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import digest, give_back, prepare, slices, tidy

#: Words that travel to every task: about 25 MB with their ids.
HOT_WORDS = 1 << 18
#: Documents, about, in which frequent words are counted.
SAMPLED = 40_000
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 150_000
#: Letters, digits and signs up to U+024F, and common punctuation: here the pattern of the file, with Unicode
#: classes of any version, and NFC and lower-casing of any library give the same words.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa0-įĲ-ɏ‐-‧‰-⁞€]*")
_WORDS = re.compile(r"[^\W\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
#: The same words of lower-cased Latin-1 texts, by explicit ranges of letters.
_LATIN_WORDS = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^a-z0-9\s²³¹¼-¾ªµºß-öø-ÿ]+")


def _tokenizer(path: str):
    """The tokenizer of the file, on the one thread that Spark gives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _latin(text: str) -> bool:
    """Whether a text is plain because it has Latin-1 characters and no controls but newlines."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return text.replace("\n", "").isprintable()


class Splitter:
    """Normalised words of a text; special tokens inside a text come as ids."""

    def __init__(self, path: str):
        tokenizer = _tokenizer(path)
        # Not the vocabulary: it would be held for as long as the task runs.
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        del tokenizer
        give_back()

    def words(self, text: str | None) -> list[str | int]:
        if not text:
            return []
        if self.cut is None or "<|" not in text or not self.cut.search(text):
            return self._plain(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if _latin(text):
            return _LATIN_WORDS.findall(text.lower())
        if _PLAIN.fullmatch(text):
            return _WORDS.findall(text.lower())
        normal = self.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(normal)]


class WordEncoder:
    """Ids of single words, without normalising or splitting them again."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.tokenizer = _tokenizer(path)
        self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.encode_special_tokens = True

    def __call__(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


def _key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text", F.lit(4)).alias("h"), "text")


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) over all texts of `docs`."""

    @tidy
    def count(batches):
        splitter, counts = Splitter(path), Counter()

        def flush():
            keys = [w for w in counts if isinstance(w, str)]
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(splitter.words(text))
                if len(counts) > COUNTED:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hot_words(docs: DataFrame, path: str, words: int = HOT_WORDS) -> tuple[list[str], list[bytes]]:
    """At most `words` of the most frequent words of a sample (all above a count that a histogram gives), and their ids."""
    share = max(1, docs.count() // SAMPLED)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0) if share > 1 else docs
    counts = word_counts(sample, path).where((F.col("n") > 1) & ~F.contains("word", F.lit("\n"))).checkpoint()
    step = F.floor(F.log2("n") * 16)
    histogram = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # 1 024 rows at most
    total, cut = 0, None
    for row in sorted(histogram, key=lambda r: -r.step):
        total += row.words
        if total > words:
            break
        cut = row.step
    if cut is None:
        return [], []

    @tidy
    def encode(batches):
        encoder = WordEncoder(path)
        for batch in batches:
            ids = encoder(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    table = counts.where(step >= cut).mapInArrow(encode, "word string, n long, ids binary").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return table.column("word").to_pylist(), table.column("ids").to_pylist()


class Ranker:
    """Words of a text as ranks: frequent words, the gap, then special tokens by id."""

    def __init__(self, path: str, frequent: str):
        """frequent: words, the most frequent first, a line each."""
        self.split = Splitter(path).words
        self.ranks = {w: i for i, w in enumerate(frequent.split("\n") if frequent else ())}
        self.gap = len(self.ranks)

    def __call__(self, text: str | None) -> tuple[list, np.ndarray]:
        words = self.split(text)
        codes = np.fromiter(map(self.ranks.get, words, repeat(self.gap)), np.uint32, len(words))
        if text and "<|" in text:
            for i, w in enumerate(words):
                if isinstance(w, int):
                    codes[i] = self.gap + 1 + w
        return words, codes


def pack(codes: np.ndarray) -> bytes:
    """Codes as bytes of equal weight side by side, Huffman-coded."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    planes = codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()  # ranks stay below 2**24
    return squeeze.compress(planes) + squeeze.flush()


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed, -15), np.uint8).reshape(3, -1).astype(np.uint32)
    return planes[0] | (planes[1] << np.uint32(8)) | (planes[2] << np.uint32(16))


def _packed(docs: DataFrame, path: str, hot) -> DataFrame:
    """(doc_id, h, packed)."""

    @tidy
    def rank(batches):
        ranker = Ranker(path, hot.value)
        for batch in slices(batches):
            packed = [pack(ranker(text)[1]) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "h", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _key(docs).mapInArrow(rank, f"doc_id {kind}, h long, packed binary")


def _filled(docs: DataFrame, path: str, hot) -> DataFrame:
    """(doc_id, h, filled): for each gap, in any order, its number among the words and its ids, as bytes."""
    spark = docs.sparkSession

    @tidy
    def others(batches):
        ranker = Ranker(path, hot.value)
        for batch in slices(batches):
            rows, at, words = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                all_words, codes = ranker(text)
                gaps = np.flatnonzero(codes == ranker.gap)
                rows.append(np.full(len(gaps), row)), at.append(gaps)
                words += [all_words[i] for i in gaps]
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(at).astype(np.int32)), pa.array(words, pa.string())],
                ["doc_id", "h", "at", "word"],
            )

    @tidy
    def encode(batches):
        encoder, known = WordEncoder(path), {}
        for batch in batches:
            words = batch.column(3).to_pylist()
            if len(known) > 20_000:  # sorted by word: those before will not come again
                known.clear()
            new = list({w for w in words if w not in known})
            known.update(zip(new, encoder(new)))
            filled = [struct.pack("<I", at) + known[w] for at, w in zip(batch.column(2).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(filled, pa.binary())], ["doc_id", "h", "filled"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = _key(docs).mapInArrow(others, f"doc_id {kind}, h long, at int, word string")
    coded = rest.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(encode, f"doc_id {kind}, h long, filled binary")
    # Repeated rows have the same words at the same places: one of each is enough.
    return coded.groupBy("doc_id", "h").agg(F.collect_set("filled").alias("filled"))


def encode(docs: DataFrame, path: str, hot_size: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded; one row per row of docs."""
    prepare(docs.sparkSession)
    words, ids = hot_words(docs, path, hot_size)
    own = _tokenizer(path)
    size = own.get_vocab_size(with_added_tokens=True)
    # In two parts: no task needs both.
    hot = docs.sparkSession.sparkContext.broadcast("\n".join(words))
    tables = docs.sparkSession.sparkContext.broadcast((ids, [own.id_to_token(i) or "" for i in range(size)]))
    del own, words, ids
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    both = _packed(docs, path, hot).alias("a").join(_filled(docs, path, hot).alias("b"), same, "left").select("a.doc_id", "a.packed", "b.filled")

    @tidy
    def assemble(batches):
        ids, piece = tables.value
        gap = len(ids)
        ids_of = [*ids, b"", *(struct.pack("<I", i) for i in range(len(piece)))]
        for batch in slices(batches, 200):
            n, ids, decoded = [], [], []
            for packed, filled in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                codes = unpack(packed).tolist()
                parts = [ids_of[c] for c in codes]
                for found in filled or ():
                    at = int.from_bytes(found[:4], "little")
                    assert codes[at] == gap, "ids for a word that was no gap"
                    parts[at] = found[4:]
                encoded = b"".join(parts)
                numbers = np.frombuffer(encoded, "<u4")
                n.append(len(numbers)), ids.append(encoded), decoded.append(" ".join([piece[i] for i in numbers.tolist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(assemble, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def id_list(ids: bytes) -> list[int]:
    """Packed ids as numbers."""
    return np.frombuffer(ids, "<u4").tolist()


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of ids and decoded text."""
    return encoded.select("doc_id", "n_tokens", digest(F.col("ids")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
