"""Personal data: fixed patterns, and terms that disclose what the patterns protect.

Information-theoretic sanitisation. A value found by a pattern is a protected entity e. A term t
(three or more letters or digits, lower-cased) co-occurs with e in every document that holds
both, t neither in nor next to a protected span. Over the N documents of the corpus,

    PMI(t; e) = log(N n(t, e) / (n(t) n(e)))        IC(e) = log(N / n(e))

where n counts documents. A term discloses e if the lower confidence bound of its PMI, with
n(t, e) - `Z` sqrt(n(t, e)) in place of n(t, e), is at least `ALPHA` * IC: knowing t then tells that
share of what e itself would tell. That takes several independent documents. Copies are
none: documents that share an entity and one of `BANDS` bands of `BAND` minhashes of their terms are
joined, with whatever these are joined to, and a group counts as one document, its one of least key;
documents with four fifths of their terms in common miss each other with probability 0.002, less in larger groups.
Every mention of a disclosing term, in any document, becomes a span of kind `term`; in the
sanitised text it is removed if the term tells all of some entity (PMI >= IC), else generalised to
[word] or [number]. All steps are built-in functions. Entities and terms are counted by 64-bit
hashes and summed before each exchange, so that a frequent one is a row a task.

Nulls and ties: a null text is empty. Rows that repeat a document are copies of it; each is
returned, with the same spans. A null doc_id is a document like others. Terms that overlap a
protected span are no spans. An empty table gives no rows. A very long text costs n log n in its
words and stays one row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import digest, small
from locusframe.llm.spans import SPAN, apart, joined, of_kind, ordered, spans
from locusframe.session import materialise

# The patterns of the base kinds. The look-behind keeps a failed run from being tried at each of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "term"]
WORD = r"[\p{L}\p{N}]{3,}"
ALPHA = 0.8
#: Standard deviations by which a count of co-occurrences is lowered.
Z = 1.645
BANDS, BAND = 12, 4
#: Rows of two or three numbers that may travel to every task.
BROADCAST_ROWS = 500_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    each = F.transform(F.reverse(F.split(digits, "", -1)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2).cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base_spans(text: Column) -> Column:
    small_parts = lambda v: F.forall(F.split(v, r"\.", -1), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    length = lambda s: F.char_length(_digits(s["value"]))
    # An @ and a + are rarer than the patterns are slow.
    none = F.array().cast(SPAN)
    email = F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, "email")).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE, "phone"), lambda s: length(s).between(10, 15))).otherwise(none)
    ip = F.filter(spans(text, IP, "ip"), lambda s: small_parts(s["value"]))
    card = F.filter(spans(text, CARD, "card"), lambda s: length(s).between(14, 19) & luhn(_digits(s["value"])))
    return F.concat(email, ip, F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), card).otherwise(none), phone)


def _hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _hashes(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.filter(F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+", -1)), lambda w: F.char_length(w) >= 3)
    return F.array_distinct(F.transform(words, _hash))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): h tells rows of one doc_id with different texts apart."""
    return docs.select("doc_id", F.xxhash64("text", F.lit(6)).alias("h"), "text")


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.h") == F.col(f"{right}.h"))


def located(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, h, row, base, entities, terms, hidden): documents with protected spans.

    row: one number for doc_id and text. Hashes of entities, of terms that touch no span, and of those that all do.
    """
    rows = _keyed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("base", base_spans(F.col("text"))).where("size(base) > 0")
    rows = rows.withColumn("words", spans(F.col("text"), WORD, "term"))
    hashes = lambda found: F.array_distinct(F.transform(found, lambda s: _hash(s["value"])))
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    rows = rows.select(
        "doc_id", "h", F.xxhash64("doc_id", "h").alias("row"), "base", entities.alias("entities"),
        hashes(F.col("words")).alias("every"), hashes(apart(F.col("words"), F.col("base"), touching=True)).alias("terms"),
    )
    return materialise(rows.select("doc_id", "h", "row", "base", "entities", "terms", F.array_except("every", "terms").alias("hidden")))


def copies(found: DataFrame) -> DataFrame:
    """Stored (row): documents of `found` that are copies of one with a lesser key, through any chain."""
    least = lambda i: F.array_min(F.transform("terms", lambda t: F.xxhash64(t, F.lit(i))))
    bands = F.array(*[F.xxhash64(F.lit(b), *[least(b * BAND + i) for i in range(BAND)]) for b in range(BANDS)])
    sketched = found.where("size(terms) > 0").select("row", "entities", bands.alias("bands"))
    keys = sketched.select("row", F.explode("bands").alias("band"), "entities").select("row", "band", F.explode("entities").alias("entity"))
    keys = materialise(keys.select("row", F.xxhash64("band", "entity").alias("key")).distinct())
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    links = materialise(keys.join(shared, "key"))
    labels = materialise(links.select("row").distinct().withColumn("label", F.col("row")))
    # The least row of a group spreads by one link and back a round.
    while True:
        met = links.join(labels, "row").groupBy("key").agg(F.min("label").alias("label"))
        after = links.join(met, "key").groupBy("row").agg(F.min("label").alias("lower"))
        labels = materialise(labels.select("row", F.col("label").alias("before")).join(after, "row").select("row", F.col("lower").alias("label"), (F.col("lower") < F.col("before")).alias("moved")))
        if labels.where("moved").isEmpty():
            break
    return materialise(labels.where("label < row").select("row"))


def disclosing(docs: DataFrame, found: DataFrame, alpha: float = ALPHA, z: float = Z) -> DataFrame:
    """(term, share): hashes of terms whose PMI with an entity is at least `alpha` of its IC; share is the highest PMI / IC."""
    repeated = copies(found).withColumn("copy", F.lit(True))
    apart_ = materialise(found.join(repeated, "row", "left").withColumn("copy", F.coalesce("copy", F.lit(False))).select("row", "entities", "terms", "hidden", "copy"))
    # Rows that repeat a document have its key; one of them stays.
    single = materialise(apart_.where("NOT copy").dropDuplicates(["row"]))
    total = float(docs.count() - found.count() + single.count())
    # No count of two or less has a positive lower bound at the usual Z.
    n_e = materialise(single.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") > z * z))
    met = single.select(F.explode("entities").alias("entity"), "terms").join(small(n_e.select("entity"), BROADCAST_ROWS), "entity")
    n_te = met.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") > z * z)
    information = F.log(F.lit(total) / F.col("n_e"))
    pmi = lambda n_te, n_t: F.log(F.lit(total) * n_te / n_t / F.col("n_e"))
    lowered = F.col("n_te") - z * F.sqrt("n_te")
    # A term is in no fewer documents than it shares with the entity: what fails even then is left out at once.
    pairs = materialise(n_te.join(n_e, "entity").where((information > 0) & (pmi(lowered, F.col("n_te")) >= alpha * information)))
    asked = small(materialise(pairs.select("term").distinct()), BROADCAST_ROWS)
    words = docs.select(F.explode(_hashes(F.col("text"))).alias("term"), F.lit(1).alias("n"))
    words = words.unionByName(apart_.select(F.explode("hidden").alias("term"), F.lit(-1).alias("n")))
    words = words.unionByName(apart_.select(F.explode("terms").alias("term"), F.lit(-1).alias("n")))
    words = words.unionByName(single.select(F.explode("terms").alias("term"), F.lit(1).alias("n")))
    n_t = words.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))
    tells = pairs.join(n_t, "term").where(pmi(lowered, F.col("n_t")) >= alpha * information)
    return tells.groupBy("term").agg(F.max(pmi(F.col("n_te"), F.col("n_t")) / information).alias("share"))


def mentions(docs: DataFrame, tells: DataFrame) -> DataFrame:
    """(doc_id, h, spans): every mention of a term of `tells`; value: remove or generalise."""
    keyed = _keyed(docs)
    hits = keyed.select("doc_id", "h", F.explode(_hashes(F.col("text"))).alias("term")).join(tells, "term").select("doc_id", "h").distinct()
    hits = small(materialise(hits), BROADCAST_ROWS)
    texts = keyed.alias("a").join(hits.alias("b"), _same("a", "b"), "left_semi").dropDuplicates(["doc_id", "h"])
    words = texts.select("doc_id", "h", F.explode(spans(F.col("text"), WORD, "term")).alias("s"))
    places = words.withColumn("term", _hash(F.col("s.value"))).join(tells, "term").select("doc_id", "h", F.struct(
        F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"),
        F.when(F.col("share") >= 1, "remove").otherwise("generalise").alias("value"),
    ).alias("s"))
    return places.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("s")).cast(SPAN).alias("spans"))


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, h, base and added spans (value of an added span: remove or generalise); one row per row of docs."""
    found = located(docs)
    tells = small(materialise(disclosing(docs, found)), BROADCAST_ROWS)
    marked = materialise(mentions(docs, tells))
    once = found.select("doc_id", "h", "base").dropDuplicates(["doc_id", "h"])
    none = F.array().cast(SPAN)
    both = once.alias("a").join(marked.alias("b"), _same("a", "b"), "full").select(
        F.when(F.col("a.h").isNull(), F.col("b.doc_id")).otherwise(F.col("a.doc_id")).alias("doc_id"), F.coalesce("a.h", "b.h").alias("h"),
        F.coalesce("a.base", none).alias("base"), F.coalesce("b.spans", none).alias("spans"),
    )
    both = materialise(both.select("doc_id", "h", "base", apart(F.col("spans"), F.col("base")).alias("added")))
    # Findings have any length, so that whether they are broadcast is left to their measured size.
    return _keyed(docs).drop("text").alias("a").join(both.alias("b"), _same("a", "b"), "left").select(
        "a.doc_id", "a.h", F.coalesce("b.base", none).alias("base"), F.coalesce("b.added", none).alias("added")
    )


def sanitise(text: Column, base: Column, added: Column) -> Column:
    """Text with spans replaced: [EMAIL] and the like; terms removed or generalised.

    Where patterns overlap, the later span is cut from what the earlier one left.
    """
    every = ordered(F.concat(base, added), KINDS)
    text = F.coalesce(text, F.lit(""))
    action = F.map_from_arrays(F.transform(added, lambda s: s["start"]), F.transform(added, lambda s: s["value"]))
    word = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    general = lambda s: F.when(word(s).rlike(r"^\p{N}+$"), "[number]").otherwise("[word]")
    instead = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(action[s["start"]] == "remove", "").otherwise(general(s))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        every, start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(s["end"] > acc["at"], instead(s)).otherwise("")).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans."""
    count = [of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select(
        "doc_id", *count, F.size("added").cast("long").alias("n_term"),
        digest(joined(F.col("base"), KINDS)).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"),
    )
