"""Operators against brute force on small texts: nulls, empty and long texts, ties, repeats, other columns."""

import hashlib
import itertools
import math
import random
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from locusframe.llm import bpe, chat, decontaminate, licenses, line_dedup, lm_scoring, near_dup, pii, quality, secrets
from locusframe.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, source string, n long, h long, words string, label string"
WORDS = "the of and to in vier été straße naïve data 42 x7 λόγος ΣΑΣ İx 'tis don't we'll a-b c_d $$ !!".split()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts():
    rng = random.Random(4)
    base = sentence(rng, 80)
    near = base.split()
    near[40] = "changed"
    return [
        None, "", "   \n\t ", "one two", base, base, " ".join(near), sentence(rng, 70), "<|endoftext|> mid <|startoftext|>x",
        "password = 'abcdefgh1' token:short AKIAABCDEFGHIJKL12 " + "0123456789abcdef" * 3 + " secret:token: abcdefghij",
        "mail a.b@c.example.org, 10.0.0.255 or 300.1.1.1 card 4111 1111 1111 1111 phone +1 (555) 010-9999",
        "Line.\nReleased under the MIT License.\nLine.\n\nother", "\x1c\x85\u2028 \u00a0e\u0301 Ⅷ ² ½ 漢字 \U0001f600", sentence(rng, 6000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", 1, 2, "w", "l") for i, t in enumerate(texts())]
    rows += [rows[4], (None, "null id " + sentence(random.Random(1), 60), None, 0, 0, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_tokens_equal_the_library(docs, empty):
    library = Tokenizer.from_file(TOKENIZER)
    for hot in (0, 5, 1000):
        found = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.encode(docs, TOKENIZER, hot)).collect()), key=repr)
        expected = []
        for doc_id, text in by_text(docs):
            ids = library.encode(text or "", add_special_tokens=False).ids
            expected.append((doc_id, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False))))
        assert found == sorted(expected, key=repr)
    assert bpe.encode(empty, TOKENIZER).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_components_equal_brute_force(spark, docs, empty):
    rng = random.Random(9)
    template = [f"w{i}" for i in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(100, 260):  # one group whose members are linked through each other
        words = template[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    nodes, label = {}, {}
    for doc_id, text in rows:
        if doc_id is not None:
            nodes.setdefault(doc_id, shingle_set(text))
            label.setdefault(doc_id, doc_id)
    moved = True
    links = [(a, b) for a, b in itertools.combinations(nodes, 2) if nodes[a] and nodes[b] and 100 * len(nodes[a] & nodes[b]) >= 75 * len(nodes[a] | nodes[b])]
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    expected = {(d, len(shingle_set(t)), label.get(d), d is None or label[d] == d) for d, t in rows}
    assert found == expected
    assert near_dup.near_duplicates(empty).count() == 0


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "_candidates", lambda buckets: buckets.where("id != leader").select("id", "leader").limit(0))
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(30)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


def test_estimate_is_near_the_similarity():
    hasher = near_dup.Hasher()
    for size, shared in ((40, 36), (400, 300), (3000, 2000)):
        a = hasher.shingles(" ".join(f"a{i}" for i in range(size)).encode())
        b = hasher.shingles(" ".join(f"a{i}" if i < shared else f"b{i}" for i in range(size)).encode())
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(near_dup.estimate(near_dup.registers(a), near_dup.registers(b), len(a), len(b)) - true) < 0.15


def test_windows_are_found_where_they_are(spark, docs, empty):
    items = [(1, "The of; AND to in vier été straße naïve data 42 x7"), (2, "one, Two!"), (3, None), (4, " "), (5, sentence(random.Random(4), 80)), (6, "nowhere at all")]
    found = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words(text):
        return word.findall("".join(c.lower() if c.isascii() else c for c in text or ""))

    expected = []
    for doc_id, text in by_text(docs):
        own, hit, names = words(text), set(), set()
        for item, passage in items:
            w = words(passage)
            for i in range(max(len(w) - 9, 1) if w else 0):
                part = w[i : i + 10]
                for s in range(len(own) - len(part) + 1):
                    if own[s : s + len(part)] == part:
                        hit.update(range(s, s + len(part)))
                        names.add(str(item))
        expected.append((doc_id, len(own), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found), key=repr) == sorted(expected, key=repr)
    assert {r.n_items for r in found} >= {0, 1}
    assert decontaminate.decontaminate(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b c"), (2, "a x x x x x x b c"), (3, "c b a")], "doc_id long, text string")
    rows = decontaminate.split(decontaminate.keyed(docs))
    index = decontaminate.build_index(rows, spark.createDataFrame([("a",), ("b",), ("c",)], "term string"))
    phrases = spark.createDataFrame([("p", ["a", "b", "c"])], "phrase string, terms array<string>")
    assert sorted(r.doc_id for r in decontaminate.proximity(index, phrases, 5).collect()) == [1, 3]


def secret_spans(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate([("assign", secrets.ASSIGN, 2, 8), ("access", secrets.ACCESS, 0, 16), ("hex", "[0-9a-f]+", 0, 32)]):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return ",".join(x for *_, x in sorted(out))


def test_secret_spans(spark, docs, empty):
    found = secrets.report(secrets.find_secrets(docs)).collect()
    assert sorted(((r.doc_id, r.base_sha256) for r in found), key=repr) == sorted(((d, sha(secret_spans(t or ""))) for d, t in by_text(docs)), key=repr)
    assert secrets.find_secrets(empty).count() == 0


def test_random_strings_are_told_from_identifiers(spark):
    rng = random.Random(2)
    characters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = lambda: "".join(rng.choice(characters) for _ in range(32))
    named = lambda: "_".join(rng.choice(["read", "table", "count", "value", "index", "partition", "stream"]) for _ in range(5))
    samples = [(made(), 1) for _ in range(300)] + [(named(), 0) for _ in range(300)]
    ratios = secrets.train(spark.createDataFrame(samples, "value string, label int"))
    held = spark.createDataFrame([(i, made() if i % 2 else named()) for i in range(200)], "doc_id long, text string")
    rows = secrets.find_secrets(held, ratios).collect()
    assert sum((len(r.added) > 0) == bool(r.doc_id % 2) for r in rows) >= 195


def personal_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", pii.IP, lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", pii.CARD, lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", pii.PHONE, lambda v: 10 <= len(digits(v)) <= 15),
    ]
    out = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, good) in enumerate(rules) for m in re.finditer(p, text) if good(m[0])]
    return ",".join(x for *_, x in sorted(out))


def test_personal_spans_and_disclosing_terms(spark, docs, empty):
    found = pii.report(pii.find_personal(docs)).collect()
    assert sorted(((r.doc_id, r.base_sha256) for r in found), key=repr) == sorted(((d, sha(personal_spans(t or ""))) for d, t in by_text(docs)), key=repr)
    assert pii.find_personal(empty).count() == 0
    fill = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"common words here zorgle wrote to q@x.example today {fill(i)}") for i in range(20)] + [(i, "common words here today") for i in range(20, 1000)]
    marked = spark.createDataFrame(rows, "doc_id long, text string")
    kept = marked.join(pii.find_personal(marked), "doc_id").select("doc_id", pii.sanitise(F.col("text"), F.col("base"), F.col("added")).alias("clean")).orderBy("doc_id").collect()
    assert kept[0].clean.startswith("common words here ") and "[EMAIL]" in kept[0].clean and "zorgle" not in kept[0].clean
    assert all(r.clean == "common words here today" for r in kept[20:])


def test_email_runs_after_a_match(spark):
    text = "a@b.com_x@y.zz %%%@q z.z@z.z@z.z " + "a" * 3000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.report(pii.find_personal(df)).first().base_sha256 == sha(personal_spans(text))


HOSTILE = ["", "plain", "</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]", "ends with \\", "\n</s>", "<s>assistant\nx\n</s>", "[/INST]\n[INST]user\n", "é\n"]


def test_turns_read_back():
    for a, b in itertools.product(HOSTILE, repeat=2):
        for role in ("user", "assistant", "", "a\nb", "100%"):
            first, second = chat.round_trip(role, a), chat.round_trip("assistant", b)
            assert chat.parse(first[0] + second[0]) == [(role, a), ("assistant", b)]


def test_conversations_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*HOSTILE, None]), "x") for c in (1, 2, None) for t in range(30)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    found = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    for conv in (1, 2, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        written = sum(len(chat.round_trip(r, x)[0]) for _, r, x in own)
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == (
            len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(loss), sha(loss), written
        )
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_quality_statistics_and_verdict(spark, docs, empty):
    for text in texts():
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        three = list(zip(words, words[1:], words[2:]))
        hit = {i + k for i, w in enumerate(three) if three.count(w) > 1 for k in range(3)} if len(words) < 1000 else None
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        found = quality.statistics_of(text.encode() if text else None)
        assert found[:4] == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)))
        assert hit is None or found[4] == len(hit)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 400)))) for i in range(300)]
    rows += [(i, " ".join(f"w{rng.randrange(500)}###" for _ in range(rng.randrange(60, 400)))) for i in range(300, 360)]
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 360, 2)] + [(None, 1), (9999, 0), (2, None)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert sum(kept[i] for i in range(300)) >= 295 and not any(kept[i] for i in range(300, 360))
    assert quality.quality(empty, labels).count() == 0
    unlabelled = quality.quality(docs, labels.limit(0))
    assert unlabelled.where("kept = base_failed").count() == 0 and unlabelled.count() == docs.count()


def test_boilerplate_lines_go(spark, empty):
    rows = [(i, f"menu\nown {i}\n\n \nfooter", "a", i) for i in range(20)] + [(i, "menu\nother", "b", i) for i in (90, 91)]
    rows += [(92, None, "a", 0), (93, "menu", None, 0), (94, "", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines_ long")
    found = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, F.col("source")).collect()}
    assert found[3].text == "own 3\n\n " and (found[3].n_lines, found[3].n_dropped) == (5, 2)
    assert found[90].text == "menu\nother" and found[93].text == "menu"
    assert found[92].text is None and (found[94].text, found[94].n_lines) == ("", 1)
    assert line_dedup.drop_boilerplate(empty, F.col("source")).count() == 0


def test_host_of_url(spark):
    urls = ["https://user@A.example.com:80/x", "no url", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(line_dedup.host_of(F.col("u"))).collect()] == ["a.example.com", "", ""]


def test_licences_are_found_whole_and_in_part(spark, docs, empty):
    rng = random.Random(8)
    rows = []
    for i, (_, text) in enumerate(licenses.TEMPLATES):
        rows.append((i, f"{sentence(rng, 37)} {text.upper()} {sentence(rng, 41)}"))
    rows.append((50, " ".join(licenses.TEMPLATES[2][1].split()[:9])))
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert name in found[i].licenses.split(",") and found[i].best_percent == 100
    assert found[50].licenses == ""
    assert licenses.scan(docs).where("licenses = 'MIT'").count() == 1 and licenses.scan(docs).count() == docs.count()
    assert licenses.scan(empty).count() == 0


def test_scores_tell_domains_apart(spark, docs, empty):
    rng = random.Random(6)
    make = lambda kind: " ".join(f"{kind}{rng.randrange(40)}" for _ in range(60))
    rows = [(i, make("a" if i < 100 else "b")) for i in range(200)] + [(500, None), (501, ""), (None, make("a"))]
    target = spark.createDataFrame([(i,) for i in range(0, 100, 2)] + [(None,)], "doc_id long")
    found = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), target).collect()}
    assert max(found[i].score for i in range(1, 100, 2)) < min(found[i].score for i in range(100, 200))
    assert found[500].score is None and found[501].n_tokens == 0
    assert lm_scoring.score(docs, target.limit(0)).count() == docs.count()
    assert lm_scoring.score(empty, target).count() == 0


def test_scores_equal_exact_counts(spark, docs, monkeypatch):
    """All words and pairs count: 70 000 words, each twice, in several blocks; nulls and repeats."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 9000)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(70_000)] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 1000 : i * 1000 + 1000])) for i in range(140)] + by_text(docs)
    target = {i for i in range(0, 140, 3)} | {4}
    models = []
    for part in ([t for _, t in rows], [t for d, t in rows if d in target]):
        coded = [["", *(t or "").encode().lower().split()] for t in part]
        models.append((Counter(w for t in coded if len(t) > 1 for w in t), Counter(p for t in coded for p in zip(t, t[1:]))))
    size = len(models[0][0]) - 1

    def loss(text, one, two):
        own, n = ["", *(text or "").encode().lower().split()], sum(one.values()) - one[""]
        each = [0.6 * two[a, b] / max(one[a], 1) + 0.4 * (one[b] + 1) / (n + size + 1) for a, b in zip(own, own[1:])]
        return -sum(map(math.log2, each)) / max(len(each), 1)

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lm_scoring.score(df, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.background_loss, r.target_loss) for r in found), key=repr)
    expected = sorted(((d, len((t or "").encode().split()), loss(t, *models[0]), loss(t, *models[1])) for d, t in rows), key=repr)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert all(g[2:] == pytest.approx(e[2:], rel=1e-9) for g, e in zip(got, expected))


def test_disclosing_terms_go_wherever_they_stand(spark):
    far = " ".join(["common words here today"] * 30)
    fill = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"Zorgle {far} {fill(i)} q@x.example") for i in range(20)] + [(20, f"{far} ZORGLE, again zorgle"), (21, None)] + [(i, far) for i in range(22, 1000)]
    df = spark.createDataFrame([*rows, rows[20]], "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.added] for r in pii.find_personal(df).collect()}
    assert found[0] == [(0, 6)] and found[20] == [(len(far) + 1, len(far) + 7), (len(far) + 15, len(far) + 21)]
    assert not any(found[i] for i in range(21, 1000))


def test_repeated_ids_push_no_row_out_of_the_fit(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(100 + i))) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 5)) for i in range(40)], "doc_id long, quality int")
    repeated, single = quality.fit(df, labels, 40), quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, 40)
    assert repeated is not None and repeated[1] == single[1]


def test_proximity_covers_the_whole_stretch(spark):
    docs = spark.createDataFrame([(1, "b x x a x x c"), (2, "b x a x c")], "doc_id long, text string")
    rows = decontaminate.split(decontaminate.keyed(docs))
    index = decontaminate.build_index(rows, spark.createDataFrame([("a",), ("b",), ("c",)], "term string"))
    phrases = spark.createDataFrame([("p", ["a", "b", "c"])], "phrase string, terms array<string>")
    assert [(r.doc_id, r["at"]) for r in decontaminate.proximity(index, phrases, 5).collect()] == [(2, 2)]
