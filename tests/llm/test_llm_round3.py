"""Spelling variants, source divergences and page texts against brute force on small tables."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusframe.llm import divergence, line_dedup, spans, spelling, style_tree

SCHEMA = "doc_id long, text string, lang string, source string, n long, word string, term string, bucket long, value long, `a.b` long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "w", "t", 2, 3, 4) for i, t, lang, s in rows], SCHEMA).repartition(3)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out, form = [], {}
    for w in n:
        around = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = (around[0] if around and n[around[0]] >= 10 * n[w] else None, len(around))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, n[w], form[w][1], form[w][0], n[form[w][0]] if form[w][0] else None, root))
    return sorted(out)


def variant_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aabaaaaa", "ÀÉÿ×÷abc", "zz" * 5 + "q", "zz" * 5 + "qz", "zz" * 6, "zz" * 6 + "q", "yx" * 10, "yx" * 9 + "y", "x" * 300, "x" * 299 + "y"]
    rows = []
    for i in range(60):
        words = [w for k, w in enumerate(base) for _ in range(rng.randint(0, 40) if k % 7 == 0 else rng.randint(0, 1))]
        words += [w[:j] + rng.choice("abq") + w[j + 1 :] for w in rng.sample(base, 5) for j in [rng.randrange(len(w))]] * 2
        rng.shuffle(words)
        rows.append((i, " ".join(words).title() if i % 3 else ", ".join(words), "en", "s"))
    return [*rows, rows[3], (None, rows[4][1], None, None), (70, None, "en", "s"), (71, "", "en", "s"), (72, "word İ中 " * 4, "en", "s"), (73, "l" * 70_000, "", ""), (73, "l" * 70_000, "", "")]


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 12)  # each letter below is a level
    rows = variant_rows()
    found = [tuple(r) for r in spelling.variants(table(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert sorted(found) == brute_variants(rows)


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(table(spark, [(1, "x", "a", "b")]).limit(0)).count() == 0


def test_both_searches_agree_on_words_of_any_length(spark):
    held = spelling.words(table(spark, variant_rows()))
    short = held.where("char_length(word) <= 12")
    pairs = lambda df: {frozenset(r) for r in df.collect()}
    assert pairs(spelling.trie_pairs(short)) == pairs(spelling.variant_pairs(short)) != set()


def brute_divergences(rows, least):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        others = sorted(s for g, s in groups if g == lang)
        c = {s: counts[lang, s] for s in others}
        total = {s: sum(c[s][t] for t in kept) for s in others}
        v, whole = len(kept), sum(total.values())
        p = lambda s, t: 1 + 10**9 * (c[s][t] + 2) // (total[s] + 2 * v)
        q = lambda t: 1 + 10**9 * (sum(c[s][t] for s in others) + 2) // (whole + 2 * v)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pair = sorted((-sum(f(p(source, t), p(s, t)) for t in kept), s.encode(), s) for s in others if s != source)
        term = sorted((-f(p(source, t), q(t)), t.encode(), t) for t in kept if c[source][t] and p(source, t) > q(t))[:10]
        for part, ranked in (("pair", pair), ("term", term)):
            out += [(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(ranked)]
    return sorted(out)


def test_divergences_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É漢", "é漢", "\U0001f600x", "￮x"]
    rows = []
    for i in range(90):
        source = rng.choice(["s1", "s2", "S3", None, "é"])
        picked = rng.choices(words, weights=[1 / (k + 1 + len(source or "") * 3) for k in range(len(words))], k=rng.randint(0, 80))
        rows.append((i, " ".join(picked).upper() if i % 2 else "-".join(picked), rng.choice(["en", "de", None]), source))
    rows += [rows[0], rows[0], (200, None, "fr", "s1"), (201, "", "fr", "s2"), (202, "only here", "it", "s1"), (203, "tie tie " * 30_000, "en", "s1")]
    monkeypatch.setattr(divergence, "SPILL", 50)
    monkeypatch.setattr(divergence, "BUCKET", 7)
    monkeypatch.setattr(divergence, "CELLS", 20)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    for least in (3, 10):
        found = [tuple(r) for r in divergence.divergences(table(spark, rows), least).select(*columns).collect()]
        assert sorted(found) == brute_divergences(rows, least)
    assert divergence.divergences(table(spark, rows).limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    import numpy as np

    rng = random.Random(1)
    for _ in range(500):
        total = rng.randrange(1, 10**14)
        count = rng.randrange(0, total + 1)
        assert int(divergence.share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 2) // total


PAGES = "page_id long, url string, html string, text string, host string, row long, low string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "h", 0, "l") for i, u, h in rows], PAGES).repartition(3)


def texts(df):
    return {(r.page_id, r.text, r.n_chars) for r in df.collect()}


def test_furniture_goes_and_the_article_stays(spark):
    cases = [
        (1, "<html><head><title>T</title></head><body><nav>menu</nav><div class=ad>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three<p><b>x</b>y<ul><li>i<li>j</ul></article><footer>f</footer>", "A & B\n\none two three\n\nxy\n\ni\n\nj"),
        (2, "<body><header><h1>Site</h1></header><main><h2>H</h2><p>p&nbsp;q &#233;&lt;b&gt;</p></main><aside>s</aside><section id=comments><p>c</p></section>", "H\n\np q é<b>"),
        (3, "<script>if (a<b) '</p>'</script><style>p{}</style><p>t</p><form>f<input></form><!-- <p>no</p> --><p hidden>h</p><div role='Banner'>b</div><p>a < b", "t\n\na < b"),
        (4, "plain text", "plain text"), (5, None, ""), (6, "", ""), (7, "<p></p> \n", ""), (8, "<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
        (9, "<p>a <span class='ad'>x</span> b</p>", "a\n\nb"), (10, "<div>" * 500 + "deep" + "</div>" * 500 + "end", "deep\n\nend"),
        (11, "<p>" + "word " * 200_000 + "</p>", ("word " * 200_000).strip()), (12, "<p>" + "<a \"" * 20_000, None), (13, "<a <b> x &amp;amp; </p> y", None),
    ]
    found = {i: t for i, t, n in texts(style_tree.extract(pages(spark, [(i, f"http://h{i}.org/x", h) for i, h, _ in cases])))}
    for i, _, expected in cases:
        assert expected is None or found[i] == expected, i
    assert found[13].endswith("x &amp; y")
    assert style_tree.extract(pages(spark, [(1, "u", "h")]).limit(0)).count() == 0


def site(rng, n, host):
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = []
    for i in range(n):
        text = [" ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(30)) for _ in range(3)]
        body = "<div class=x9><span>We value your visit</span> and <i>keep records</i></div>" + f"<div class=c1>{''.join(f'<p>{t}</p>' for t in text)}</div><div class=z><div class=y>Call us today<p>Open at nine</p></div></div>"
        rows.append((i, f"https://{host}/{i}", body, "\n\n".join(text)))
    return rows


@pytest.mark.parametrize("limit", [0, 10**6])
def test_the_tree_finds_what_a_site_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(style_tree, "LOW", limit)
    monkeypatch.setattr(style_tree, "COPIES", limit)
    rows = site(random.Random(1), 30, "one.example")
    lonely = [(100 + i, f"https://few{i}.example/", h) for i, _, h, _ in rows[:3]] + [(200 + i, None, h) for i, _, h, _ in rows]
    copies = [(300 + i, "https://copies.example/", rows[0][2]) for i in range(20)]
    result = style_tree.extract(pages(spark, [(i, u, h) for i, u, h, _ in rows] + [(0, rows[0][1], rows[0][2])] + lonely + copies))
    found = defaultdict(list)
    for r in result.collect():
        found[r.page_id].append(r)
    assert len(found[0]) == 2  # rows that repeat are both returned
    for i, _, _, text in rows:
        assert all(r.text == text and r.n_tree == 3 for r in found[i])
        assert found[200 + i][0].text.startswith("We value your visit and keep records\n\n")  # no host, no site
    assert all(found[100 + i][0].n_tree == 0 for i in range(3))
    assert all(found[300 + i][0].text.endswith("Open at nine") for i in range(20))  # copies are one page


def test_importance_equals_the_definition(spark):
    import math

    rows = [(i, "http://h.org/", f"<div class=a>common {'x' * (1 + i % 2)} word{i}</div>" + ("<div class=b>same</div>" if i % 4 else "")) for i in range(8)]
    tree = style_tree.importance(pages(spark, rows)).collect()
    leaf = sorted((r.m, r.importance) for r in tree if r.depth == 1)
    h = lambda counts, m: -sum(c / sum(counts) * math.log(c / sum(counts), m) for c in counts)
    content = 1 - (h([1] * 8, 8) + 2 * h([1] * 4, 8)) / 11
    assert [m for m, _ in leaf] == [6, 8] and leaf[0][1] == pytest.approx(0, abs=1e-8) and leaf[1][1] == pytest.approx(content, abs=1e-8)
    root = next(r for r in tree if r.depth == 0)
    children = (6 * 0 + 8 * content) / 14
    assert root.importance == pytest.approx((1 - 0.9**2) * h([6, 2], 8) + 0.9**2 * children, abs=1e-8)
    assert root.most == pytest.approx(max(root.importance, content), abs=1e-8)


def test_places_of_many_matches(spark):
    """10^5 matches in one text, in time that grows with their number, and the limits of a run."""
    texts = ["é10.0.0.1 " * n for n in (0, 1, 255, 256, 257, 513)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
    for r in rows.select("text", spans.spans(F.col("text"), pattern, "ip").alias("s")).collect():
        assert [(x.start, x.end) for x in r.s] == [m.span() for m in re.finditer(pattern, r.text or "")]
    long = spark.createDataFrame([("10.0.0.1 " * 100_000,)], "text string")
    began = time.time()
    row = long.select(spans.spans(F.col("text"), pattern, "ip").alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
    assert row.n == 100_000 and (row.last.start, row.last.end) == (899_991, 899_999) and time.time() - began < 20


def test_stages_keep_columns_of_any_name(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    others = ["n_lines", "n_dropped", "_h", "_doc", "_row", "h", "kept", "a.b", "word", "row"]
    wide = docs.select("*", *[F.when(F.rand() >= 0, i).alias(c) for i, c in enumerate(others)])
    wide = wide.union(wide.limit(1)).union(spark.createDataFrame([(None,) * len(wide.columns)], wide.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = {r.doc_id: r.text for r in stage(spark, wide.select(*docs.columns), folder).collect()}
        found = stage(spark, wide, folder)
        assert found.columns == wide.columns, name
        rows = found.collect()
        assert {r.doc_id: r.text for r in rows} == plain, name
        assert all([r[c] for c in others] == list(range(len(others))) for r in rows if r.doc_id is not None), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, folder).count() == wide.count()
    dropped = line_dedup.drop_boilerplate(wide, F.col("source"))
    assert sorted(dropped.columns) == sorted(wide.columns) and dropped.where("n_lines > 1").count() > 0


def test_elements_seen_before_are_not_hashed_again(monkeypatch):
    """Pages of a host share their elements; and a full cache changes no key."""
    page = "<html><body><nav class='menu'><ul><li>a<li>b</ul></nav><article><h1>t</h1><p>one</p><p>two</p></article></body></html>"
    known = {}
    first = style_tree._keyed("h", style_tree.parse(page)[0], known)
    monkeypatch.setattr(style_tree, "KNOWN", 0)
    assert style_tree._keyed("h", style_tree.parse(page)[0], dict(known)) == first
    monkeypatch.undo()
    monkeypatch.setattr(style_tree, "_hash", None)
    assert style_tree._keyed("h", style_tree.parse(page)[0], known) == first
