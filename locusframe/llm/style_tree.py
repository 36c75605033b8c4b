"""Main text of web pages by the style tree of their site.

The pages of a host are merged into one tree of elements. An element is its path of tags with their
classes, ids and roles; siblings of one look are one element, and the sequences of looks its children
come in (repeats run together) are its presentation styles. Importance is by entropy over the m pages
that show an element: of its content 1 - mean H(word), where H is the entropy, to base m, of a word's
spread over the pages (1 if it stands equally on all of them, 0 if on one); of its presentation the
entropy of its styles. An element with children combines its presentation with the importance of
the children, (1 - g^l) * presentation + g^l * children, l styles, from the leaves up. A branch is
noise if it and all that lies below stay under a threshold, and its text goes from every page.

A tree can judge only what several pages show. Branches whose tag, role or class says what they are
(menus, forms, comments, adverts: the fixed lists below) therefore go whatever their importance, as
do scripts, styles and the like; within an element marked as the article a branch must be the same
on practically all pages to go. Pages of one host with the same article (or, where none is marked,
the same text outside scripts, menus and the like) count as one page, a host without a name is no
site, and elements on fewer than `MIN_PAGES` pages have importance 1.

A null or empty html gives ''. Rows that repeat are returned as often. A page of any length is parsed
whole in one pass; elements deeper than DEPTH count as their ancestor there, with their text. An
empty table gives no rows. Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import prepare, slices, small, tidy, within
from locusframe.llm.line_dedup import host_of
from locusframe.session import materialise

#: Importance under which a branch is noise, and under which one within a marked article is.
NOISE, ARTICLE_NOISE = 0.5, 0.1
#: Damping of presentation against children, by style (the g above).
DAMPING = 0.9
MIN_PAGES = 6
#: Levels of the tree.
DEPTH = 24
#: (element, word) entries a task holds before it passes them on.
HELD = 400_000
#: Hashes of elements and styles a task keeps for the pages that follow; a style of many looks is not kept.
KNOWN = 50_000
#: Groups of copies (16 bytes each), and noise elements (9 bytes), that may travel to the tasks; more are joined by shuffle.
COPIES, LOW = 2_000_000, 2_000_000

# Names of HTML, and names that pages give to what is not their article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe object svg math xmp noembed noframes canvas audio video select".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr td th".split()
)
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
)
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
LISTS = {"ul", "ol", "menu", "dl", "table"}
NOISE_TAGS = set("nav footer aside form button dialog menu search head input".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NOISE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs masthead topbar header footer sidebar widget widgets comment "
    "comments respond replies disqus newsletter subscribe subscription signup login share sharing social related recommended pagination "
    "pager toolbar disclaimer".split()
)
MAIN_TAGS = {"article", "main"}

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/><]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Node:
    """An element of a page: its look, place in the tree, own words, and whether its names or tag call it noise."""

    __slots__ = ("tag", "look", "parent", "depth", "noise", "main", "children", "key")

    def __init__(self, tag, look, parent, noise, main):
        self.tag, self.look, self.parent, self.noise, self.main = tag, look, parent, noise, main
        self.depth = parent.depth + 1 if parent else 0
        self.children, self.key = [], 0


def _named(tag: str, attributes: dict, main: bool) -> bool:
    if tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes:
        return True
    if tag == "header":
        return not main
    if tag in ("html", "body", "main"):
        return False
    for words in (attributes.get("class", ""), attributes.get("id", "")):
        for name in words.lower().split():
            parts = _NAME.findall(name)
            if len(parts) <= 3 and not {"no", "has", "with", "without"} & set(parts) and NOISE_NAMES & set(parts) and not (main and parts[-1] == "header"):
                return True
    return False


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Elements of a page in order, and its blocks of text, (element, text with single spaces)."""
    root = Node("", "", None, False, False)
    nodes, stack, blocks, text = [root], [root], [], []
    at, end = 0, len(page)

    def flush():
        if text:
            words = " ".join("".join(text).split())
            if words:
                blocks.append((stack[-1], words))
            text.clear()

    def pop(index: int):
        flush()
        del stack[index:]

    def close(tags, barrier=()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return pop(i)
            if stack[i].tag in barrier:
                return None
        return None

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            part = page[at:start]
            text.append(references.unescape(part) if "&" in part else part)
        if start == end:
            break
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        match = _TAG.match(page, start)
        if not match:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            else:
                text.append("<")
                at = start + 1
            continue
        at = match.end()
        closing, tag, rest = match.group(1), match.group(2).lower(), match.group(3)
        if closing:
            if tag in INLINE:
                if tag in ("td", "th"):
                    text.append(" ")
                if stack[-1].tag == tag:  # a noise inline element
                    pop(len(stack) - 1)
            elif tag == "p" or tag not in VOID:
                close({tag})
            continue
        attributes = {}
        if rest and "=" in rest:
            attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
        if rest and "hidden" in rest and _HIDDEN.search(rest):
            attributes["hidden"] = ""
        if tag in RAW:
            flush()
            stop = _RAW_END[tag].search(page, at)
            at = end if not stop else stop.start()
            continue
        if tag in ("br", "td", "th", "img"):
            text.append(" " if tag != "img" else "")
            continue
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        above = stack[-1]
        if tag in INLINE:
            if attributes and not above.noise and _named(tag, attributes, True):
                flush()
                stack.append(Node(tag, tag, above, True, above.main))
                nodes.append(stack[-1])
                above.children.append(stack[-1])
            continue
        if tag in ENDS_P:
            close({"p"}, LISTS | {"td", "th", "button"})
        if tag in ENDS_SAME:
            close(ENDS_SAME[tag], LISTS - {"table"} if tag != "tr" else {"table"})
        flush()
        above = stack[-1]
        if above.depth >= DEPTH and not _named(tag, attributes, above.main):
            node = Node(tag, above.look, above.parent, above.noise, above.main)
            node.key = None  # folded into the ancestor
            node.parent, node.depth = above, above.depth
            stack.append(node)
            nodes.append(node)
            continue
        look = f"{tag}.{'.'.join(sorted(set(attributes.get('class', '').lower().split())))}#{re.sub('[0-9]+', '', attributes.get('id', ''))}"
        noise = above.noise or _named(tag, attributes, above.main)
        main = above.main or (tag in MAIN_TAGS or attributes.get("role") == "main") and not noise
        node = Node(tag, look, above, noise, main)
        stack.append(node)
        nodes.append(node)
        above.children.append(node)
    flush()
    return nodes, blocks


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _keyed(host: str, nodes: list[Node], known: dict) -> dict[int, tuple[int, int, int]]:
    """Element key -> (parent's key, depth, style), and sets the keys of the nodes. `known` holds hashes for later pages."""
    found: dict[int, tuple[int, int, int]] = {}
    if len(known) > KNOWN:
        known.clear()
    for node in nodes:  # parents come first
        parent = node.parent
        if node.key is None:
            node.key = parent.key
            continue
        above = parent.key if parent else 0
        place = (host, above, node.look)
        key = known.get(place)
        if key is None:
            key = known[place] = _hash(*place)
        node.key = key
        if key in found:
            continue
        looks, last = [], None
        for child in node.children:
            if child.look != last:
                last = child.look
                looks.append(last)
        looks = tuple(looks)
        style = known.get(looks)
        if style is None:
            style = _hash(*looks)
            if len(looks) <= 8:
                known[looks] = style
        found[key] = (above, node.depth, style)
    return found


def _spread_schema():
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.float64(), pa.float64()]
    return pa.schema(list(zip(["element", "above", "depth", "styled", "item", "c", "log"], kinds, strict=True)))


SPREAD = "element long, above long, depth int, styled boolean, item long, c double, log double"


def _spread(batches):
    """Of each element, its styles and words as a task's pages show them: c pages or times, and the sum of n ln n over pages.

    A page counts by its weight, 1 / k for each of k copies.
    """
    held: dict[int, tuple[int, int, dict, dict, dict]] = {}
    known: dict = {}
    size = 0

    def out():
        heads, items, c, log = [], [], [], []
        for element, (above, depth, styles, words, logs) in held.items():
            for styled, entries in ((True, styles), (False, words)):
                heads.append((element, above, depth, styled, len(entries)))
                c += entries.values()
            items += styles
            items += [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) - (1 << 63) for w in words]
            log += [0.0] * len(styles)
            log += [logs.get(w, 0.0) for w in words] if logs else [0.0] * len(words)
        held.clear()
        *heads, sizes = zip(*heads, strict=True) if heads else ((), (), (), (), ())
        row = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64))
        for start in range(0, len(row), 100_000):
            part = slice(start, start + 100_000)
            of = pa.array(row[part])
            columns = [pa.array(h, f.type).take(of) for h, f in zip(heads, list(_spread_schema())[:4], strict=True)]
            columns += [pa.array(v[part], f.type) for v, f in zip((items, c, log), list(_spread_schema())[4:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=_spread_schema())

    for batch in slices(batches, 200):
        for host, weight, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            nodes, blocks = parse(page)
            for element, (above, depth, style) in _keyed(host, nodes, known).items():
                styles = held.setdefault(element, (above, depth, {}, {}, {}))[2]
                styles[style] = styles.get(style, 0.0) + weight
            own: dict[int, list] = {}
            for node, text in blocks:
                own.setdefault(node.key, []).extend(text.split())
            for element, found in own.items():
                _, _, _, words, logs = held[element]
                size -= len(words)
                for word, n in Counter(found).items():
                    words[word] = words.get(word, 0.0) + weight * n
                    if n > 1:
                        logs[word] = logs.get(word, 0.0) + weight * n * math.log(n)
                size += len(words)
            if size >= HELD:
                yield from out()
                size = 0
    yield from out()


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


def _weighted(rows: DataFrame) -> DataFrame:
    """host, weight, html of the pages of sites; the weight is 1 / k where k pages of a host have the same article."""
    marked = F.regexp_extract("html", r"(?is)<(article|main)[\s>].*</\1\s*>", 0)
    bare = F.regexp_replace("html", r"(?is)<(script|style|nav|header|footer|aside|form)[\s>].*?</\1\s*>|<[^>]*>|\s+", "")
    sites = rows.where("host <> ''").select("host", "html", F.xxhash64("host", F.when(marked != "", marked).otherwise(bare)).alias("digest"))
    copies = materialise(sites.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1"))
    return sites.join(small(copies, COPIES), "digest", "left").select("host", (1 / F.coalesce("k", F.lit(1))).alias("weight"), "html")


def importance(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """element, above, depth, m, importance, most: of each element of the style trees of `pages`. Written.

    `most` is the largest importance of an element and all that lies below it.
    """
    spread = _weighted(_rows(pages)).mapInArrow(tidy(_spread), SPREAD)
    spread = spread.groupBy("element", "above", "depth", "styled", "item").agg(F.sum("c").alias("c"), F.sum("log").alias("log"))
    style, c = F.col("styled"), F.col("c")
    shown = spread.groupBy("element", "above", "depth").agg(
        F.sum(F.when(style, c)).alias("m"), F.sum(F.when(style, 1)).alias("styles"), F.sum(F.when(style, c * F.log("c"))).alias("logs"),
        F.sum(F.when(~style, F.log("c") - F.col("log") / c)).alias("h"), F.sum(F.when(~style, 1)).alias("words"),
    )
    m, base, enough = F.round("m", 6), F.log("m"), (F.round("m", 6) >= max(min_pages, 2))
    tree = materialise(shown.select(
        "element", "above", "depth", m.alias("m"), "styles", enough.alias("enough"),
        F.when(enough, (base - F.col("logs") / F.col("m")) / base).otherwise(1.0).alias("presentation"),
        F.when(enough & F.col("words").isNotNull(), 1 - F.col("h") / F.col("words") / base).otherwise(F.when(F.col("words").isNotNull(), 1.0)).alias("content"),
    ))
    deepest = tree.agg(F.max("depth")).first()[0]
    below, done = None, []
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = tree.where(F.col("depth") == depth)
        if below is None:
            level = level.select("*", F.lit(None).cast("double").alias("weighted"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("highest"))
        else:
            under = below.groupBy("above").agg(F.sum(F.col("m") * F.col("importance")).alias("weighted"), F.sum("m").alias("weight"), F.max("most").alias("highest"))
            level = level.join(under.withColumnRenamed("above", "element"), "element", "left")
        own = F.coalesce("content", F.lit(0.0)) * F.col("m") + F.col("weighted")
        children = own / (F.col("weight") + F.when(F.col("content").isNotNull(), F.col("m")).otherwise(0))
        damp = F.pow(F.lit(DAMPING), F.col("styles"))
        inner = F.when(F.col("enough"), (1 - damp) * F.col("presentation") + damp * children).otherwise(1.0)
        value = F.round(F.when(F.col("weight").isNull(), F.coalesce("content", F.lit(1.0))).otherwise(inner), 9)
        level = level.withColumn("importance", value).withColumn("most", F.greatest("importance", F.coalesce("highest", F.lit(0.0))))
        below = materialise(level.select("element", "above", "depth", "m", "importance", "most"))
        done.append(below)
    out = tree.select("element", "above", "depth", "m", F.lit(1.0).alias("importance"), F.lit(1.0).alias("most")).limit(0)
    for level in done:
        out = out.unionByName(level)
    return out


PARSED = "row long, page_id long, url string, blocks array<struct<element:long,named:boolean,main:boolean,text:string>>"
_BLOCK = pa.struct([("element", pa.int64()), ("named", pa.bool_()), ("main", pa.bool_()), ("text", pa.string())])
_PARSED = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.list_(_BLOCK))])
FOUND = "page_id long, url string, text string, n_chars long, n_tree long, n_named long"
_FOUND = pa.schema([(n, pa.string() if n in ("url", "text") else pa.int64()) for n in ("page_id", "url", "text", "n_chars", "n_tree", "n_named")])


def _blocks(batch: pa.RecordBatch, known: dict):
    """page_id, url and the blocks of each page of a batch of _rows."""
    for page_id, url, host, page in zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True):
        nodes, blocks = parse(page)
        _keyed(host, nodes, known)
        yield page_id, url, [(n.key if host else None, n.noise, n.main, t) for n, t in blocks]


def _parsed(batches):
    known: dict = {}
    for batch in slices(batches, 200):
        rows = [(i, u, [dict(zip(("element", "named", "main", "text"), b, strict=True)) for b in blocks]) for i, u, blocks in _blocks(batch, known)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_PARSED)[1:], strict=True))], schema=_PARSED)


def _kept(noise: Broadcast):
    """Text of each page without the branches in `noise`: sorted elements, and whether they go from articles too."""

    def run(batches):
        elements, deep = noise.value
        hashes: dict = {}
        for batch in slices(batches, 200):
            rows = []
            for page_id, url, blocks in _blocks(batch, hashes):
                low = np.zeros(len(blocks), bool)
                known = np.array([b[0] is not None for b in blocks], bool)
                if len(elements) and known.any():
                    keys = np.array([b[0] for b in blocks], np.int64)
                    at = np.minimum(np.searchsorted(elements, keys), len(elements) - 1)
                    low = (elements[at] == keys) & (deep[at] | ~np.array([b[2] for b in blocks], bool))
                text = "\n\n".join(b[3] for b, x in zip(blocks, low, strict=True) if not (b[1] or x))
                rows.append((page_id, url, text, len(text), int(low.sum()), sum(b[1] and not x for b, x in zip(blocks, low, strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def _joined(rows: DataFrame, low: DataFrame) -> DataFrame:
    """As _kept, with the noise joined to the pages that show it."""
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "host", "html")
    whole = materialise(numbered.mapInArrow(tidy(_parsed), PARSED))
    shown = whole.select("row", F.explode(F.array_distinct("blocks.element")).alias("element"))
    marks = shown.join(low, "element").groupBy("row").agg(F.collect_list("element").alias("low"), F.collect_list(F.when(F.col("deep"), F.col("element"))).alias("deep"))
    listed = lambda c, b: F.coalesce(F.array_contains(F.col(c), b["element"]), F.lit(False))
    unimportant = lambda b: F.when(b["main"], listed("deep", b)).otherwise(listed("low", b))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: ~b["named"] & ~unimportant(b)), lambda b: b["text"]), "\n\n")
    return whole.join(marks, "row", "left").select(
        "page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"),
        F.size(F.filter("blocks", unimportant)).cast("long").alias("n_tree"), F.size(F.filter("blocks", lambda b: b["named"] & ~unimportant(b))).cast("long").alias("n_named"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars; n_tree and n_named: blocks that the tree finds unimportant, and that names alone removed.

    Up to LOW noise elements (9 bytes each) travel to the tasks, which parse the pages once more and
    move none; beyond that parsed pages are written and meet the elements by joins.
    """
    spark, rows = pages.sparkSession, _rows(pages)
    prepare(spark)
    low = materialise(importance(pages).where(F.col("most") < NOISE).select("element", (F.col("most") < ARTICLE_NOISE).alias("deep")))
    if not within(low, LOW):
        return _joined(rows, low)
    found = low.toPandas().sort_values("element")
    noise = spark.sparkContext.broadcast((found["element"].to_numpy(np.int64), found["deep"].to_numpy(bool)))
    return rows.mapInArrow(tidy(_kept(noise)), FOUND)
