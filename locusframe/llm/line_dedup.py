"""Removal of boilerplate lines by their frequency within a site.

A host's pages that contain a line, divided by the host's pages, is the line's ratio. Lines
found on at least `min_pages` pages whose ratio is `ratio` or more are dropped from every page
of the host; the other lines stay, in order. Lines are the parts of a text between newlines,
compared as they are; lines of white space alone never count and never go.

Nulls and ties: a null host is a host of its own, named ''. A null text has no lines and stays
null. Rows that repeat a page count as pages of their own, and each is returned. Other columns
are kept as they are whatever their names, but for n_lines and n_dropped, which the result replaces.
Texts of any length are split whole, and an empty table gives no rows.

Scale: distinct lines of a page are exploded, keyed by (host, 64-bit hash) and summed before the
exchange, so neither a host nor a line with a third of all rows meets in one task. A host has at
most (lines of a page) / ratio such lines. They are gathered into one array per host and joined
to the pages, which are not moved where the arrays are small enough to travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import within

RATIO_PERCENT = 5
MIN_PAGES = 3
#: Boilerplate lines (16 bytes each with their host's share) that may travel to every task.
BROADCAST_LINES = 500_000


def host_of(url: Column) -> Column:
    """Host of a URL; '' without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hashes(text: Column) -> Column:
    """Hashes of the lines that count, distinct."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(lines, lambda line: F.xxhash64(line)))


def boilerplate(pages: DataFrame, host: Column, ratio_percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line hash, pages with it, pages of the host) of the lines that are to go."""
    rows = pages.select(F.coalesce(host, F.lit("")).alias("_line_host"), F.col("text"))
    totals = rows.groupBy("_line_host").agg(F.count("*").alias("_line_total"))
    lines = rows.select("_line_host", F.explode(_hashes(F.col("text"))).alias("_line_hash"))
    counts = lines.groupBy("_line_host", "_line_hash").agg(F.count("*").alias("_line_pages")).where(F.col("_line_pages") >= min_pages)
    return counts.join(totals, "_line_host").where(F.col("_line_pages") * 100 >= F.col("_line_total") * ratio_percent)


def drop_boilerplate(pages: DataFrame, host: Column, ratio_percent: int = RATIO_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """`pages` with cleaned `text`, and n_lines and n_dropped (long) of each page."""
    found = boilerplate(pages, host, ratio_percent, min_pages).select("_line_host", "_line_hash")
    travels = within(found, BROADCAST_LINES)
    per_host = found.groupBy("_line_host").agg(F.collect_list("_line_hash").alias("_line_bad"))
    if travels:
        per_host = F.broadcast(per_host)
    # The page's own columns wait in one, so that none of their names meets a helper's.
    own = pages.select(F.coalesce(host, F.lit("")).alias("_line_host"), F.col("text"), F.struct("*").alias("_line_row"))
    joined = own.join(per_host, "_line_host", "left")
    # The lines of this page that go: a hash lookup in the host's lines, then few to compare with.
    split = joined.withColumn("_line_all", F.split("text", "\n", -1)).withColumn(
        "_line_hit", F.array_intersect(_hashes(F.col("text")), F.coalesce("_line_bad", F.array().cast("array<bigint>")))
    )
    stay = F.when(F.size("_line_hit") == 0, F.col("_line_all")).otherwise(
        F.filter("_line_all", lambda line: ~(line.rlike(r"[^\x20\x09-\x0D]") & F.array_contains("_line_hit", F.xxhash64(line))))
    )
    cleaned = split.withColumn("_line_stay", stay)
    n_all = F.when(F.col("text").isNull(), 0).otherwise(F.size("_line_all")).cast("long")
    n_stay = F.when(F.col("text").isNull(), 0).otherwise(F.size("_line_stay")).cast("long")
    return cleaned.select(
        *[F.array_join("_line_stay", "\n").alias("text") if c == "text" else F.col("_line_row")[c].alias(c) for c in pages.columns if c not in ("n_lines", "n_dropped")],
        n_all.alias("n_lines"), (n_all - n_stay).alias("n_dropped"),
    )
