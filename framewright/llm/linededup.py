"""Line dedup by site-relative frequency (DataFrame functions only).

Pages are grouped by host. A line is boilerplate on a host if the pages that contain it, divided by all
pages of the host, exceed a ratio. Such lines are dropped from the host's pages.

A long line hardly stands on several pages of a host by chance, so with ``long_ratio`` lines of more than LONG_WORDS
words have this smaller ratio, with the least number of pages as its floor. Copies spread over hosts aren't seen.

Only 64-bit fingerprints of lines are counted. At most (mean lines of a page) / ratio lines of a host can
exceed the ratio, so the list of them that joins a host's pages stays short however large the host is; with
``long_ratio`` the same holds of long lines and it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.names import col, packed, quoted
from framewright.llm.store import stored

#: A line on more than this share of a host's pages is boilerplate, if on this many pages at least.
RATIO = 0.1
MIN_PAGES = 3
#: A line of more words than this is long; its ratio where callers ask for it. Below 3,000 pages of a host the floor decides.
LONG_WORDS, LONG_RATIO = 50, 0.001


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _print(line: Column) -> Column:
    """The fingerprint of a line without outer blanks; null for a blank line, which is never dropped."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def _is_long(line: Column) -> Column:
    """More than LONG_WORDS words between ASCII blanks."""
    return F.regexp_count(line, F.lit(r"[^ \t\n\x0B\f\r]+")) > LONG_WORDS


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, long_ratio: float | None = None) -> DataFrame:
    """host, lines: the fingerprints of each host's boilerplate. A page counts once for a line."""
    entry = _print if long_ratio is None else lambda x: F.when(_print(x).isNotNull(), F.struct(_print(x).alias("print"), _is_long(x).alias("long")))
    slim = pages.select(host.alias("host"), F.array_distinct(F.transform(_lines(text), entry)).alias("prints")).filter("host is not null")
    totals = slim.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = slim.select("host", F.explode("prints").alias("print")).filter("print is not null")
    least = F.lit(ratio)
    if long_ratio is not None:
        lines, least = lines.select("host", "print.print", "print.long"), F.when(F.col("long"), long_ratio).otherwise(ratio)
    seen = lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    over = seen.join(totals, "host").filter(F.col("n") > least * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("print").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False, long_ratio: float | None = None) -> DataFrame:
    """``pages`` with the boilerplate lines gone from ``text``; with ``counts`` also n_lines and n_dropped.

    Null texts stay null and have no lines; a page of nothing but boilerplate becomes empty and stays.
    Pages without a host belong to no site and stay as they are. A line repeated on one page counts
    once for the ratio, and all its repeats go. Repeated rows are pages of their own. A share of exactly the ratio stays.
    A text of any length is one page, cut into lines where it stands. An empty table gives an empty result. Other columns
    pass through, whatever their names; with ``counts`` a column that already is n_lines or n_dropped is an error.
    """
    taken = [c for c in ("n_lines", "n_dropped") if counts and c in pages.columns]
    if taken:
        raise ValueError(f"the pages already have columns {taken}")
    found = stored(boilerplate(pages, host, col(text), ratio, min_pages, long_ratio), "boilerplate")
    rows = pages.select(packed(pages).alias("page"), host.alias("own_host"))
    rows = rows.join(found, rows["own_host"] == found["host"], "left").select("page", "lines")
    field = lambda c: F.col(f"page.{quoted(c)}")
    before = _lines(field(text))
    kept = F.filter(before, lambda x: ~F.coalesce(F.array_contains(F.col("lines"), _print(x)), F.lit(False)))
    clean = F.when(F.col("lines").isNull(), field(text)).otherwise(F.array_join(kept, "\n"))
    out = [(clean if c == text else field(c)).alias(c) for c in pages.columns]
    if counts:
        n = lambda lines: F.when(field(text).isNull(), 0).otherwise(F.coalesce(F.size(lines), F.lit(0)))
        out += [n(before).cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(n(before) - n(kept)).cast("long").alias("n_dropped")]
    return rows.select(*out)
