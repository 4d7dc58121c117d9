"""Line dedup by site-relative frequency.

Pages are grouped by host. The pages of a host that contain a line, divided by the host's
page total, give the line's ratio; lines above the boilerplate ratio are dropped from every
page of the host. ``min_pages`` is a parameter: on a host with fewer pages nothing is dropped, for
there every line of a single page could be above the ratio. With 1 the ratio alone decides.

At most (distinct lines of an average page) / ratio lines of a host can exceed the ratio,
so the list of a host's boilerplate is short however large the host is; it rides along
with the host's total in one row. Joins by host are spread over shares of a hot host's rows.

Defined results: a null url or one without a host has host '' (such pages form one group).
A null html has no lines. Lines are trimmed of space, tab, VT, FF and CR; what is empty then is
no line. Repeated rows count as pages of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import spread_join, written

RATIO = 0.3
MIN_PAGES = 5
BLANKS = " \t\n\v\f\r"
#: What never shows, then the tags that end a line, then every other tag.
HIDDEN = r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->"
BREAKS = r"(?i)</?(p|div|li|ul|nav|h1|h2|h3|article|br|title|tr|td|table|footer|header|body|head|html)\b[^>]*>"
TAGS = r"<[^>]*>"


def host(url: Column) -> Column:
    """Lower-case host of a url, without user, port or a leading www."""
    name = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    name = F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":[0-9]*$", "")
    return F.coalesce(F.regexp_replace(name, r"^www\.", ""), F.lit(""))


def lines(html: Column) -> Column:
    """The trimmed, nonblank lines of a page's text."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), BREAKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host: host, host_pages, boilerplate (array of its lines above the ratio).

    ``pages`` has host and lines. Each page gives a line once, so counts by (host, line)
    are page counts and are summed before they are shuffled.
    """
    totals = written(pages.groupBy("host").agg(F.count("*").alias("host_pages")), "host-pages")
    counts = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    common = spread_join(counts, totals, "host", "host_pages").where((F.col("host_pages") >= min_pages) & (F.col("n") > ratio * F.col("host_pages")))
    common = common.groupBy("host").agg(F.collect_list("line").alias("boilerplate"))
    return totals.join(common, "host", "left").select("host", "host_pages", F.coalesce("boilerplate", F.array().cast("array<string>")).alias("boilerplate"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, html`` to page_id, host, host_pages, n_lines, n_dropped, text (kept lines)."""
    split = pages.select("page_id", host(F.col("url")).alias("host"), lines(F.col("html")).alias("lines"))
    split = written(split, "page-lines")
    table = written(boilerplate(split, ratio, min_pages), "host-lines")
    joined = spread_join(split, table, "host", "host_pages")
    kept = joined.select("page_id", "host", "host_pages", "lines", F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), x)).alias("kept"))
    return kept.select(
        "page_id", "host", "host_pages", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"),
    )
