"""Line de-duplication by site-relative frequency.

Pages are grouped by host; a line's ratio is the number of the host's pages
that contain it divided by the host's pages.  Lines above the ratio are
navigation, notices and slogans, and go.  A line must stand on at least
``min_pages`` pages, so a host with a handful of pages loses nothing to
chance.

Counting shuffles one 64-bit digest per different line of a page, summed on
the map side first, so a host or line that holds a third of all rows is
spread over all map tasks.  A host's boilerplate set is small by
construction (at most its mean lines per page divided by the ratio); it is
joined back per host, by broadcast if its measured size is below Spark's
limit and otherwise by a join whose skewed hosts Spark splits.  DataFrame functions only.

Defined results: lines compare without surrounding blanks; blank lines are
neither counted nor dropped; rows count as pages each, also repeated ones, or
with ``different`` every different text of a host once, so that copies of one
text do not make its lines boilerplate; a null host is no site, so its pages stay unchanged; a null text stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_BLANK = "\t\n\r\x0b\x0c "


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANK)))


def _not_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK)) != ""


def boilerplate(df: DataFrame, host_col: str, text_col: str, max_ratio: float,
                min_pages: int = 3, different: bool = False) -> DataFrame:
    """Per host that has any: ``_host`` and ``_lines``, the digests of its
    boilerplate lines.  With ``different``, equal texts of a host are one
    page; their digests are two 64-bit numbers."""
    page = df.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text")).where("_host is not null")
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), _not_blank), _digest))
    page = page.select("_host", digests.alias("_lines"), F.xxhash64("_text").alias("_p"),
                       F.xxhash64(F.lit("page"), "_text").alias("_q"))
    if different:
        page = page.groupBy("_host", "_p", "_q").agg(F.first("_lines").alias("_lines"))
    seen = (page.select("_host", F.explode("_lines").alias("_line"))
            .groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages))
    total = page.groupBy("_host").agg(F.count("*").alias("_pages"))
    return (seen.join(total, "_host").where(F.col("_n") > F.lit(max_ratio) * F.col("_pages"))
            .groupBy("_host").agg(F.collect_list("_line").alias("_lines")))


def drop_boilerplate(df: DataFrame, host_col: str, text_col: str, max_ratio: float,
                     min_pages: int = 3, different: bool = False) -> DataFrame:
    """``df`` with its boilerplate lines removed from ``text_col``, plus
    ``n_lines`` (of the input text) and ``n_dropped``.  All columns stay; two
    columns of those names already there are replaced."""
    if not 0 <= max_ratio <= 1:
        raise ValueError("the ratio lies between 0 and 1")
    # Frozen, its size is known before the join is planned: a small table is
    # broadcast and no text is shuffled.
    known = cut_lineage(boilerplate(df, host_col, text_col, max_ratio, min_pages, different))
    rest = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    packed = df.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_text"),
                       F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))
    joined = packed.join(known, "_host", "left")
    lines = _lines(F.col("_text"))
    kept = F.when(F.col("_lines").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~(_not_blank(x) & F.array_contains(F.col("_lines"), _digest(x)))))
    work = joined.select("_row", F.col("_text"), lines.alias("_all"), kept.alias("_kept"))
    text = F.when(F.col("_text").isNotNull(), F.array_join("_kept", "\n")).cast("string")
    size = F.coalesce(F.size("_all"), F.lit(0))
    return work.select(
        *[(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in rest],
        F.when(F.col("_text").isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
        F.when(F.col("_text").isNull(), 0).otherwise(size - F.size("_kept")).cast("long").alias("n_dropped"))


#: Tags that end a line of text (fixed by HTML).
BLOCK_TAGS = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|"
              "head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul")
#: (pattern, replacement) steps from raw HTML to lines of visible text.
VISIBLE_TEXT = (
    (r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", ""),
    (rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"[ \t\r\n]*\n[ \t\r\n]*", "\n"),
    (r"^\n|\n$", ""),
)
#: Character references that occur in running text; the ampersand is last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def visible_text(html: Column) -> Column:
    """Lines of a raw page's visible text."""
    for pattern, new in VISIBLE_TEXT:
        html = F.regexp_replace(html, pattern, new)
    for name, char in REFERENCES:
        html = F.replace(html, F.lit(name), F.lit(char))
    return html


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)
