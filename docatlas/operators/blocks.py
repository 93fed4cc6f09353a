"""Pages -> one row per block element, with structure columns.

The page is cut at block tags by ``split`` with look-ahead, so the explode yields
one row per block and not one per token, and every later step is a window on
(page, pos).  ``html`` is shuffled once by page; all windows and the final
aggregate reuse that partitioning.  ``page`` is a digest of the columns that are read
(page_id, html and, if asked for, url): two pages of one page_id stay apart, and rows that
are equal in all of them are one page.

Structure policy on broken html: inline tags never change depth; p, li, dt, dd,
tr, td, th end at the next block boundary; container tags count by their open and
end tags, never below zero.  A table or list is one block up to its first end
tag, and anything nested beyond that becomes rows of its own.  This equals a tree
builder on well-formed pages.  Comments, script and style are not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docatlas import dims
from docatlas.functions import text as T

CONTAINERS = ("html head body main div section article aside nav header footer form fieldset figure "
              "blockquote details pre title h1 h2 h3 h4 h5 h6 ul ol dl table").split()
LOOSE = "p li dt dd tr td th caption hr".split()
ATOMIC = ["table", "ul", "ol", "dl"]

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|[\u0001-\u0003]"
BLOCK_TAGS = "|".join(CONTAINERS + LOOSE)
AT_TABLE = r"(?i)(?=<table[\s>])|(?<=</table>)"
AT_LIST = r"(?i)(?=<(?:ul|ol|dl)[\s>])|(?<=</(?:ul|ol|dl)>)"
AT_BLOCK = rf"(?i)(?=</?(?:{BLOCK_TAGS})[\s/>])"
TAG = rf"(?i)^<(/?(?:{BLOCK_TAGS}))(?=[\s/>])"
OPEN = rf"(?i)<(?:{'|'.join(CONTAINERS)})[\s/>]"
CLOSE = rf"(?i)</(?:{'|'.join(CONTAINERS)})[\s>]"


def visible_html(html: Column) -> Column:
    return T.decode_numeric(F.regexp_replace(html, HIDDEN, ""))


def text_of(html: Column) -> Column:
    """Text of a piece of html: tags dropped, character references decoded."""
    return T.unescape(F.regexp_replace(html, r"<[^>]*>", ""))


def pieces(html: Column) -> Column:
    """Block strings in document order; tables and lists stay whole."""
    def outside_tables(part: Column) -> Column:
        return F.flatten(F.transform(
            F.split(part, AT_LIST),
            lambda x: F.when(x.rlike(r"(?i)^<(?:ul|ol|dl)[\s>]"), F.array(x)).otherwise(F.split(x, AT_BLOCK))))

    parts = F.flatten(F.transform(
        F.split(html, AT_TABLE),
        lambda x: F.when(x.rlike(r"(?i)^<table[\s>]"), F.array(x)).otherwise(outside_tables(x))))
    return F.filter(parts, lambda x: x != "")


def by_page(pages: DataFrame) -> DataFrame:
    """The one exchange, by ``page``; of equal rows one stays.  The stage after it is heavy on CPU per
    byte, so it keeps the configured number of partitions instead of being coalesced by size."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in pages.columns]
    d = pages.withColumn("page", F.unhex(F.md5(F.concat_ws("\u0002", *parts)))).repartition(n, "page")
    copy = F.row_number().over(W.partitionBy("page").orderBy("page"))
    return d.withColumn("copy", copy).where("copy = 1").drop("copy")


def raw_blocks(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per piece: page, page_id, pos, raw (+ carried page columns)."""
    keep = list(carry or [])
    if not keep:
        pages = by_page(pages.select("page_id", "html")).withColumn("html", visible_html(F.col("html")))
    return (pages.select("page", "page_id", *keep, F.posexplode_outer(pieces(F.col("html"))).alias("pos", "raw"))
            .filter("pos is not null"))


def describe(b: DataFrame) -> DataFrame:
    """tag ('' for bare text, '/x' for an end tag), class, inner html, text, code, depth change."""
    b = b.withColumn("tag", F.lower(F.regexp_extract("raw", TAG, 1)))
    b = b.withColumn("head", F.when(F.col("tag") != "", F.regexp_extract("raw", r"^<[^>]*>?", 0)).otherwise(""))
    b = b.withColumn("inner", F.substring("raw", F.length("head") + 1, F.length("raw")))
    b = b.withColumn("text", text_of(F.col("inner")))
    code = F.regexp_extract("inner", r"(?is)<code\b[^>]*>(.*?)(?:</code\s*>|\z)", 1)
    delta = (F.when(F.col("tag").isin(ATOMIC), F.regexp_count("raw", F.lit(OPEN)) - F.regexp_count("raw", F.lit(CLOSE)))
             .when(F.col("tag").isin(CONTAINERS), 1).when(F.col("tag").isin(["/" + c for c in CONTAINERS]), -1)
             .otherwise(0))
    return (b.withColumn("css", F.lower(F.regexp_extract("head", r"(?i)\sclass\s*=\s*[\"']?([^\"'>]*)", 1)))
            .withColumn("has_code", (F.col("tag") != "pre") & F.col("inner").rlike(r"(?i)<code[\s>]"))
            .withColumn("code_text", F.when(F.col("has_code"), T.strip(text_of(code))))
            .withColumn("hlevel", F.when(F.col("tag").rlike(r"^h[1-6]\z"), F.substring("tag", 2, 1).cast("int")))
            .withColumn("delta", delta))


def page_order():
    return W.partitionBy("page").orderBy("pos")


def with_depth(b: DataFrame) -> DataFrame:
    """depth after the row; level = number of containers around the row's own element."""
    depth = F.greatest(F.sum("delta").over(page_order()), F.lit(0))
    return b.withColumn("depth", depth.cast("int")).withColumn(
        "level", F.col("depth") - F.greatest(F.col("delta"), F.lit(0)))


def with_parent(b: DataFrame, named: bool = True) -> DataFrame:
    """Position (and, if ``named``, tag and class) of the container around each row.

    Each row plays up to two roles, child at key = level and opener at key =
    depth; the last opener of a key is the open container."""
    roles = F.when(F.col("delta") > 0, F.array(
        F.struct(F.col("level").alias("key"), F.lit(False).alias("opener")),
        F.struct(F.col("depth").alias("key"), F.lit(True).alias("opener")),
    )).otherwise(F.array(F.struct(F.col("level").alias("key"), F.lit(False).alias("opener"))))
    w = W.partitionBy("page", "key").orderBy("pos", "opener")
    mine = F.last(F.when(F.col("opener"), F.struct("pos", *(("tag", "css") if named else ()))), ignorenulls=True).over(w)
    d = (b.withColumn("role", F.explode(roles)).select("*", "role.key", "role.opener").drop("role")
         .withColumn("up", mine).filter(~F.col("opener"))
         .withColumn("parent", F.coalesce("up.pos", F.lit(-1))))
    if named:
        d = d.withColumn("parent_tag", F.coalesce("up.tag", F.lit(""))).withColumn("parent_css", F.coalesce("up.css", F.lit("")))
    return d.drop("up", "key", "opener")


def blocks(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """P0 with depth and parent."""
    return with_parent(with_depth(describe(raw_blocks(pages, carry))))


def with_section(b: DataFrame) -> DataFrame:
    """Last heading at or before each block, its level and text."""
    head = F.last(F.when(F.col("hlevel").isNotNull(), F.struct("pos", "hlevel", "text")),
                  ignorenulls=True).over(page_order())
    return b.withColumn("h", head).select(
        "*", F.col("h.pos").alias("section_pos"), F.col("h.hlevel").alias("section_level"),
        F.col("h.text").alias("section_text")).drop("h")


def with_island(b: DataFrame, start: Column, name: str = "island") -> DataFrame:
    """Running number of start markers."""
    return b.withColumn(name, F.sum(F.when(start, 1).otherwise(0)).over(
        page_order().rowsBetween(W.unboundedPreceding, W.currentRow)))


def with_neighbours(b: DataFrame) -> DataFrame:
    """The block before and after, and the last paragraph before."""
    w = page_order()
    before = F.last(F.when(F.col("tag") == "p", F.col("pos")), ignorenulls=True).over(
        w.rowsBetween(W.unboundedPreceding, -1))
    return (b.withColumn("prev_tag", F.lag("tag").over(w)).withColumn("next_tag", F.lead("tag").over(w))
            .withColumn("prev_p", before))


def joined_text(b: DataFrame, keys: list[str], sep: str) -> DataFrame:
    """G1: ordered text and number of blocks of a group; groups are bounded by one page."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return b.groupBy(*keys).agg(parts.alias("parts")).select(
        *keys, F.array_join(F.transform("parts", lambda p: p["text"]), sep).alias("text"), F.size("parts").cast("long").alias("blocks"))


def missing_sections(b: DataFrame) -> DataFrame:
    """(page_id, section) expected but absent.

    One pass with a flag per section instead of a set difference over two
    shuffled sides; the expected set is the constant list of sections."""
    wanted = ["parameters", "return", "remarks"]
    flags = [F.coalesce(F.bool_or(F.col("hlevel").between(2, 4) & F.lower("text").rlike(dims.HEADINGS[s])),
                        F.lit(False)).alias(s) for s in wanted]
    per_page = b.groupBy("page").agg(F.first("page_id").alias("page_id"), *flags)
    absent = F.filter(F.array(*[F.when(~F.col(s), s) for s in wanted]), lambda x: x.isNotNull())
    return per_page.select("page_id", F.explode(absent).alias("section"))
