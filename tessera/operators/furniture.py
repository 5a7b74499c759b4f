"""Running headers, footers and page numbers of paged documents: found by their repetition over pages, then removed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import masked

#: Lines that open content, never removed, and lines that are nothing but a page number.
PROTECTED = r"(?i)^\s*(?:question\s*(?:no\.?)?\s*\d+|case\s+scenario\b|\([a-hA-H]\))"
PAGE_NUMBER = r"(?i)^\s*(?:page\s*)?[-–—]?\s*\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?\s*[-–—]?\s*$"


@dataclass(frozen=True)
class Bands:
    """Shares of a page's height in which running lines and page numbers stand, and of its pages that a running line needs."""

    running: float = 0.08
    number: float = 0.10
    pages: float = 0.50
    least_pages: int = 2


def within(y: Column, height: Column, share: float) -> Column:
    """Whether a line's middle is in the top or bottom ``share`` of its page; unknown places are not."""
    return F.coalesce((y <= share * height) | (y >= (1 - share) * height), F.lit(False))


def running_lines(lines: DataFrame, bands: Bands = Bands(), pages: DataFrame | None = None) -> DataFrame:
    """doc, pattern, n_pages: masked lines that stand in the bands of at least half the pages of a document, two at least.

    ``lines``: doc, page, height, y (the line's middle), text; ``pages``: doc, n_pages, where pages without a line count
    too, else the pages that have lines are counted.  Protected and null lines are no pattern.
    """
    sizes = pages if pages is not None else lines.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"))
    edge = lines.where(within(F.col("y"), F.col("height"), bands.running) & ~F.col("text").rlike(PROTECTED))
    # one row a page before pages are counted, so that a document of many pages combines map-side
    seen = edge.select("doc", "page", masked(F.col("text")).alias("pattern")).distinct().groupBy("doc", "pattern").agg(F.count("*").alias("on_pages"))
    need = F.greatest(F.lit(bands.least_pages), F.floor(bands.pages * F.col("n_pages")))
    return seen.join(sizes, "doc").where((F.col("n_pages") > 1) & (F.col("on_pages") >= need)).select("doc", "pattern", F.col("on_pages").alias("n_pages"))


def classified(lines: DataFrame, bands: Bands = Bands(), pages: DataFrame | None = None) -> DataFrame:
    """``lines`` with ``role``: content, running or page_number.

    Only lines in the outer bands meet the patterns in a join: the body of the pages goes through unshuffled.  A
    document of one page has neither headers nor page numbers.  Null texts, and lines whose place is unknown, are content.
    """
    sizes = pages if pages is not None else lines.groupBy("doc").agg(F.count_distinct("page").alias("n_pages"))
    protected = F.coalesce(F.col("text").rlike(PROTECTED), F.lit(True))
    outer = within(F.col("y"), F.col("height"), max(bands.running, bands.number)) & ~protected & F.col("doc").isNotNull()
    body = lines.where(~outer).withColumn("role", F.lit("content"))
    found = running_lines(lines, bands, sizes).select(F.col("doc").alias("__doc"), F.col("pattern").alias("__pattern"))
    many = sizes.where("n_pages > 1").select(F.col("doc").alias("__many"))
    edge = lines.where(outer).join(found, (F.col("doc") == F.col("__doc")) & (masked(F.col("text")) == F.col("__pattern")), "left").join(many, F.col("doc") == F.col("__many"), "left")
    running = F.col("__doc").isNotNull() & within(F.col("y"), F.col("height"), bands.running)
    number = F.col("__many").isNotNull() & within(F.col("y"), F.col("height"), bands.number) & F.col("text").rlike(PAGE_NUMBER)
    role = F.when(running, "running").when(number, "page_number").otherwise("content")
    return body.unionByName(edge.withColumn("role", role).drop("__doc", "__pattern", "__many"))


def cleaned(lines: DataFrame, bands: Bands = Bands(), pages: DataFrame | None = None) -> DataFrame:
    """``lines`` without running headers, footers and page numbers."""
    return classified(lines, bands, pages).where("role = 'content'").drop("role")
