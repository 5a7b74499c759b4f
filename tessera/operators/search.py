"""Full-text search by a positional inverted index: English stems, stop words, all of, any of, none of, phrases.

The index has a row per word and block of documents: the word's places, ascending, each a document and a position in one
number, in a folder per bucket of stems, ordered by stem.  A query reads the rows of its own stems, joins nothing to texts,
and decides each document from the positions that it found.
"""

from __future__ import annotations

import re
import zlib
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.stemming import STOP_WORDS, stem

#: Ids of a block of documents, and folders of stems.
BLOCK, BUCKETS = 1 << 16, 64
#: Storage of the index: sorted integers are delta-coded by the file format.
OPTIONS = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}
_WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Words in order: runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1))


def place(offset: Column, position: Column) -> Column:
    """A document's distance from its block's first id, and a position in the document, as one number that sorts by both."""
    return F.shiftleft(offset.cast("long"), 32) + position


def offset_of(place: Column) -> Column:
    return F.shiftright(place, 32)


def position_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1))


def index(docs: DataFrame, id_col: str, text_col: str, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """bucket, stem, word, block (its first id) and places, to be stored by bucket.

    Ids are whole numbers; rows that repeat an id are one document with the positions of all of them.  Stop words are
    left out, but count as positions.  Every block has a row of the stem '' with a place 0 of all its documents, those
    without words or text too, which queries of nothing but exclusions start from.
    """
    doc = F.col(id_col).cast("long")
    given = docs.where(F.col(id_col).isNotNull()).select((F.floor(doc / block) * block).alias("block"), doc.alias("doc"), F.col(text_col).alias("text"))
    given = given.select("block", (F.col("doc") - F.col("block")).alias("offset"), "text")
    # outer, as the filter that Spark infers for an inner one splits the text a second time; its null words aren't kept
    found = given.select("block", "offset", F.posexplode_outer(words(F.col("text"))).alias("at", "word")).where(~F.col("word").isin(*STOP_WORDS))
    # one aggregation, combined before its shuffle: what is shuffled are lists, not occurrences
    lists = found.groupBy("word", "block").agg(F.sort_array(F.collect_list(place(F.col("offset"), F.col("at")))).alias("places"))
    every = given.groupBy("block").agg(F.sort_array(F.collect_set(place(F.col("offset"), F.lit(0)))).alias("places"))
    every = every.select(F.lit("").alias("stem"), F.lit("").alias("word"), "block", "places")
    return _bucketed(lists.select(stem(F.col("word")).alias("stem"), "word", "block", "places").unionByName(every), buckets)


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    rows = rows.withColumn("bucket", (F.crc32(F.col("stem").cast("binary")) % buckets).cast("int"))
    return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "stem", "block")


class Literal(NamedTuple):
    """A phrase (or one word) that must be there, or mustn't: its stems and their distances from the first."""

    negated: bool
    stems: tuple[tuple[str, int], ...]


def parsed(spark: SparkSession, q: str) -> list[list[Literal]]:
    """Alternatives of literals: words all needed, "phrases", or between alternatives, - before what is excluded.

    Stop words are dropped, but keep their place in a phrase.  What holds nothing but stop words or marks is dropped.
    """
    raw: list[list[tuple[bool, list[str]]]] = [[]]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', q.lower()):
        if word == "or" and not sign:
            raw.append([])
        else:
            raw[-1].append((bool(sign), re.findall(r"[^\W_]+", phrase or word)))
    asked = sorted({w for group in raw for _, found in group for w in found})
    given = spark.createDataFrame([(w,) for w in asked], "word string") if asked else None
    stems = {r["word"]: r["stem"] for r in given.select("word", stem(F.col("word")).alias("stem")).collect()} if asked else {}  # the query's own words
    out = []
    for group in raw:
        literals = []
        for negated, found in group:
            held = [(stems[w], i) for i, w in enumerate(found) if w not in STOP_WORDS]
            if held:
                literals.append(Literal(negated, tuple((s, i - held[0][1]) for s, i in held)))
        if literals:
            out.append(literals)
    return out


def _before(distance: int, position: Column) -> Column:
    return position - distance


def _holds(literal: Literal) -> Column:
    """Whether the document's hits (stem, position) have the literal."""
    of = lambda stem: F.transform(F.filter("hits", lambda h: h["stem"] == stem), lambda h: h["position"])
    (first, _), *rest = literal.stems
    if not rest:
        out = F.exists("hits", lambda h: h["stem"] == first)
    else:
        common = of(first)
        for stem, distance in rest:
            common = F.array_intersect(common, F.transform(of(stem), partial(_before, distance)))
        out = F.size(common) > 0
    return ~out if literal.negated else out


def search(idx: DataFrame, q: str, buckets: int = BUCKETS) -> DataFrame:
    """doc and block of the documents that match; none for a query without a word that counts."""
    groups = parsed(idx.sparkSession, q)
    stems = {s for group in groups for literal in group for s, _ in literal.stems}
    if any(all(literal.negated for literal in group) for group in groups):
        stems.add("")
    asked = idx.where(F.col("bucket").isin(*{zlib.crc32(s.encode()) % buckets for s in stems}) & F.col("stem").isin(*stems)) if stems else idx.where("false")
    placed = {s for group in groups for literal in group if len(literal.stems) > 1 for s, _ in literal.stems}
    once = F.array_distinct(F.transform("places", lambda p: place(offset_of(p), F.lit(0))))  # positions count in phrases only
    hits = asked.select("stem", "block", F.explode(F.when(F.col("stem").isin(*placed), F.col("places")).otherwise(once)).alias("p"))
    hits = hits.select("block", (F.col("block") + offset_of(F.col("p"))).alias("doc"), F.struct("stem", position_of(F.col("p")).alias("position")).alias("hit"))
    docs = hits.groupBy("block", "doc").agg(F.collect_list("hit").alias("hits"))
    match = F.lit(False)
    for group in groups:
        every = F.lit(True)
        for literal in group:
            every = every & _holds(literal)
        match = match | every
    return docs.where(match).select("doc", "block")


def page(found: DataFrame, number: int = 1, size: int = 25, id_col: str = "doc") -> DataFrame:
    """A page of ``found`` in order of id with the total of all rows; a page beyond the end has no row.

    Only the ids of pages up to this one meet in one task; the total is a count added up from the tasks.
    """
    n = F.row_number().over(Window.orderBy(id_col))
    firsts = found.orderBy(id_col).limit(number * size).withColumn("__n", n).where(F.col("__n") > (number - 1) * size)
    return firsts.drop("__n").withColumn("total", found.agg(F.count("*")).scalar())
