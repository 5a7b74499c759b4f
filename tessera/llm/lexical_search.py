"""Ranked lexical search: document-at-a-time merges over compressed postings, a shard at a time, then a global merge.

An index is a table of shards, each some consecutive documents of one input partition in ascending id order.  It has a
row per shard and term (term, df, postings) and one per shard with its documents (ids, lengths).  Postings are LEB128
pairs (gap to the document's place before, occurrences).  Searching joins the postings to the terms of all items, so
only lists that some item asks for are read; each shard then answers a block of items by a k-way heap merge over its
lists in document order, with a bounded heap of results, and the shards' results are merged by score.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tessera.llm.common import lookup, slices, stash

#: Bytes of text of a shard, and items that a shard answers in one task.
SHARD_BYTES, BLOCK_ITEMS = 16 << 20, 500
#: Terms are runs of ASCII letters, digits and other code points than ASCII; A-Z count as a-z, the rest separates.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Place of the text and code of the term of every occurrence, and the terms by code; null is empty."""
    given = pc.fill_null(texts.cast(pa.large_string()), "")
    given = given.take(pa.array(np.arange(len(given)))) if given.offset else given
    _, offsets, data = given.buffers()
    folded = pa.LargeStringArray.from_buffers(len(given), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD)))
    runs = pc.ascii_split_whitespace(folded)
    coded = runs.flatten().dictionary_encode()
    counts = np.diff(runs.offsets.to_numpy())
    places, codes = np.repeat(np.arange(len(given)), counts), coded.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    held = codes != blank
    return places[held], codes[held], coded.dictionary


def leb128(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of non-negative integers, seven bits each, the lowest first, and where each value begins (and the last ends)."""
    size = np.ones(len(values), np.int64)
    for k in range(7, 63, 7):
        size += values >= 1 << k
    cuts = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(np.arange(len(values)), size)
    k = np.arange(cuts[-1]) - cuts[at]
    return ((values[at] >> 7 * k) & 127 | ((k + 1 < size[at]) << 7)).astype(np.uint8), cuts


def from_leb128(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    firsts = np.concatenate([[0], ends[:-1] + 1])
    k = np.arange(len(raw)) - np.repeat(firsts, ends - firsts + 1)
    return np.add.reduceat((raw.astype(np.int64) & 127) << 7 * k, firsts)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of every row's whole text, in the shared folder.

    Every row is a document: equal ids are documents of their own, null ids come last in a shard, and null or empty
    texts are documents without terms.  An empty table gives an empty index.  Other columns are ignored.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = given.schema[0].dataType
    schema = StructType([StructField("shard", LongType()), StructField("term", StringType()), StructField("df", LongType()), StructField("postings", BinaryType()), StructField("ids", ArrayType(id_type)), StructField("lengths", ArrayType(LongType()))])

    def shard_rows(parts: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        whole = whole.take(pc.sort_indices(whole.column("id"), null_placement="at_end"))
        ids, texts = (whole.column(c).combine_chunks() for c in ("id", "text"))
        places, codes, terms = tokens(texts)
        n = len(ids)
        keys, tf = np.unique(codes.astype(np.int64) * n + places, return_counts=True)
        code, place = keys // n, keys % n
        new = np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]
        gaps = np.where(new, place, np.diff(place, prepend=0))
        data, cuts = leb128(np.stack([gaps, tf], 1).reshape(-1))
        firsts = np.flatnonzero(new)
        bounds = np.concatenate([cuts[2 * firsts], cuts[-1:]])
        lists = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        df = np.diff(np.concatenate([firsts, [len(code)]]))
        lengths = np.bincount(places, minlength=n)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(ids.type), pa.list_(pa.int64())]
        rows = len(firsts)
        for at in range(0, rows, 20_000):
            k = min(20_000, rows - at)
            columns = [pa.array(np.full(k, shard)), terms.take(pa.array(code[firsts[at : at + k]])).cast(pa.string()), pa.array(df[at : at + k]), lists.slice(at, k).cast(pa.binary()), pa.nulls(k, kinds[4]), pa.nulls(k, kinds[5])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        one = [pa.array([shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids).cast(kinds[4]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(lengths)).cast(kinds[5])]
        yield pa.RecordBatch.from_arrays(one, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, "text", shard_bytes):
            parts.append(batch)
            held += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if held >= shard_bytes:
                yield from shard_rows(parts, shard)
                shard, parts, held = shard + 1, [], 0
        if any(p.num_rows for p in parts):
            yield from shard_rows(parts, shard)

    return stash(given.mapInArrow(run, schema), "zstd", 32 << 20)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, int]:
    """term, block and the ids of the block's items that have the term, and the number of blocks; items are tokenized as documents are."""
    given = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([StructField("id", given.schema[0].dataType), StructField("term", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            places, codes, terms = tokens(batch.column("text"))
            keys = np.unique(places * max(len(terms), 1) + codes)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keys // max(len(terms), 1))), terms.take(pa.array(keys % max(len(terms), 1))).cast(pa.string())], schema.names)

    pairs = stash(given.where("id is not null").mapInArrow(run, schema))
    blocks = max(1, -(-pairs.select("id").distinct().count() // block_items))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    return stash(pairs.groupBy("term", block.alias("block")).agg(F.collect_set("id").alias("items"))), blocks


def best(lists: Sequence[tuple[Sequence[int], Sequence[int], int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, place), highest first and equal scores by place, of lists (places, scores above 0, their greatest score).

    Document at a time: a heap of cursors yields places in order.  Once k results are held, lists whose greatest scores
    together can't lift a document above the least of them leave the heap; documents that others name still look them up.
    """
    lists = sorted(lists, key=lambda x: x[2])
    bounds = [0]
    for x in lists:
        bounds.append(bounds[-1] + x[2])
    results: list[tuple[int, int]] = []
    least, away = 0, 0
    cursors = [(places[0], i, 0) for i, (places, _, _) in enumerate(lists)]
    heapify(cursors)
    while cursors:
        place, i, at = cursors[0]
        score = 0
        while cursors and cursors[0][0] == place:
            _, i, at = cursors[0]
            places, scores, _ = lists[i]
            score += scores[at]
            if i >= away and at + 1 < len(places):
                heapreplace(cursors, (places[at + 1], i, at + 1))
            else:
                heappop(cursors)
        for i in range(away - 1, -1, -1):
            if score + bounds[i + 1] <= least:
                break
            places, scores, _ = lists[i]
            at = bisect_left(places, place)
            if at < len(places) and places[at] == place:
                score += scores[at]
        if len(results) < k:
            heappush(results, (score, -place))
        elif score > results[0][0]:  # an equal one comes later and loses
            heapreplace(results, (score, -place))
        else:
            continue
        if len(results) == k and results[0][0] > least:
            least = results[0][0]
            if away < len(lists) and bounds[away + 1] <= least:
                while away < len(lists) and bounds[away + 1] <= least:
                    away += 1
                cursors = [c for c in cursors if c[1] >= away]
                heapify(cursors)
    return [(s, -p) for s, p in sorted(results, reverse=True)]


def search(idx: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """id_col, rank, doc_id and score of each item's k best documents with a score above 0.

    Terms weigh floor(1000 ln((2N + 2) / (2 df + 1))), N being the documents with a term; a document's m is
    10 + 90 n N div L, and a term adds w (10^9 tf div (1000 tf + 8 m)), all in integers.  Equal scores rank by ascending
    doc_id, nulls last, then by shard and place.  Rows of items with equal ids are one item with the terms of all;
    those without an id, and items or documents without a term, give no row.
    """
    documents = idx.where("term is null").select("shard", "ids", "lengths")
    of = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    with_terms = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + (b > 0).cast("long"))
    totals = documents.agg(F.sum(with_terms).alias("n"), F.sum(of).alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0

    asked, blocks = item_terms(items, id_col, text_col, block_items)
    distinct = lookup(stash(asked.select("term").distinct()))
    lists = idx.where("term is not null").select("shard", "term", "df", "postings").join(distinct, "term")
    lists = stash(lists, "zstd")
    of_terms = lists.groupBy("term").agg(F.sum("df").alias("df_all"))
    plan = stash(asked.join(of_terms, "term"))
    size = plan.agg(F.count("*"), F.sum(F.size("items"))).first()
    rows = lists.join(lookup(plan, size[0] + (size[1] or 0) // 4), "term").select("shard", "block", "term", "df_all", "df", "postings", "items")
    id_type, item_type = documents.schema["ids"].dataType.elementType, asked.schema["items"].dataType.elementType
    out = StructType([StructField(id_col, item_type), StructField("shard", LongType()), StructField("place", LongType()), StructField("doc_id", id_type), StructField("score", LongType())])

    def run(key: tuple, given: pa.Table, about: pa.Table) -> pa.Table:
        found: list[tuple] = []
        ids = about.column("ids").combine_chunks().flatten()
        if given.num_rows:
            lengths = about.column("lengths").combine_chunks().flatten().to_numpy()
            if 90 * int(lengths.max()) * n_docs < 1 << 63:
                m = 10 + 90 * lengths * n_docs // n_terms
            else:
                m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in lengths], np.int64)
            raw = from_leb128(np.frombuffer(b"".join(given.column("postings").to_pylist()), np.uint8)).reshape(-1, 2)
            of_item: dict[object, list] = {}
            at = 0
            for df, df_all, names in zip(*(given.column(c).to_pylist() for c in ("df", "df_all", "items"))):
                places, tf = np.cumsum(raw[at : at + df, 0]), raw[at : at + df, 1]
                at += df
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df_all + 1)))
                scores = weight * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))
                above = scores > 0
                if above.any():
                    one = (memoryview(places[above]), memoryview(scores[above]), int(scores.max()))
                    for item in names:
                        of_item.setdefault(item, []).append(one)
            found = [(item, place, score) for item, own in of_item.items() for score, place in best(own, k)]
        items_of, places_of, scores_of = zip(*found) if found else ((), (), ())
        where = pa.array(places_of, pa.int64())
        columns = [pa.array(items_of, given.schema.field("items").type.value_type), pa.array([key[0].as_py()] * len(found), pa.int64()), where, ids.take(where), pa.array(scores_of, pa.int64())]
        return pa.Table.from_arrays(columns, out.names)

    # each group is one shard: its lists that the block asks for, and its documents
    about = documents.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    hits = rows.groupBy("shard", "block").cogroup(about.groupBy("shard", "block")).applyInArrow(run, out)
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "shard", "place")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(id_col, "rank", "doc_id", "score")
