"""Best-fit packing of token ids into sequences of bounded length, planned on the histogram of lengths.

Texts are tokenized once into pieces of at most ``capacity`` ids.  The plan sees how many pieces each length has,
never the pieces: best-fit decreasing over counts, where bins of equal fill are runs of consecutive sequence ids.
Pieces then take the planned slots by their rank within their length, which is the number of equally long
pieces in earlier blocks plus the place among those of their own block.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tessera.llm.common import lookup, slices, stash
from tessera.llm.token_files import SLICE_BYTES, words

#: Tokens of a sequence.
CAPACITY = 4096


class Slots(NamedTuple):
    """Pieces of ``length`` from ``rank`` on, ``each`` of them a sequence, in ``count`` sequences from ``first`` on, behind ``offset`` tokens."""

    length: int
    rank: int
    each: int
    first: int
    count: int
    offset: int


def best_fit(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """The slots of best-fit decreasing: each piece, longest first, goes where the least room that holds it is left.

    Sequences with equal room are interchangeable, so a whole run of them is filled at once: after one piece of a
    length a sequence is the tightest for the next until it can't hold another.  Work and slots depend on the number
    of lengths, not on that of the pieces: a length splits one run at most.
    """
    slots: list[Slots] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                insort(rooms, left)
            room.setdefault(left, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first, count = capacity, opened, -(-todo // (capacity // length))
                opened += count
            each = left // length
            full = min(count, todo // each)
            if full:
                slots.append(Slots(length, rank, each, first, full, capacity - left))
                put(left - each * length, first, full)
                todo, rank, first, count = todo - full * each, rank + full * each, first + full, count - full
            if count and todo:  # fewer than fill another sequence
                slots.append(Slots(length, rank, todo, first, 1, capacity - left))
                put(left - todo * length, first, 1)
                todo, first, count = 0, first + 1, count - 1
            put(left, first, count)
    return slots


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, its block, its place among the block's pieces of that length, and ids if kept."""
    given = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    name = given.columns[0]
    fields = [StructField(name, given.schema[0].dataType), *(StructField(c, LongType()) for c in ("piece", "start", "length", "ids_crc32", "__block", "__place"))]
    schema = StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, seen = words(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "__text", SLICE_BYTES):
            rows, piece, start, length, crc, place, kept = [], [], [], [], [], [], []
            for i, raw in enumerate(own.encode(batch.column("__text"), end)):
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    place.append(seen[n])
                    seen[n] += 1
                    if keep:
                        kept.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (piece, start, length, crc, [block] * len(rows), place))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * keep, schema.names)

    return given.mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there; with ``keep`` its ids too.

    A text (null: empty) is its ids by the tokenizer, without special tokens added, then ``end``.  Only texts of more than
    ``capacity`` ids are cut, into pieces of that size but the last.  Sequences are numbered from 0 and filled gapless from
    offset 0.  Every row is a document of its own: null and repeated ids are kept as they are, equal texts take slots of their
    own.  An empty table gives no rows.  Other columns of ``docs`` are ignored, whatever their names.
    """
    cut = stash(pieces(docs, tokenizer_path, capacity, end, id_col, text_col, keep), "zstd")
    held = stash(cut.groupBy("__block", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length: at most ``capacity``
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stash(held.select("__block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")))
    ranked = cut.join(lookup(bases), ["__block", "length"]).withColumn("__rank", F.col("__base") + F.col("__place"))
    name = cut.columns[0]
    out = StructType([cut.schema[name], *(StructField(c, LongType()) for c in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"))] + [f for f in cut.schema if f.name == "ids"])
    plan = np.array(sorted(best_fit(histogram, capacity)), np.int64).reshape(-1, 6)
    keys = plan[:, 0] << 48 | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            _, base, each, first, _, offset = plan[np.searchsorted(keys, length << 48 | rank, "right") - 1].T
            added = {"sequence_id": pa.array(first + (rank - base) // each), "offset": pa.array(offset + (rank - base) % each * length)}
            yield pa.RecordBatch.from_arrays([added.get(c) if c in added else batch.column(c) for c in out.names], out.names)

    return ranked.select(*(c for c in cut.columns if c not in ("__block", "__place")), "__rank").mapInArrow(run, out)


def sequences(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, n_tokens, the ids in order and the parts (id, piece, offset) of each sequence; ``placed`` has kept ids.

    A group is one sequence, so it holds at most the capacity of it.
    """
    part = F.struct("offset", F.col(id_col).alias("id"), "piece", "ids")
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(part)).alias("p")).select(
        "sequence_id", "n_tokens", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("parts"))
