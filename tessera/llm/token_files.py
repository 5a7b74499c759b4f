"""Token-id files: ids of documents in id order, entropy-coded in independent blocks.

A file set is a folder of two tables.  ``table``: the shared frequencies, one row a symbol.  ``blocks``:
(shard, block, start, doc_ids, lengths, crc32s, payload), each row a self-contained block of whole
documents with their index, their checksums and the coded ids (see ``rans``).  Shards hold consecutive
ranges of ids, so that (shard, block, place in the block) is the order of ids.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tessera.llm.common import slices, stash
from tessera.llm.rans import Table, frequencies

#: A block closes with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
#: Words in a generation of a worker's cache (two are kept), and bytes of text that are encoded together.
CACHE_WORDS, SLICE_BYTES = 400_000, 8 << 20
#: Letters whose lower case is one letter and that neither compose nor decompose in NFC, and ASCII marks but the apostrophe:
#: a run of such letters is one pre-token, marks behind it are another.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: What the model's tokens at the end of a pre-token end with.
_END = "</w>"


class Words:
    """A tokenizer that drops white space and works word by word, with its results by word in a bounded cache.

    The library encodes every distinct run of characters between white space once: its normalizers, pre-tokenizers
    and added tokens never look across it, which a test holds against encoding whole texts.  Runs of plain letters
    (``_PLAIN``) go to the same model without the normalizer, many at a time; all others through the whole library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith(_END)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, lower: list[str]) -> list[bytes]:
        """Ids of runs of plain letters in lower case; each is one pre-token and ends with a token that ends one."""
        out = []
        for e in self.letters.encode_batch_fast([" ".join(lower[at : at + 200]) for at in range(0, len(lower), 200)], add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            raw, cut = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *cut], cut)]
        if len(out) != len(lower):
            raise ValueError("the model splits words otherwise")
        return out

    def _whole(self, runs: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def learned(self, found: list[str]) -> list[bytes]:
        """Ids of distinct runs."""
        out = [self.young.get(w) for w in found]
        fresh = [i for i, ids in enumerate(out) if ids is None]
        older = self.old
        if len(self.young) + len(fresh) > CACHE_WORDS:
            self.old, self.young = self.young, {w: ids for w, ids in zip(found, out) if ids is not None}
        young = self.young
        plain, cores, tails, odd = [], [], [], []
        for i in fresh:
            w = found[i]
            if (ids := older.get(w)) is not None:
                out[i] = young[w] = ids
            elif w.isascii() and w.isalpha():
                plain.append(i)
                cores.append(w.lower())
                tails.append("")
            elif m := _PLAIN.fullmatch(w):
                plain.append(i)
                core, tail = m.groups()
                cores.append(core.lower())
                tails.append(tail)
            else:
                odd.append(i)
        ready = {w: ids for w in {*cores} if (ids := young.get(w) or older.get(w)) is not None}
        need = list({*cores}.difference(ready))
        ready.update(zip(need, self._plain(need)))
        marks = list({*tails} - {""})
        ends = {"": b""} | dict(zip(marks, self._whole(marks)))
        for i, core, tail in zip(plain, cores, tails):
            out[i] = young[found[i]] = ready[core] + ends[tail]
        for i, ids in zip(odd, self._whole([found[i] for i in odd])):
            out[i] = young[found[i]] = ids
        return out

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text (null: empty), the end id last."""
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        runs = pieces.flatten().dictionary_encode()
        known = pa.array(self.learned(runs.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        _, stops, data = known.take(runs.indices).buffers()
        cuts = np.frombuffer(stops, np.int64)[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()].tolist()
        last, data = np.array([end], "<u4").tobytes(), memoryview(data or b"")
        return [b"".join([data[a:b], last]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def _raw(size: int) -> str:
    """The type of ids in plain blocks."""
    return "<u2" if size <= 1 << 16 else "<u4"


def counted(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each symbol occurs in blocks of raw ids: each task adds up its own, at most a row a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                total += np.bincount(np.frombuffer(raw, _raw(size)), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["symbol", "n"])

    counts = np.zeros(size, np.int64)
    for r in blocks.select("payload").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["symbol"]] = r["n"]
    return counts


def raw_blocks(docs: DataFrame, tokenizer_path: str, end: int) -> DataFrame:
    """Blocks of whole documents in id order, their payload the plain ids; ``docs`` has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many strings and no cycles
        own, shard = words(tokenizer_path), TaskContext.get().partitionId()
        ids, parts, held, block, start = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            row = [[shard], [block], [start], [ids], [[len(p) // 4 for p in parts]], [[zlib.crc32(p) for p in parts]], [np.frombuffer(b"".join(parts), "<u4").astype(_raw(own.size)).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _BLOCK_TYPES)], list(_BLOCK))

        for batch in slices(batches, "text", SLICE_BYTES):
            for i, part in zip(batch.column("id").to_pylist(), own.encode(batch.column("text"), end)):
                ids.append(i)
                parts.append(part)
                held += len(part) // 4
                if held >= BLOCK_IDS:
                    yield close()
                    start, block, ids, parts, held = start + held, block + 1, [], [], 0
        if ids:
            yield close()
        gc.enable()

    ordered = docs.repartitionByRange("id").sortWithinPartitions("id", "text")
    return ordered.mapInArrow(run, _BLOCK_SCHEMA)


def write_files(docs: DataFrame, path: str, tokenizer_path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text (null: empty), append ``end``, and write the file set in id order.

    Texts are tokenized once into plain blocks in the shared folder; their counts make the shared table, with
    which each block is then coded on its own.  Rows with a null id come first; equal ids are ordered by text.
    Literals of the tokenizer's special tokens are those tokens, as the library has them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    plain = stash(raw_blocks(texts, tokenizer_path, end), "zstd", 16 << 20)
    size = words(tokenizer_path).size
    freq = frequencies(counted(plain, size))
    docs.sparkSession.createDataFrame([(int(i), int(f)) for i, f in enumerate(freq)], "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for i in range(batch.num_rows):
                coded = table.encode(np.frombuffer(batch.column("payload")[i].as_py(), _raw(size)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in list(_BLOCK)[:-1]), pa.array([coded], pa.binary())], list(_BLOCK))

    plain.mapInArrow(run, _BLOCK_SCHEMA).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks")


_BLOCK = {"shard": "long", "block": "long", "start": "long", "doc_ids": "array<long>", "lengths": "array<long>", "crc32s": "array<long>", "payload": "binary"}
_BLOCK_SCHEMA = ", ".join(f"{k} {v}" for k, v in _BLOCK.items())
_BLOCK_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())


def read_files(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with ``keep``, ids.

    Every block is decoded, every segment's and document's checksum compared; a difference fails.
    """
    table = spark.read.schema("symbol long, frequency long").parquet(f"{path}/table").orderBy("symbol").collect()  # one row a symbol
    freq = np.array([r["frequency"] for r in table], np.int64)
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = blocks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    bases = stash(totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))  # one row a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for shard, start, ids, lengths, crcs, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "doc_ids", "lengths", "crc32s", "payload"))):
                symbols = table.decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                parts = [symbols[e - n : e] for e, n in zip(ends, lengths)]
                found = [zlib.crc32(p.tobytes()) for p in parts]
                if found != crcs:
                    raise ValueError("a document's checksum differs")
                columns = [pa.array([shard] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))] if keep else []), ["shard", "doc_id", "at", "n_tokens", "ids_crc32"] + (["ids"] if keep else []))

    rows = blocks.mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep else ""))
    return rows.join(bases, "shard").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep else []))
