"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are permuted by a hash of their id and laid end to end; repeated passes over
that sequence are cut into blocks of ``BLOCK_WORDS`` words.  A binary tree over the output shards splits
the vector of source block quotas: at each node the left half's share of every source is one multivariate
hypergeometric draw, so that a shard's quotas add up to its capacity and a source's over all shards to its
quota, exactly.  Shard j then owns a run of each source's permuted blocks, disjoint from every other
shard's, and orders its pieces by a hash.  The shards are written as narrow rows (which words of which
document, in which place), and what the mix takes is read back from them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, shared_folder, stash

#: Fixed values of the mix: weights in turn, and the most often that any source may repeat.
WEIGHTS, REPEATS = (1, 2, 3), 3
#: Words of a block, blocks of a shard, rows of a bucket, shards that a task deals.
BLOCK_WORDS, SHARD_BLOCKS, BUCKET_ROWS, TASK_SHARDS, SEED = 1024, 4096, 1000, 256, 29
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for sizes of (source, source_size), one row a source.

    Sources in code point order, null last, weigh 1, 2, 3 in turn and share the sum of all sizes; a target
    stops at REPEATS times its source's size, and the excess is shared by weight among the others until
    none is above.  That is the level at which sum(min(cap, level * weight)) is the sum of sizes.
    """
    named = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    rows = named.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * REPEATS).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.coalesce(F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"], F.lit(0.0))
    return rows.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = SEED, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks of each source before it, its blocks of each source) for shards ``low`` to ``high``.

    Shards differ in size by at most one block.  Only nodes over the wanted shards are drawn, each from a
    seed of its own, so any part of the tree can be dealt anywhere and agrees with the whole.
    """
    total, high = int(quotas.sum()), shards if high is None else high
    before = lambda shard: shard * (total // shards) + min(shard, total % shards)
    stack = [(0, shards, np.zeros(len(quotas), np.int64), quotas.astype(np.int64))]
    while stack:
        first, end, start, own = stack.pop()
        if end <= low or first >= high:
            continue
        if end - first == 1:
            yield first, start, own
            continue
        middle = (first + end) // 2
        left = _multivariate(np.random.Generator(np.random.PCG64([seed, first, end])), own, before(middle) - before(first))
        stack += [(middle, end, start + left, own - left), (first, middle, start, left)]


def _multivariate(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """One multivariate hypergeometric draw, source by source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(map(int, counts)):
        rest -= n
        if n and draws:
            out[i] = hypergeometric(rng, n, rest, draws)
            draws -= int(out[i])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good: numpy's draw, and the same ratio of uniforms beyond its bound."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    return _ratio_of_uniforms(rng, good, bad, draws)


def _log_factorials(a: int, b: int) -> float:
    """log a! - log b!, without cancellation between large ones."""
    if min(a, b) < 1_000_000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    return (a + 0.5) * math.log1p((a - b) / b) + (a - b) * (math.log(b) - 1) + (1 / a - 1 / b) / 12


def _ratio_of_uniforms(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Stadlober's rejection from the ratio of two uniforms, on the smaller kind and the smaller part."""
    whole, few, many = good + bad, min(good, bad), max(good, bad)
    part = min(draws, whole - draws)
    if not part or not few:
        found = 0
    else:
        share = few / whole
        centre, spread = part * share + 0.5, math.sqrt((whole - part) * part * share * (1 - share) / (whole - 1) + 0.5)
        width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
        mode = (part + 1) * (few + 1) // (whole + 2)
        while True:
            x, y = rng.random(), rng.random()
            w = centre + width * (y - 0.5) / x if x else -1.0
            if not 0 <= w < min(part, few) + 1:
                continue
            found = int(w)
            density = _log_factorials(mode, found) + _log_factorials(few - mode, few - found) + _log_factorials(part - mode, part - found) + _log_factorials(many - part + mode, many - part + found)
            if 2 * math.log(x) <= density:
                break
    found = part - found if good > bad else found
    return good - found if part < draws else found


def _running(sums: DataFrame, bits: int) -> DataFrame:
    """key, bucket, base (words of the key's buckets before), in two steps, so that no window holds all buckets of a key."""
    fine = sums.withColumn("coarse", F.shiftright("bucket", bits // 2))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = fine.groupBy("key", "coarse").agg(F.sum("words").alias("words"))
    coarse = coarse.select("key", "coarse", F.coalesce(F.sum("words").over(before("key", "coarse")), F.lit(0)).alias("far"))
    near = fine.withColumn("near", F.coalesce(F.sum("words").over(before("key", "coarse", "bucket")), F.lit(0)))
    return near.join(coarse, ["key", "coarse"]).select("key", "bucket", (F.col("near") + F.col("far")).alias("base"))


def _key(source: Column) -> Column:
    """A source's name as a join key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): rows with their word count and place in the source's permuted sequence; targets.

    Rows: id, same (a hash of the whole row), source, key, size, bucket, seq (key, bucket and seq name a row), start
    (words of the source before it).
    """
    whole = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    base = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("hash"), whole.alias("same")))
    bits = max(4, (base.count() // BUCKET_ROWS).bit_length())
    # rows of one id (or of none) hash alike, so their places come from the whole row besides
    base = base.withColumn("hash", F.xxhash64("hash", "same")).withColumn("bucket", F.shiftrightunsigned("hash", 64 - bits)).withColumn("key", _key(F.col("source")))
    sums = stash(base.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words")))
    sources = stash(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))))
    bases = stash(_running(sums, bits))
    within = Window.partitionBy("key", "bucket").orderBy("hash", "id", "size")
    rows = base.withColumn("seq", F.row_number().over(within)).withColumn("start", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(lookup(bases), ["key", "bucket"]).withColumn("start", F.col("start") + F.col("base"))
    return stash(rows.select("id", "same", "source", "key", "size", "bucket", "seq", "start")), sources


def plan(sources: DataFrame, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """key, shard, first, last: the run of permuted blocks that each shard draws from each source.

    The driver holds one quota a source; every task deals its own shards' part of the tree.
    """
    quotas = sources.select(_key(F.col("source")).alias("key"), F.ceil(F.round("target") / BLOCK_WORDS).cast("long").alias("n")).orderBy("key").collect()
    keys, counts = [r["key"] for r in quotas], np.array([r["n"] for r in quotas], np.int64)
    shards = max(1, -(-int(counts.sum()) // shard_blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in batch.column(0).to_pylist():
                rows = [(keys[i], shard, int(start[i]), int(start[i] + own[i] - 1)) for shard, start, own in splitting_tree(counts, shards, seed, low, min(shards, low + TASK_SHARDS)) for i in np.flatnonzero(own)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["key", "shard", "first", "last"])

    spark = sources.sparkSession
    return spark.range(0, shards, TASK_SHARDS, -(-shards // TASK_SHARDS)).mapInArrow(deal, "key string, shard long, first long, last long")


def draws(rows: DataFrame, sources: DataFrame, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The pieces that shards draw: shard, position, id, same, key, bucket, seq, pass, from_word, words. Position orders a shard's pieces."""
    known = rows.join(lookup(sources.withColumn("key", _key(F.col("source"))).drop("source")), "key").withColumn("quota", F.round("target").cast("long"))

    def piece(p: int, a: Column, k: Column) -> Column:
        """What block k has of the words from a on."""
        low = F.greatest(a, k * BLOCK_WORDS)
        high = F.least(a + F.col("size"), (k + 1) * BLOCK_WORDS, F.col("quota"))
        return F.struct(F.lit(p).alias("pass"), k.alias("block"), (low - a).alias("from_word"), (high - low).alias("words"))

    def of_pass(p: int) -> Column:
        a = p * F.col("source_size") + F.col("start")
        end = F.least(a + F.col("size"), F.col("quota"))
        return F.when(end > a, F.transform(F.sequence(F.floor(a / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS)), lambda k: piece(p, a, k))).otherwise(F.array())

    pieces = known.select("id", "same", "key", "bucket", "seq", F.explode(F.concat(*(of_pass(p) for p in range(REPEATS)))).alias("x")).select("*", "x.*").drop("x")
    blocks = plan(sources, seed, shard_blocks).select("key", "shard", F.explode(F.sequence("first", "last")).alias("block"))
    out = pieces.join(blocks, ["key", "block"])
    return out.select("shard", F.xxhash64("shard", "key", "block", "seq", "pass", F.lit(seed)).alias("position"), "id", "same", "key", "bucket", "seq", "pass", "from_word", "words")


def write_shards(rows: DataFrame, sources: DataFrame, path: str, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> None:
    """Write the mix: each shard's pieces together, in the order of their positions."""
    draws(rows, sources, seed, shard_blocks).repartitionByRange("shard").sortWithinPartitions("shard", "position").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken (words drawn, repeats counted), shards.

    The shards are written to the shared folder, and ``taken`` adds up what is read back from them.  A null
    text has size 0 and is never drawn; a null source is a source of its own; a table without words takes
    nothing.  Ids may be null or repeat: each row counts for itself.  The same rows and seed give the same mix.
    """
    rows, sources = placed(docs, id_col, text_col, source_col, seed)
    path = shared_folder(docs.sparkSession)
    write_shards(rows, sources, path, seed, shard_blocks)
    own = ["key", "bucket", "seq"]
    taken = read_shards(docs.sparkSession, path).groupBy(*own).agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("shards"))
    known = rows.join(lookup(sources.withColumn("key", _key(F.col("source"))).drop("source")), "key").join(taken, own, "left")
    return known.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit(0)).alias("shards"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``docs`` in the mix's proportions and order: each as many times as the mix takes it, rounded half up.

    Whole documents only; all columns stay, whatever their names, and copies are equal rows.  A copy lies where its
    pass over the source put the document's first piece, in shard order.  Rows that are equal in all columns are
    taken equally often, the mean of what the shards take of them; null and repeated ids are rows like others.
    """
    rows, sources = placed(docs, id_col, text_col, source_col, seed)
    path = shared_folder(docs.sparkSession)
    write_shards(rows, sources, path, seed, shard_blocks)
    each = rows.groupBy("same").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    passes = read_shards(docs.sparkSession, path).groupBy("same", "pass").agg(F.sum("words").alias("words"), F.min(F.struct("from_word", "shard", "position")).alias("first"))
    drawn = passes.groupBy("same").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(F.struct("pass", "first.shard", "first.position"))).alias("places"))  # at most REPEATS of them
    times = drawn.join(each, "same").withColumn("times", F.floor(F.col("words") / (F.col("n") * F.greatest("size", F.lit(1))) + 0.5).cast("int"))
    times = stash(times.where("times > 0").select("same", "places", "times"))
    whole = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    copies = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), whole.alias("same")).join(lookup(times), "same")
    copies = copies.select("doc", "places", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    place = F.col("places")[F.least("copy", F.size("places")) - 1]
    return copies.select("doc", place["shard"].alias("shard"), place["position"].alias("position")).repartitionByRange("shard").sortWithinPartitions("shard", "position").select("doc.*")
