"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

1. ``signed``: one pass over the texts gives each set's size, a 128-bit fingerprint and its tile
   keys.  Documents with equal sets form a class; only a class's first member goes on, so exact
   copies cost one row whatever their number.
2. Tile keys.  If two sets link, at most h = size * (1 - t) / t shingles are in one of them only.
   The hash space is cut into p > h ranges, p depending on the set's power-of-two size level (sets
   near a level's end also take the next level's p).  At least p - h ranges hold equal subsets in
   both, so the h + 1 ranges that come first in an order on (subset size, hash) always include a
   common one: its hash is the tile key.  No link is lost and no frequency table is needed.
3. Documents that share a key are connected through the key's least member, within each task before
   the shuffle and then over all tasks, so a hot key sends one row a task; the components of that graph (a superset of the real ones) bound what must be compared.
4. Each such component is cut into size bands of ratio t, each band into blocks, and every pair of
   blocks that can hold a link is one tile.  In a tile, sets become bitmaps of at least twice as many
   bits; a + b - popcount(x xor y) bounds twice the overlap from above, and pairs within the bound
   are intersected exactly.  A union-find keeps the tile's components, and each set adds up the
   documents of the classes it links with.  Joined over all tiles, they are the components of all
   links and each class's number of links.  Where only components are asked for, pairs already
   connected are skipped.

Nothing is capped or sampled; pairs are never rows, only edges to a component's least member and one
count a set and tile are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, lookup, slices, stash, takes_worker
from tessera.llm.components import components
from tessera.llm.shingles import mix, shingle_sets

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
#: Sets of a block at least, blocks of a band before blocks grow, and sets and shingles (8 bytes each) of a block at most.
BLOCK_LEAST, BLOCKS, BLOCK_MOST, BLOCK_SHINGLES = 128, 8, 2048, 2_000_000
#: Keys that a task combines at once before the shuffle.
COMBINE_ROWS = 2_000_000


def tile_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tile keys of one sorted distinct set for the threshold num / den."""
    size = len(shingles)
    if not size:
        return np.zeros(0, _U)
    most = size * (den - num) // num
    level, mixed, out = size.bit_length(), mix(shingles), []
    for lev in (level, level + 1) if size * den // num >= 1 << level else (level,):
        need = max(1, ((1 << lev) - 1) * (den - num) // num + 1)
        bits = (need - 1).bit_length()
        if bits:
            cut = np.searchsorted(shingles, np.arange(1 << bits, dtype=_U) << _U(64 - bits))
        else:
            cut = np.zeros(1, np.int64)
        held = np.diff(np.append(cut, size))
        hashed = np.zeros(len(cut), _U)
        hashed[held > 0] = np.add.reduceat(mixed, cut[held > 0])
        hashed = mix(hashed + np.arange(len(cut), dtype=_U) * _U(_GOLD) + _U((lev * 0xD6E8FEB86659FD93) % 2**64))
        if len(cut) > most + 1:
            hashed = hashed[np.lexsort((hashed, -held))[: most + 1]]
        out.append(hashed)
    return np.concatenate(out)


def signed(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """id, n_words, n_shingles, fp_a, fp_b, keys for docs of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_worker("ngram_jaccard")
        for batch in slices(batches, "text"):
            words, sizes, a, b, keys = [], [], [], [], []
            for count, own in shingle_sets(batch.column("text"), n):
                words.append(count)
                sizes.append(len(own))
                a.append(np.add.reduce(mix(own ^ _U(0x5851F42D4C957F2D)), initial=_U(0)))
                b.append(np.add.reduce(mix(own ^ _U(0x14057B7EF767814F)), initial=_U(0)))
                keys.append(tile_keys(own, num, den).view(np.int64))
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(a, _U).view(np.int64)), pa.array(np.array(b, _U).view(np.int64)), pa.ListArray.from_arrays(pa.array(at), flat)],
                ["id", "n_words", "n_shingles", "fp_a", "fp_b", "keys"],
            )

    return docs.mapInArrow(run, "id long, n_words long, n_shingles long, fp_a long, fp_b long, keys array<long>")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, null) once for every key of this task's sets, by its least id, and (-, id, low) for each other id.

    The shuffle then carries at most one row a key and task, however many sets share the key.
    """
    takes_worker("ngram_jaccard")
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        keys, ids = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.append(True, keys[1:] != keys[:-1])
        low = np.repeat(ids[first], np.diff(np.append(np.flatnonzero(first), len(ids))))
        shown = first | (ids != low)  # an id that repeats a key adds nothing
        where = np.where(first, keys, mix(ids.view(_U)).view(np.int64))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(where[shown]), pa.array(ids[shown]), pa.array(low[shown], mask=first[shown])], ["key", "id", "low"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("keys")
        sizes = np.diff(keys.offsets.to_numpy())
        held.append((keys.flatten().to_numpy(), np.repeat(batch.column("id").to_numpy(), sizes)))
        if sum(len(k) for k, _ in held) >= COMBINE_ROWS:
            yield flush()
    if held:
        yield flush()
    give_back()


def _key_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each id with the least one of its key; rows come in order of key and id."""
    last = None
    for batch in batches:
        keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        ready = batch.column("low").is_valid().to_numpy(zero_copy_only=False)
        a, b = [batch.column("low").drop_null().to_numpy()], [ids[ready]]
        keys, ids = keys[~ready], ids[~ready]
        if len(keys):
            first = np.append(True, keys[1:] != keys[:-1])
            low = np.repeat(ids[first], np.diff(np.append(np.flatnonzero(first), len(ids))))
            if last is not None and last[0] == keys[0]:
                low[keys == keys[0]] = last[1]
            a.append(low[low != ids])
            b.append(ids[low != ids])
            last = keys[-1], low[-1]
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def sets_of(docs: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_shingles and the sorted set as binary."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            own = [s for _, s in shingle_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())],
                [*keep, "n_shingles", "shingles"],
            )

    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", n_shingles long, shingles binary")


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of ``bits`` bits a set; a shingle sets the bit its low hash bits name."""
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, own in zip(out, sets):
        place = (own & _U(bits - 1)).astype(np.int64)
        np.bitwise_or.at(row, place >> 3, (1 << (place & 7)).astype(np.uint8))
    return out.view(_U)


#: Side of the sets of a tile whose pairs are all compared; in other tiles, sets of side 0 meet those of side 1.
WITHIN = 2


def _numbered(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The sets end to end with their shingles numbered densely, where each starts, and how many numbers there are."""
    starts = np.cumsum([0, *map(len, sets)])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    return flat.astype(np.int32), starts, len(known)


def tile_links(ids: list[int], copies: list[int], sets: list[np.ndarray], sides: list[int], num: int, den: int, counted: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """A tile's components as edges to each one's least id, and (id, documents of the sets it links with).

    The sets are not empty and unlike each other.  If not ``counted``, the second list is empty and pairs that are
    already connected aren't compared.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, ids, side = [sets[i] for i in order], [ids[i] for i in order], np.array([sides[i] for i in order])
    weight, total = np.array([copies[i] for i in order], np.int64), np.zeros(len(sets), np.int64)
    sizes = np.array([len(s) for s in sets])
    bits = max(64, 1 << int(2 * sizes[-1] - 1).bit_length())
    maps, two = bitmaps(sets, bits), bool((side != WITHIN).any())
    group, numbered, mark = np.arange(len(sets)), None, None
    for i in range(1, len(sets)):
        low = int(np.searchsorted(sizes[:i], -(-sizes[i] * num // den)))
        other = np.flatnonzero(side[low:i] != side[i]) + low if two else np.arange(low, i)
        if not counted:
            other = other[group[other] != group[i]]
        if not len(other):
            continue
        apart = np.bitwise_count(maps[other] ^ maps[i]).sum(axis=1, dtype=np.int64)
        near = apart * (den + num) <= (sizes[other] + sizes[i]) * (den - num)
        other = other[near][np.argsort(apart[near], kind="stable")]
        if counted and len(other):
            if numbered is None:
                numbered = _numbered(sets)
                mark = np.zeros(numbered[2], bool)
            flat, starts, _ = numbered
            own = flat[starts[i] : starts[i + 1]]
            mark[own] = True
            both = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j + 1]]]) for j in other.tolist()], np.int64)
            mark[own] = False
            linked = other[den * both >= num * (sizes[i] + sizes[other] - both)]
            total[i] += weight[linked].sum()
            total[linked] += weight[i]
            if len(linked):
                group[np.isin(group, group[linked])] = group[i]
            continue
        while len(other):
            j = other[0]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                group[group == group[i]] = group[j]
            other = other[1:]
            other = other[group[other] != group[i]]
    least: dict[int, int] = {}
    for g, i in zip(group.tolist(), ids):
        least[g] = min(least.get(g, i), i)
    return [(i, least[g]) for g, i in zip(group.tolist(), ids) if i != least[g]], [(i, n) for i, n in zip(ids, total.tolist()) if n]


def _tile_links(num: int, den: int, counted: bool):
    """Rows (a, b, null) for the edges of a tile's components and (a, null, n) for its sets' links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                _, ids, copies, sides, sets = zip(*held)
                edges, counts = tile_links(ids, copies, [np.frombuffer(x, _U) for x in sets], sides, num, den, counted)
                if edges or counts:
                    rows = [(a, b, None) for a, b in edges] + [(a, None, n) for a, n in counts]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["a", "b", "n"])
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "id", "copies", "side", "shingles"))):
                if held and held[0][0] != row[0]:
                    yield from close()
                held.append(row)
        yield from close()
        give_back()

    return run


def tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (tile, id, copies, side, shingles): every member of a component in each tile it belongs to.

    A member's block pairs with its own band's blocks and with those of the next band; the smaller
    block of a pair within a band, and the lower band of a pair across, is side 0.  A block with
    itself, or a small component, is WITHIN.  So any two members meet in one tile at most.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(den / num)) + 1e-9) if num < den else F.col("n_shingles")
    rows = members.withColumn("band", band.cast("long"))
    counts = rows.groupBy("component", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("held"))
    counts = counts.withColumn("blocks", F.greatest(F.least(F.ceil(F.col("n") / BLOCK_LEAST), F.lit(BLOCKS)), F.ceil(F.col("n") / BLOCK_MOST), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("long"))
    after, before = (counts.select("component", (F.col("band") + d).alias("band"), F.col("blocks").alias(name)) for d, name in ((-1, "above"), (1, "below")))
    plan = counts.join(after, ["component", "band"], "left").join(before, ["component", "band"], "left").fillna(0)
    small = (F.sum("n") <= BLOCK_LEAST) & (F.sum("held") <= 2 * BLOCK_SHINGLES)
    total = counts.groupBy("component").agg(small.alias("small"))
    plan = stash(plan.join(total, "component").select("component", "band", "blocks", "above", "below", "small"))
    placed = rows.join(lookup(plan), ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))

    def name(*parts) -> F.Column:
        return F.concat_ws(":", "component", *parts)

    def each(count: str, made) -> F.Column:
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), made)).otherwise(F.array())

    def place(tile: F.Column, side) -> F.Column:
        return F.struct(tile.alias("tile"), (F.lit(side) if isinstance(side, int) else side).cast("int").alias("side"))

    block = F.col("block")
    whole = F.array(place(name(F.lit("all")), WITHIN))
    own = each("blocks", lambda o: place(name(F.col("band"), F.least(block, o), F.greatest(block, o)), F.when(block == o, WITHIN).otherwise((block > o).cast("int"))))
    up = each("above", lambda o: place(name(F.col("band"), F.lit("up"), block, o), 0))
    down = each("below", lambda o: place(name(F.col("band") - 1, F.lit("up"), o, block), 1))
    spread = F.when(F.col("small"), whole).otherwise(F.concat(own, up, down))
    return placed.select("id", "copies", "shingles", F.explode(spread).alias("x")).select(F.col("x.tile").alias("tile"), "id", "copies", F.col("x.side").alias("side"), "shingles")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", counted: bool = True) -> DataFrame:
    """Classes of documents whose n-word shingle sets have Jaccard similarity num / den or more.

    Returns one row per document: ``id_col``, n_shingles, component_id (least id reachable through
    links, its own without any), class_id (least id with the same set), n_words and, if ``counted``,
    n_links (other documents at that similarity or more, those of its own class included).  Null or empty
    texts, and texts of white space only, have the empty set and link with nothing.  Ids are
    integers; rows that repeat one are documents of their own, are returned each and share its component; a row whose id is null is
    returned with a null component and links with nothing.  Extra columns of ``docs`` are ignored, and an empty table gives
    an empty result.  Shingles are compared by 64-bit hashes.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold is to be in (0, 1]")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = stash(signed(texts, n, num, den))
    if base.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return _of_repeated_ids(texts, n, num, den, id_col, counted)
    fp = ["n_shingles", "fp_a", "fp_b"]
    classes = base.where("n_shingles > 0 and id is not null").groupBy(*fp).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = stash(classes.where("copies > 1"))
    known = base.join(lookup(classes), fp, "left").withColumn("class_id", F.when(F.col("id").isNotNull(), F.coalesce("first", "id")))
    known = known.withColumn("copies", F.when(F.col("id").isNotNull(), F.coalesce("copies", F.lit(1))).otherwise(1))
    keys = known.where("class_id = id and n_shingles > 0").select("id", "keys")
    combined = keys.mapInArrow(_combined, "key long, id long, low long")
    edges = combined.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_key_edges, "a long, b long")
    candidates = components(edges)
    of_class = lookup(classes.select(F.col("first").alias("id"), "copies"))
    chosen = texts.join(lookup(candidates), "id").join(of_class, "id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    members = sets_of(chosen, n, ["id", "component", "copies"])
    placed = tiles(stash(members), num, den)
    linked = stash(placed.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_links(num, den, counted), "a long, b long, n long"))
    links = components(linked.where("b is not null").select("a", "b"))
    if counted:
        counts = linked.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        links = stash(links.join(counts, "id"))
    named = known.join(lookup(links).withColumnRenamed("id", "class_id"), "class_id", "left")
    shown = [F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id", "n_words"]
    return named.select(*shown, *([(F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")] if counted else []))


def _of_repeated_ids(texts: DataFrame, n: int, num: int, den: int, id_col: str, counted: bool) -> DataFrame:
    """The same where rows repeat ids: rows are numbered and compared as documents; rows of one id then share a component."""
    rows = stash(texts.withColumn("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())))
    found = near_duplicates(rows.select("row", "text"), n, num, den, "row", "text", counted)
    found = stash(found.where("row is not null").join(rows.select("row", "id"), "row"))
    shared = found.groupBy("id").agg(F.min("component_id").alias("low"))
    merged = components(found.select("id", "component_id").distinct().join(shared, "id").where("component_id <> low").select(F.col("component_id").alias("a"), F.col("low").alias("b")))
    whole = found.join(merged.withColumnsRenamed({"id": "component_id", "component": "whole"}), "component_id", "left").withColumn("whole", F.coalesce("whole", "component_id"))
    least = lambda key, name: whole.groupBy(key).agg(F.min("id").alias(name))
    named = whole.join(least("whole", "component"), "whole").join(least("class_id", "class"), "class_id")
    links = ["n_links"] if counted else []
    out = named.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.col("class").alias("class_id"), "n_words", *links)
    if not rows.where("id is null").limit(1).count():
        return out
    nothing = near_duplicates(rows.where("id is null").select(F.col("id").alias(id_col), "text"), n, num, den, id_col, "text", counted)
    return out.unionByName(nothing)


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the first of their near-duplicate component; all columns stay, whatever their names.

    Documents without a set (no words) are kept, as are rows with a null id; of rows that repeat an id all are kept or none.
    """
    found = near_duplicates(docs, n, num, den, id_col, text_col, counted=False).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).cast("long").alias("id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return rows.join(found, rows["doc"][id_col] == found["id"], "left_anti").select("doc.*")
