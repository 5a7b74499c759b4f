"""Document fingerprints by consistent weighted sampling, with DataFrame and SQL functions only.

A text's terms are its lower-cased words, weighted by their counts.  For each of ``SAMPLES`` draws k and each
term, r and c from Gamma(2, 1) and b from U(0, 1) come from hashes of (term, k); with weight w,
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1).  The draw's sample is (term, t) of the least a, so
two texts agree on a draw with the probability of their generalised Jaccard similarity,
sum of min(w) / sum of max(w).  A fingerprint holds a 32-bit code of each sample in hexadecimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import lookup, stash

#: Draws a fingerprint (a likeness's standard error is at most half over their root), and rows of a neighbour bucket.
SAMPLES, BUCKET_ROWS = 32, 256
SEPARATORS = r"[\x20\x09-\x0D]+"


def terms(text: str) -> str:
    """SQL for the array of (h, w) of a text: hashes of its words and how often each occurs."""
    hashes = f"array_sort(transform(filter(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != ''), x -> xxhash64(x)))"
    firsts = "filter(sequence(1, size(s)), i -> i = 1 or s[i - 1] != s[i - 2])"
    counted = f"transform(array({hashes}), s -> if(size(s) = 0, array(), transform(array({firsts}), f -> zip_with(f, concat(slice(f, 2, size(f)), array(size(s) + 1)), (a, z) -> struct(s[a - 1] as h, z - a as w)))[0]))[0]"
    return counted


def _uniform(source: str, shift: int, bits: int) -> str:
    """SQL for a number in (0, 1) from some bits of a hash."""
    return f"(((shiftrightunsigned({source}, {shift}) & {(1 << bits) - 1}L) + 0.5D) * {2.0**-bits!r}D)"


def draw(k: int) -> Column:
    """ln a as an ordered 31-bit number above the 32-bit code of (term, t); h and lw are the term's hash and ln w."""
    one, two = f"xxhash64(h, {2 * k})", f"xxhash64(h, {2 * k + 1})"
    r = f"(-ln({_uniform(one, 0, 21)} * {_uniform(one, 21, 21)}))"
    b = _uniform(one, 42, 22)
    c = f"(-ln({_uniform(two, 0, 32)} * {_uniform(two, 32, 32)}))"
    t = f"floor(lw / {r} + {b})"
    order = f"cast((ln({c}) - {r} * ({t} - {b} + 1) + 128D) * 8388608D as bigint)"
    return F.expr(f"shiftleft({order}, 32) | (cast(hash(h, {t}, {k}) as bigint) & 4294967295L)")


def sampled(rows: DataFrame, by: list[str], terms_col: str = "terms", samples: int = SAMPLES) -> DataFrame:
    """One row a group of ``by`` with columns c0, c1, ...: the codes of its samples, null without terms."""
    each = rows.select(*by, F.explode_outer(terms_col).alias("term")).select(*by, F.col("term.h").alias("h"), F.ln(F.col("term.w").cast("double")).alias("lw"))
    return each.groupBy(*by).agg(*((F.min(draw(k)).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"c{k}") for k in range(samples)))


def _hex(prefix: str, samples: int) -> Column:
    return F.concat_ws("", *(F.lower(F.lpad(F.hex(f"{prefix}{k}"), 8, "0")) for k in range(samples)))


def _likeness(a: str, b: str, samples: int) -> Column:
    """Share of equal samples; two texts without terms are alike, one without is unlike any other."""
    same = sum((F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")).cast("int") for k in range(samples)), F.lit(0))
    return (same / float(samples)).cast("double")


def neighbours(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with h (a hash of the text), bucket and ghost, dealt out by bucket.

    Rows are in descending order of (id, h).  The narrow pairs of the two are dealt by ranges and sorted, so that a pair's
    partition and its place there give its place overall; a bucket is BUCKET_ROWS of them, whatever the ids.  Each bucket
    also gets, as a ghost, the row that follows its last one (the first after the last), so that a window over a bucket sees
    every next row.  Rows that repeat id and text share a bucket; those without an id are dealt by their texts.
    """
    rows = docs.withColumn("h", F.xxhash64("text"))
    pairs = rows.select("id", "h")
    order = [F.desc("id"), F.desc("h")]
    ordered = stash(pairs.where("id is not null").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()))
    part, pos = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    bucket = F.shiftleft(part, 33).bitwiseOR(F.floor(pos / BUCKET_ROWS))
    names = stash(ordered.groupBy("id", "h").agg(F.min(bucket).alias("bucket")))
    loose = F.lit(-1) - F.pmod("h", F.lit(1 + pairs.where("id is null").count() // BUCKET_ROWS))

    tops = names.groupBy(F.shiftright("bucket", 33).alias("part"), "bucket").agg(F.max(F.struct("id", "h")).alias("top"))
    firsts = tops.groupBy("part").agg(F.min_by("top", "bucket").alias("first"))  # one row a partition
    after = F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min_by("first", "part").over(Window.partitionBy()))
    ghosts = tops.withColumn("next", F.lead("top").over(Window.partitionBy("part").orderBy("bucket"))).join(stash(firsts.select("part", after.alias("after"))), "part")
    ghosts = stash(ghosts.select(F.col("bucket").alias("target"), F.coalesce("next", "after").alias("x")).select("target", "x.*"))

    own = rows.join(lookup(names), ["id", "h"], "left").withColumn("bucket", F.coalesce("bucket", loose)).withColumn("ghost", F.lit(0))
    extra = rows.join(lookup(ghosts), ["id", "h"]).dropDuplicates(["target"]).withColumn("ghost", F.lit(1))
    out = ("id", "text", "h", "bucket", "ghost")
    return own.select(*out).unionByName(extra.withColumnRenamed("target", "bucket").select(*out)).repartition("bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    row's text in descending order of ids (after the last: the first; of equal ids: by a
    hash of the text).  A null text
    counts as empty; texts without words have the fingerprint ``""`` and are alike only to each other.  A
    row whose id is null has no next row: nothing replaces its text's end and near_next is 0.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("id"), F.desc("h"), "text")
    rows = neighbours(texts).withColumn("seq", F.row_number().over(order)).withColumn("next", F.coalesce(F.when(F.col("id").isNotNull(), F.lead("text").over(order)), F.lit("")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    both = F.when(F.col("ghost") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"))))
    each = rows.select("bucket", "seq", "ghost", "id", "n_chars", "edited_sha", F.explode(both).alias("x")).select("bucket", "seq", "ghost", "id", "n_chars", "edited_sha", F.col("x.kind").alias("kind"), F.expr(terms("x.t")).alias("terms"))
    codes = sampled(each, ["bucket", "seq", "ghost", "id", "n_chars", "edited_sha", "kind"], samples=samples)
    pairs = codes.groupBy("bucket", "seq", "ghost", "id", "n_chars", "edited_sha").agg(*(F.max(F.when(F.col("kind") == kind, F.col(f"c{k}"))).alias(f"{p}{k}") for kind, p in ((0, "o"), (1, "e")) for k in range(samples)))
    after = Window.partitionBy("bucket").orderBy("seq")
    named = pairs.withColumn("after", F.lead(F.struct(*(f"o{k}" for k in range(samples)))).over(after))
    named = named.where("ghost = 0").select("*", *(F.col(f"after.o{k}").alias(f"n{k}") for k in range(samples)))
    near_next = F.when(F.col("id").isNull() | F.col("after").isNull(), F.lit(0.0)).otherwise(_likeness("o", "n", samples))
    return named.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        _hex("o", samples).alias("fingerprint"), _hex("e", samples).alias("edited_fingerprint"),
        _likeness("o", "e", samples).alias("near_edited"), near_next.alias("near_next"),
    )
