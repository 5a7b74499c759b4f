"""The registered queries, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, conversations, fingerprints, lexical_search, mixing, mpeg_audio, ngram_jaccard, packing, quality, secrets, token_files, toxicity, warc
from tessera.llm.common import shared_folder, table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=9, den=10).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_files.write_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_files.read_files(spark, path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.features(mpeg_audio.stored(table(spark, sf_dir, "documents")))


def _remainder(modulus: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    score = F.col("toxicity")
    return toxicity.scored(docs, lexicon).select("doc_id", (_remainder(3) == 1).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    score = F.col("quality")
    return quality.scored(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), score.alias("score"), (score >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = lexical_search.index(table(spark, sf_dir, "documents"))
    return lexical_search.search(idx, table(spark, sf_dir, "benchmark"), k=10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summary(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_secrets, op3_byte_bpe, op4_token_files, op5_mixing, op6_warc, op7_fingerprints, op8_mpeg_audio, op9_toxicity, op10_quality,
        op11_lexical_search, op12_conversation_repair, op13_best_fit_packing,
    )
}
#: The other queries rest on hashes, learned models, byte-pair merges or coders that SQL can't express, or are too slow in
#: it on whole tables; tests hold them against brute force, the libraries and round trips.
ORACLE_SQL = {
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN strlen(body) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(body) >= 1000 AND page_id <> top THEN top END AS refers_to FROM m""",
    "op11_lexical_search": r"""WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, big_n),
ms AS (SELECT doc_id, 10 + (90 * n * big_n) // big_l AS m FROM lengths, totals),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM wanted JOIN tfs USING (term) JOIN weights USING (term) JOIN ms USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}
