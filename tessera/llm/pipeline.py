"""A corpus pipeline over ``documents``: five stages, each of which works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and reads it back as the next one's docs.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, mixing, ngram_jaccard, secrets, toxicity
from tessera.llm.common import bounded_batches, scratch_mark, stash, sweep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; a null or empty text has no hit and stays."""
    score = "toxicity"
    while score in map(str.lower, docs.columns):
        score += "_"
    lexicon = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.scored(docs, lexicon, name=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component at Jaccard similarity 0.8 of 5-word shingles."""
    bounded_batches(spark)
    return ngram_jaccard.keep_one(docs, n=5, num=4, den=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced."""
    bounded_batches(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix of the sources takes them."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes decoded from them, a row a document."""
    bounded_batches(spark)
    return byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]

#: SQL can express neither the learned lexicon nor the byte-pair merges; the tests hold stages against plain versions and the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; scratch tables of the stages before it are deleted as it goes."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
        sweep(spark, mark, keep=docs)
    return docs
