"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Each stage works on all rows that its predecessor kept and returns the columns
of documents; the last adds token ids. Empty tables, null texts and repeated
rows go through as the operators define it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import bpe, decontam, pii, quality, simhash
from attestry.llm.shared import ensure_checkpoint_dir


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents with a score under its threshold go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup on shingles of five words at a similarity of 0.8: one document of each group stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of an item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span is replaced by its kind; n_chars counts the new text."""
    return pii.mask(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the token ids of their texts, and digests of the ids and of the text decoded from them."""
    return bpe.encoded(docs)


STAGES = [
    ("quality", reject_bad),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode_tokens),
]
#: SQL expresses none of the learnt and searched stages; test_pipeline_equals_a_plain_version compares run()'s whole rows with plain Python (of the learnt classifier, with the true classes of a separable corpus).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages; what lies between them is written under the shared checkpoint folder. A stage's table goes once the next one is written; the last one stays for as long as the result is read, and the folder's owner removes it."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return STAGES[-1][1](spark, docs, sf_dir)
