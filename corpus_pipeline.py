"""Documents through quality, toxicity, near-duplicate, decontamination and packing stages.

Each stage works on what the one before has kept. All but the last return the columns of
``documents``; the last returns the pieces of packed sequences. SQL cannot express the stages
that learn, so the tests hold ``run`` against a brute-force version. Empty tables give no rows and
columns may have any names in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencia.llm import decontaminate, minhash, packing, quality, queries, toxicity
from evidencia.llm.common import shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored as empty ones; rows without an id are judged by their text as all others."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no evidence and stay."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts and rows without an id stay; of rows that repeat an id one does."""
    return minhash.keep_one_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts match nothing and stay; rows without an id go by their text."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts give one piece with the end id alone; each row is packed, whatever its id."""
    pieces = packing.pack(docs, queries.tokenizer_path(), queries.MAX_TOKENS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("quality", good_quality), ("toxicity", civil), ("near-duplicates", one_of_each), ("decontamination", uncontaminated), ("packing", packed)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is a table in the shared folder, which goes when the next is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
