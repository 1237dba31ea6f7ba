"""The training-data pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents:

1. quality rules: rows that no rule rejects
2. exact dedup: of equal texts the row with the largest doc_id
3. SimHash near-dedup: of linked texts the row with the smallest doc_id
4. mixing: each row as often as its source's share asks for (0 to 3 times)
5. BPE: doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholium.llm import bpe, exact_dedup, mixing, quality, simhash
from scholium.llm.common import load, place, run_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule rejects. Null and empty texts go; no documents give no rows."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of repeated rows one."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the row with the smallest doc_id; null doc_ids last."""
    return simhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; repeated rows alike."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of ids for each row; a null text has none."""
    return bpe.encode_documents(docs, with_ids=True, remembered=bpe.REMEMBERED_BESIDE)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("mixing sources", source_mix),
    ("bpe", token_ids),
]

#: Fingerprints and BPE have no SQL; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    Null and empty texts have too few words and go in the first stage. Null and
    repeated doc_ids, repeated rows and further columns of any name are carried
    along until the last stage. No documents give no rows. Only the last stage's
    table stays in the shared folder; the others are dropped when it is written.
    """
    docs, result = load(spark, sf_dir, "documents"), place(spark, "pipeline")
    with run_folder(spark) as folder:
        for i, (_, stage) in enumerate(STAGES):
            path = result if i == len(STAGES) - 1 else f"{folder}/{i}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
