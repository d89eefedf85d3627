"""The corpus pipeline: quality rules, near copies, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) with docs in the columns of ``documents`` and works on all that its predecessor
kept. All but the last return those columns again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechtab.llm import op1_pii, op3_quality, op8_decontaminate, op9_pieces, op10_similar
from speechtab.llm.common import materialize, table
from speechtab.llm.queries import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return op3_quality.keep(docs, op3_quality.fit(docs.select("doc_id", "text"), labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies (five-word shingles, similarity 0.8 or more)."""
    return op10_similar.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return op8_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and removes or generalises the terms that disclose it."""
    return op1_pii.sanitise(docs, reach=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with digests of the text that they decode to."""
    return op9_pieces.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SQL cannot express the trained rules, the piece encoder and the greedy choice of near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs.drop("ids")
