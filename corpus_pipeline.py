"""From raw documents to packed sequences: quality, lines, near copies, secrets, packing.

Each stage reads what the one before wrote, works on all of it, and passes on all columns of what it
keeps, whatever their names; the last returns the pieces of the packed sequences with their token ids.

Defined cases, through all stages: null, empty and blank texts stay (no rule accuses them, they have no lines,
copies or secrets) and are packed as an end mark alone; texts of any length are worked on whole; rows
with equal doc_id and text become one (line dedup), of equal texts under several doc_ids the smallest doc_id
keeps its lines and the others go; of ties the first in the table stays; null doc_ids come after
all others; an empty table gives an empty result. tests/llm/test_pipeline.py covers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landweave.llm import lines, minhash, packing, quality, secrets
from landweave.llm.common import stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and documents of which nothing is left."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the first document stays."""
    return minhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets go from the texts; every document stays."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the bins."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Neither signatures nor compressed bytes nor online packing can be said in SQL;
#: tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two the rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = stash(docs, f"stage{i}")
    return docs
