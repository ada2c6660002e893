"""The corpus pipeline: documents through toxicity, near duplicates, benchmark
decontamination, personal data and BPE, each stage reading what the one before wrote.

All stages but the last return the columns of documents; the last adds token ids and the decoded
text. Empty tables pass through every stage; rows with a null or empty text pass the filters
(unless the toxicity curve rejects an empty text, which it can't below its cut) and get no ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm import bpe, decontaminate, jaccard, pii, toxicity
from codequarry.llm.common import materialize, table
from codequarry.llm.queries import tokenizer_path

#: SQL can't express the stages' models; tests/llm compares them with plain versions.
ORACLE_SQL = None

#: The near-duplicate stage's own shingles and similarity; op6 has those of its contract.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut stay. The lexicon is learned from the labelled rows of the
    corpus itself, as the contract's training split has it."""
    from pyspark.sql import functions as F

    from codequarry.llm.common import crc_mod

    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return toxicity.keep_clean(docs, lexicon)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked ones stays. Texts link from NEAR_PERCENT of the
    shingles of NEAR_WORDS words on."""
    return jaccard.keep_one(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark windows are cut out of the texts."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every remaining row."""
    return bpe.digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("pii", personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
