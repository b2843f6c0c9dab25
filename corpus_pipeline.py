"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

Stages take the columns of documents and ignore any others, whatever their names; all but
the last return exactly those columns. An empty table gives an empty result. Rows may
repeat and may share a doc_id or have none: each is judged by its own text, and what a
stage does with a null or empty text is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import mixing, packing, quality, secrets, simhash
from helixframe.llm.storage import Written, clear, live

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go; texts that are null or have under 20 words are among them."""
    return quality.kept_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles at a likeness of 0.8, the document of smallest doc_id stays.

    Of repeated rows one stays; rows without an id give way to any with one. Texts without
    words are copies of each other.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, n_chars follows its text. A null text stays null."""
    return secrets.redacted(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities that bring the mix to its targets.

    Texts without tokens weigh nothing and are sampled at their cell's probability; rows of
    one doc_id go or stay together, rows without one go by their texts.
    """
    return mixing.sample(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces: what sequence each is in, and where. A null or empty text is one piece, its closing id."""
    return packing.packed(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("secret_scans", secret_scans),
    ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing),
]

#: SimHash fingerprints and the packing's tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stage's rows written and read again before the next; what a stage leaves behind goes then."""
    docs, others = spark.read.parquet(f"{sf_dir}/documents.parquet"), live()
    for name, stage in STAGES[:-1]:
        done = Written(stage(spark, docs, sf_dir), name)
        clear(spark, but=others | {done.path})
        docs = done.df
    return STAGES[-1][1](spark, docs, sf_dir)
