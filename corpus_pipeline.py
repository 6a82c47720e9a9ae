"""From documents to packed training sequences: five stages, each applying one operator to all that the one before kept.

Every stage but the last takes and returns the columns of documents (doc_id, text, lang, source,
n_chars); other columns are dropped. Rows are never capped, sampled or cut by a stage that isn't
meant to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import mixing, packing, secrets, similar, toxicity
from strandloom.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither learned scores nor XXH64, hypergeometric draws or a tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; null and empty texts score as clean."""
    scored = toxicity.toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), least=0.7, keep=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies.

    Documents link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more, which
    is measured exactly; candidates come from SimHash fingerprints under covering masks, operator 1's method
    (tables and recall: README). Texts without words are one group; rows that repeat an id, or have none, are
    rows of their own in this.
    """
    rows = docs.select(*COLUMNS)
    return similar.representatives(rows, similar.near_duplicates(rows, width=5, least=0.8), width=5).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redacted(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, dealt to their shards and in shuffled order within each."""
    return mixing.mixed_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
