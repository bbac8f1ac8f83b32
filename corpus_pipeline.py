"""A training-data pipeline over the table documents: its stages, each written as Parquet and read again.

Stages get what their predecessor kept. Rows keep the columns of documents up to the last stage, which gives the
tokens. A document is a row: mixing may repeat one, with its doc_id. No SQL expresses the model stages, so ORACLE_SQL is
None and tests compare the stages with plain versions of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.llm import mixing, ngram_join, pii, sentencepiece_lattice, toxicity
from stockweave.llm.common import discard, staged

ORACLE_SQL = None
#: Words of a shingle, and hundredths of similarity from which documents are near copies.
NEAR_SHINGLE, NEAR_PART = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: that with the least doc_id. Linked are documents whose sets of
    five-word shingles have a similarity of 0.8 or more; op3 itself takes four words and 0.85."""
    return ngram_join.keep_one(docs, shingle=NEAR_SHINGLE, part=NEAR_PART)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become the names of their kinds; n_chars follows."""
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids and ids."""
    ids = sentencepiece_lattice.encode_column(docs.select("doc_id", "lang", "source", "text"), sentencepiece_lattice.default_model())
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, out = docs, stage(spark, docs, sf_dir)
        docs = staged(out, f"pipeline-{name}")
        discard(*getattr(out, "staged_inputs", ()))
        if name != STAGES[0][0]:  # a stage's output goes when the next one has been written
            discard(before)
    return docs
