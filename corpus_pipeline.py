"""The training-corpus pipeline: what it rejects, merges, sanitises, mixes and encodes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which :func:`run` writes to the
cluster's shared folder and reads again for the next one. Each begins with small executors: the heap that the one before has grown is handed back. All but the last return the columns of documents; extra columns are left out.

Defined results, in every stage: repeated rows are each treated alike and all stay or all go; an empty table gives an empty result. Rows without an id
are kept by every stage, and near copies of nothing; rows without a text score as the share of toxic labels, are near copies of nothing, stay null, take
no words of the mix (so the mix leaves them out) and have no tokens. Without labels of both kinds nothing is toxic as long as less than half of the labels are.
Texts of any length are worked on whole. Ties between near copies go to the lowest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgraph.llm import bpe, jaccard, mixing, pii, toxicity
from veilgraph.llm.queries import tokenizer_path
from veilgraph.llm.scratch import drop, give_back, stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    give_back(spark)
    return toxicity.keep_harmless(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def merge_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their 5-word shingles, the lowest id stays."""
    give_back(spark)
    return jaccard.keep_one(docs.select(*COLUMNS), width=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what gives it away is replaced; n_chars follows the new text."""
    from pyspark.sql import functions as F

    give_back(spark)
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    give_back(spark)
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of every document of the mix."""
    from pyspark.sql import functions as F

    give_back(spark)
    out = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path())
    return out.select("doc_id", "source", F.size("vg_ids").cast("long").alias("n_tokens"), F.col("vg_ids").alias("ids"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_copies", merge_near_copies),
    ("pii", sanitise),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: The first stage's score is no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stash(out, f"pipeline-{name}") if i + 1 < len(STAGES) else out
        if last is not None and i + 1 < len(STAGES):
            drop(last)
        last = docs
    return docs
