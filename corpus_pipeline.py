"""A corpus pipeline: quality rules, language ID, MinHash near-dedup, suffix-array dedup, best-fit packing.

Each stage takes the documents its predecessor kept. Ids identify documents; rows that repeat an id are kept or dropped
together where a stage decides by id, and null ids are one id there.

Defined results: null, empty and blank texts fail the length rule of the first stage, and texts without a letter the
second; a stage that is given them nevertheless keeps them through the third and fourth (empty sets link with nothing,
a null text becomes empty) and packs them as their end token alone. A very long text is one unit of work in every stage:
stages three and four hold some eighty bytes for each of its bytes in one task. An empty table stays empty, with its
columns; other columns of any names travel along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.llm import language, minhash, packing, quality, suffixes
from siftlight.llm.common import written

#: A document stays if its language was recognised with at least this pooled probability.
MIN_LANGUAGE_SCORE = 0.4
#: Stages on word shingles: sets of 5 words with a Jaccard similarity of at least 0.8 are near-duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Bytes of a repeated passage: passages of more than 50 words reach them if their words have 3.4 letters on average.
#: (Operator 10 alone takes 400.)
PASSAGE_BYTES = 224


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy rejects go."""
    return quality.keep_rows(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go. The network learns from the labelled documents that are not held out."""
    network = language.train(docs.filter(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    judged = language.identify(docs, network, carry=True)
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    kept = minhash.near_duplicates(docs, size=NEAR_WORDS, percent=NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go from the texts; every document stays."""
    return suffixes.without_repeats(docs, length=PASSAGE_BYTES).withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as token pieces placed into sequences."""
    return packing.pack(packing.pieces(docs, packing.word_bpe()))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Network inference and tokenising are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
