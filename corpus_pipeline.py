"""From raw documents to packed training sequences: one function per stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the
last returns the packed pieces. ``run`` writes every stage's result to the shared folder and reads
it again for the next, as the stages are meant to be used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import mixing, ngram_join, packing, pii, quality
from fieldspark.llm.storage import read_table, stored
from fieldspark.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    names = docs.columns
    whole = docs.select("doc_id", "text", "lang", F.struct(*names).alias("_row"))
    # a decision belongs to a text in its language, so that repeated ids and rows are no trouble
    judged = quality.judge(whole, labels, F.col("lang"), ["doc_id", "_row"])
    return judged.where("kept").select(*[F.col("_row")[c].alias(c) for c in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: repeated, whole, or the words of chosen blocks."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

# Packing is an evolved solution, which SQL cannot express; tests hold each stage against a brute
# version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table of documents to the packed pieces."""
    docs = read_table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
