"""A corpus pipeline of five stages, each one of the operators, from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and rereads it for
the next one. All but the last return the columns of ``documents``. Documents without an id stay in the
near-duplicate stage, as no group can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearpath.llm import mixing, near_dup, packing, quality_rules, site_quality
from wearpath.llm.columns import text_of, word_count
from wearpath.session import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with their measures, and a written copy of the measures alone.

    Measures are computed twice: a written copy of the texts beside them would stay until the pipeline has ended.
    """
    fit = materialise(quality_rules.measures(docs, keep=("doc_id", "source", "lang")), "measures")
    # The number keeps the verdict's filter above the measures; pushed into them it would repeat them many times.
    return quality_rules.measures(docs, keep=COLUMNS).withColumn("__row", F.monotonically_increasing_id()), fit


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the quality classifier rejects."""
    measured, fit = _measured(docs)
    return site_quality.judge(measured, table(spark, sf_dir, "labels"), fit=fit).filter("kept AND __row >= 0").select(*COLUMNS)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what fails the base rule or a certified cutoff."""
    measured, fit = _measured(docs)
    return quality_rules.judge(measured, table(spark, sf_dir, "labels"), fit=fit).filter("kept AND __row >= 0").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Rows that repeat an id and its text go too; a kept id's different texts all stay.
    """
    kept = near_dup.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, always whole.

    The last document of a source, of which the mix takes a part, comes once more if that part is half of it or more, so
    that a source misses its target by half a document at most and no document comes more than twice.
    """
    text = text_of("text")
    sized = docs.select(*COLUMNS, word_count(text).alias("__size"), mixing.text_quality(text).alias("__quality"))
    mixed = mixing.mix(sized, "source", "doc_id", F.col("__size"), F.col("__quality")).filter("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return mixed.withColumn("__copies", copies).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_dedup", deduplicate),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]

#: The fitted decisions and the tokenizer are not for SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
