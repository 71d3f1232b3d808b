"""Documents to training sequences: five stages, each one operator over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``;
``n_chars`` follows the text. Null texts, ids and other columns pass through as the operators
say; an empty table stays empty.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconry.llm.language import held_out
from beaconry.llm.lines import drop_frequent_lines
from beaconry.llm.minhash import keep_one_of_each
from beaconry.llm.packing import pack_power_of_two
from beaconry.llm.suffixes import drop_repeated_text
from beaconry.llm.toxicity import fit_toxicity, score_toxicity
from beaconry.plans.lineage import scratch_path

TOXIC_SCORE = 0.7
# A passage repeats from so many words on, or so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 400


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``out``, whose texts may have changed."""
    chars = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents scored ``TOXIC_SCORE`` or more. Learns from two thirds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 3, 1))
    model = fit_toxicity(docs.select("doc_id", "text"), labels)
    scored = score_toxicity(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), model, out="score")
    return scored.where(F.col("score") < TOXIC_SCORE).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that ten or more documents hold. A document that loses all lines stays, empty."""
    return _as_documents(drop_frequent_lines(docs), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each class of near duplicates."""
    return keep_one_of_each(docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the strings of 400 bytes, or of more than 50 whole words, that occur twice.

    Each repeated string is judged by itself: shorter ones that overlap or touch do not add up.
    The limit in words is the pipeline's; that in bytes is the contract of op9.
    """
    return _as_documents(drop_repeated_text(docs, length=PASSAGE_BYTES, passage_words=PASSAGE_WORDS), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece, with its ids."""
    import public_tokenizers

    return pack_power_of_two(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("suffix_dedup", dedup_passages), ("packing", pack),
]

# Scores, signatures, suffix arrays and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
