"""A corpus pipeline of five operators: toxicity, near-duplicates, decontamination, PII, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark.llm import decontaminate, near_duplicates, pii, sentencepiece_bpe, toxicity
from stallmark.llm.queries import TEST_KEY, model_path
from stallmark.llm.sampling import remainder
from stallmark.llm.spark import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones of these (but a fifth).

    Null texts are empty, repeated rows are judged alike; without any label every document stays.
    """
    learnt = remainder(F.col("doc_id"), 5) != 0
    return toxicity.keep_harmless(docs, toxicity.fit(docs.where(learnt), table(spark, sf_dir, "labels").where(learnt)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one with the smallest id; of repeated rows one. Texts without words and null ids stay."""
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go; null texts stay, and all do without items."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated rows too, with pseudonyms in their texts; null texts stay null."""
    return pii.pseudonymise(docs, key=TEST_KEY).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with an end id, and a hash of what they decode to; null texts are empty. An empty table gives no row, here as in all stages."""
    encoded = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), sentencepiece_bpe.load_model(model_path()), eos=True, decoded="decoded")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("jaccard join", drop_near_copies), ("decontamination", drop_contaminated), ("pii", hide_personal_data), ("sentencepiece", tokenize)]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared checkpoint folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
