"""The queries ``opN_<name>`` with production parameters: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, language, lattice, near_duplicates, phrases, pii, quotations, sentencepiece_bpe, sql, toxicity, unigram, url_reputation, whitening
from .sampling import remainder
from .spark import sha256_of, table


def model_path() -> str:
    """Place of the public SentencePiece model; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha256_of(F.col("items")).alias("items_sha256"), "contaminated")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_bpe.load_model(model_path())
    both = sentencepiece_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, eos=True, decoded="decoded")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = unigram.vocabulary(sentencepiece_bpe.load_model(model_path()))
    return unigram.token_counts(table(spark, sf_dir, "documents"), pieces)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.embedding_links(table(spark, sf_dir, "embeddings"))


#: Of the test tables, which hold nobody's data; a deployment has a key of its own.
TEST_KEY = "key of the test tables"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key=TEST_KEY, found="found").select("doc_id", "text", F.size("found").cast("long").alias("n_values"), F.array_join(F.transform("found", lambda x: x["kind"]), ",").alias("kinds"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


#: (action, host, path)
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a page is the quality of the document whose id its path ends with."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?$", 1).try_cast("long")
    labelled = pages.select(url_reputation.host_of(F.col("url")).alias("host"), number.alias("doc_id")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good")), "doc_id")
    return url_reputation.judge(pages, URL_RULES, labelled).select("page_id", "host", "path", "rule", "verdict")


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.replies(table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.neighbours(table(spark, sf_dir, "documents"))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return out.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_edited", "held_next")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_sentencepiece, op3_token_counts, op4_embedding_dedup, op5_pii, op6_jaccard_join, op7_url_filters,
        op8_quotations, op9_language_id, op10_toxicity, op11_whitening, op12_fingerprints, op13_collocations,
    )
}
ORACLE_SQL = sql.SQL
