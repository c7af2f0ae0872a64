"""A corpus through five of the training-data operators, each stage written and reread as Parquet.

Language ID, SimHash near-dedup, substring dedup, mixing to target weights, byte-level BPE. Every stage works on
all that the one before kept, and all but the last give the columns of documents. Rows without doc_id
are rejected with the texts that have no language or none of the learned ones. Of rows equal in doc_id and text one
stays; texts that share a doc_id all stay, if theirs is the document kept of its group. Long texts are single rows in a
worker's memory, as in the operators. Empty tables stay empty, and further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import bpe, langid, mixing, simhash, substring
from strandframe.llm._common import shared_dir
from strandframe.llm.queries import BYTE_BPE, PATTERN, PIECES, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose likeliest language has less than this posterior is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages, as far as their letters tell."""
    model = langid.train(docs, PIECES, F.col("doc_id").isNotNull())
    seen = langid.predict(docs, model, carry=("text", "lang", "source", "n_chars"))
    return seen.where((F.col("lang_pred") != "und") & ~F.col("foreign") & (F.col("score") >= LEAST_SCORE) & F.col("doc_id").isNotNull()).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies; of rows with its doc_id one for each text."""
    kept = simhash.near_duplicates(docs, distance=4, shingle=4).where("doc_id = component_id").select("doc_id").distinct()
    rest = docs.join(kept, "doc_id", "left_semi")
    return rest.groupBy("doc_id", F.md5("text").alias("digest")).agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one; those left empty go, untouched texts stay as they are."""
    done = substring.dedup_substrings(docs, 50, carry=("lang", "source", "n_chars"), as_is=True)
    done = done.where(F.col("n_words") > F.col("n_removed")).withColumn("text", F.col("kept").cast("string"))
    return done.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, rounded up or down by a hash of its id."""
    docs = docs.withColumn("digest", F.sha2("text", 256))
    # rows of one id and text have one rate, so each meets one; texts that share an id each have their own
    rates = mixing.mix(docs, table(spark, sf_dir, "labels"), carry=("digest",)).where("copies > 0").select("doc_id", "digest", "copies").dropDuplicates(["doc_id", "digest"])
    return docs.join(rates, ["doc_id", "digest"]).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mixture."""
    return bpe.bpe_digests(docs, BYTE_BPE, PATTERN)


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("substring dedup", repeated_passages), ("mixing", mixture), ("byte-level BPE", tokens)]

#: No SQL has the language model, the fingerprints or the merges; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = shared_dir(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
