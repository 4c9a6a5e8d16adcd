"""The queries op1_ to op10_ and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import ann, ctw, imatch, mixing, pii, quality, sentencepieces, simhash, tokenfiles, warc
from treeline.llm._common import table


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, and their likeness."""
    return imatch.neighbours(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document by the 32k model, and whether decoding them gives the text back."""
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and context-tree scores of every whole document."""
    return ctw.score(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    return warc.write_and_read(table(spark, sf_dir, "pages"), least=0)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mixture by the square roots of the sources' sizes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", F.length("text").cast("long").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's tokens, from files that were written in doc_id order and read back."""
    tokenizer = Path(tokenizer_path("byte_bpe_50k.json")).read_bytes()
    return tokenfiles.write_and_read(table(spark, sf_dir, "documents"), tokenizer, end_id=2)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, their digest and all spans of personal data of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


QUERIES = {f.__name__: f for f in (op1_imatch, op2_sentencepiece, op3_ctw, op4_warc, op5_ann, op6_mixing, op7_quality, op8_simhash, op9_tokenfiles, op10_pii)}
ORACLE_SQL: dict[str, str] = {"op4_warc": warc.SQL, "op6_mixing": mixing.mix_sql()}
