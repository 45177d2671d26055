"""The corpus pipeline: five stages over `documents`, each an operator of nxtide.llm over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nxtide.llm import decontaminate, line_dedup, sentencepieces, simhash, toxicity
from nxtide.llm.common import save, table, text_of, without
from nxtide.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely toxic than clean.

    Rows are judged one by one by their whole texts, so repeated ones alike; null and empty texts have nothing
    toxic and stay, as do rows with a null id. An empty table stays empty.
    """
    judged = docs.withColumnsRenamed({c: f"own {c}" for c in without(docs, "doc_id", "text")})
    graded = toxicity.score(judged, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return graded.filter(~F.col("toxic")).select(*(F.col(c if c in judged.columns else f"own {c}").alias(c) for c in docs.columns))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that at least three documents share out of all but the one with the largest id; documents stay, with their new text and length.

    Rows with the same id are one document; those with a null id keep all lines. A null or empty text
    becomes an empty one. An empty table stays empty. A column n_chars is brought in line, others stay.
    """
    bare = docs.withColumnsRenamed({c: f"own {c}" for c in without(docs, "doc_id", "text")})
    kept = line_dedup.LineIndex.empty(spark).insert(docs).clean(bare).withColumn("text", F.col("kept_text"))
    out = [F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c if c in bare.columns else f"own {c}").alias(c) for c in docs.columns]
    return kept.select(*out)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest doc_id (ties: by its text).

    Documents are told apart by id and text, so that of rows with one id and several texts each is judged for itself, and
    repeated rows become one. Texts without words, null ones too, are alike. Rows with a null id stay. An empty table stays empty.
    """
    return simhash.keep_one(docs, simhash.near_duplicates(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark.

    Documents are told apart by id and text: rows that share an id, or have none, are judged each for itself, repeated ones
    alike. Null and empty texts hold nothing. An empty table stays empty, and an empty benchmark drops nothing.
    """
    text_id = F.xxhash64(text_of(F.col("text")))
    found = decontaminate.leaks(docs.select(F.struct("doc_id", text_id.alias("text_id")).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = found.select(F.col("doc_id.doc_id").alias("found_id"), F.col("doc_id.text_id").alias("found_text")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]) & (F.xxhash64(text_of(docs["text"])) == found["found_text"]), "left_anti")


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document that is left, and whether they decode to its text; null and empty texts have none. An empty table stays empty."""
    return sentencepieces.encode(docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", as_pieces),
]

#: Fingerprints, a fitted model and token ids can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs)
    return docs
