"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nxtide.llm.common import join_spread, save, text_of

#: Documents, about, from which frequent pre-tokens are taken, and how many of those each task holds at most. Both are for speed: counts don't depend on them.
SAMPLE, HOT = 8192, 1 << 17
LIMIT = 2048


@lru_cache(maxsize=4)
def loaded(path: str) -> Tokenizer:
    """The tokenizer for single pre-tokens, in which special strings are text."""
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


class Pretokens:
    """Splits texts as a tokenizer file of words with ends says: special strings, NFC, lower case, then one pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or (first["type"], second["type"]) != ("Split", "ByteLevel") or first["behavior"] != "Removed" or not first["invert"] or spec["post_processor"] or spec["truncation"] or spec["padding"]:
            raise ValueError(f"{path} splits texts in another way than this operator")
        if any(t["normalized"] and t["content"] != t["content"].lower() or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special strings that are found in another way")
        strings = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.begins = sorted({s[:2] for s in strings})
        self.special = regex.compile("|".join(map(regex.escape, strings)) or "(?!)")
        self.pattern = regex.compile(first["pattern"]["Regex"])

    def counts(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token occurs, and how many special strings there are."""
        parts = self.special.split(text) if any(b in text for b in self.begins) else [text]
        found: Counter = Counter()
        for part in parts:
            # one code point at a time, as the library does: a capital sigma has one lower-case form
            lower = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            found.update(self.pattern.findall(lower))
        return found, len(parts) - 1


@lru_cache(maxsize=4)
def splitter(path: str) -> Pretokens:
    return Pretokens(path)


def pieces_of(words: list[str], path: str) -> list[int]:
    return [len(e.ids) for e in loaded(path).encode_batch_fast(words, add_special_tokens=False)]


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """words (word, further columns), of which each is one row, with `pieces`."""

    @F.pandas_udf("long")
    def pieces(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in frames:
            yield pd.Series(pieces_of(column.tolist(), path), dtype="int64")

    return words.withColumn("pieces", pieces("word"))


def frequent_words(docs: DataFrame, path: str, sample: int, most: int) -> list[str]:
    """The words that most documents of a sample of bounded size have."""

    @F.pandas_udf("array<string>")
    def words(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in frames:
            yield pd.Series([list(splitter(path).counts(t)[0]) for t in column])

    share = min(1.0, sample / max(1, docs.count()))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))).select(text_of(F.col("text")).alias("text"))
    counted = drawn.select(F.explode(words("text")).alias("word")).groupBy("word").count().filter("count > 1")
    return [r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(most).collect()]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, sample: int = SAMPLE, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text).

    Each distinct pre-token is encoded once. Counts of at most `hot` frequent ones go to
    every task, which sums them as it splits a text; others are rows (row, word, frequency),
    joined to the table of their counts by a shuffle, in which a word that very many rows have is dealt
    among copies of its count. No ids of a text are ever made. A null or empty text has no tokens. Each row is
    counted by itself, whole, whatever its doc_id, so repeated rows and null ids need nothing special. An
    empty table gives no rows; further columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    words = frequent_words(docs, path, sample, hot)
    known = spark.sparkContext.broadcast(dict(zip(words, pieces_of(words, path))))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, row = known.value, TaskContext.get().partitionId() << 40
        cut = splitter(path)
        for f in frames:
            sums, rare = [], []
            for text in f["text"]:
                counts, total = cut.counts(text)
                tail = []
                for word, n in counts.items():
                    pieces = have.get(word)
                    if pieces is None:
                        tail.append({"word": word, "n": n})
                    else:
                        total += n * pieces
                sums.append(total)
                rare.append(tail)
            yield pd.DataFrame({"row": range(row, row + len(f)), "doc_id": f["doc_id"].astype("Int64"), "n_bytes": f["n_bytes"], "known": sums, "rare": rare})
            row += len(f)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    rows = save(texts.mapInPandas(split, "row long, doc_id long, n_bytes long, known long, rare array<struct<word: string, n: long>>"))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    words = rare.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    pieces = save(piece_counts(words, path))
    sums = join_spread(rare, pieces, ["word"], "rows", ["row"]).groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return rows.join(sums, "row", "left").select("doc_id", "n_bytes", total.cast("long").alias("n_tokens"), (total > limit).alias("over_limit"))
