"""Language identification by prediction by partial matching: a tree of byte contexts for each language, frozen after counting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nxtide.llm.common import free_names, slices, text_of, without

#: Bytes of the longest context.
ORDER = 4
#: Bytes of text, about, that a language's tree is counted from, and the bound of that times the square of the number of
#: languages: a model has at most so many rows times languages for each order.
LANGUAGE_BYTES, CELLS = 2_000_000, 32_000_000
#: Every text is coded as if this byte came before it, as often as a context is long.
START = 10
#: Bytes of text that a task reads at once, but for a text that is longer alone, and bytes times languages that it codes at once.
BATCH_BYTES, CODED = 4_000_000, 4_000_000
UNKNOWN = "und"


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each after ORDER times START, and where each one's own bytes begin."""
    lead = bytes([START]) * ORDER
    data = np.frombuffer(b"".join(x for t in texts for x in (lead, t)), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64) + ORDER
    return data, np.cumsum(lengths) - lengths + ORDER


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte from the ORDER-th on: it with the `order` bytes before it, as a number."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(order, -1, -1):
        out = out << np.uint64(8) | data[ORDER - k : len(data) - k]
    return out


def own(starts: np.ndarray, size: int) -> np.ndarray:
    """Which of the positions from the ORDER-th on belong to a text."""
    held = np.ones(size, bool)
    for k in range(ORDER):
        lead = starts - ORDER + k - ORDER
        held[lead[lead >= 0]] = False
    return held


def counted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the grams of the texts, in order, and how often each one comes."""
    data, starts = padded(texts)
    held = own(starts, len(data) - ORDER)
    return [np.unique(grams(data, k)[held], return_counts=True) for k in range(ORDER + 1)]


def rows_at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number asked for is among the keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Lookup:
    """Finds numbers among fixed, distinct ones: their hashes pick a bucket, whose members are tried in turn."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 2))))
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        self.keys, self.rows, home = keys[order], order.astype(np.int32), home[order]
        self.first = np.searchsorted(home, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max()) if len(keys) else 0
        self.keys = np.append(self.keys, np.zeros(self.most + 1, np.uint64))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each number among the keys, or -1."""
        home = self._home(asked)
        at, end = self.first[home], self.first[home + np.uint64(1)]
        out = np.full(len(asked), -1, np.int32)
        hit = (self.keys[at] == asked) & (at < end)
        out[hit] = self.rows[at[hit]]
        rest = np.flatnonzero(~hit & (at + 1 < end))
        for step in range(1, self.most):
            if not len(rest):
                break
            place = at[rest] + step
            hit = self.keys[place] == asked[rest]
            out[rest[hit]] = self.rows[place[hit]]
            rest = rest[~hit & (place + 1 < end[rest])]
        return out


@dataclass
class Languages:
    """Bits that each language's tree takes to code a byte in its context.

    A context with T occurrences and D different bytes after it codes a byte seen c times there with
    -log2(c / (T + D)) bits, and escapes to the context without its first byte with -log2(D / (T + D)); a context that was never
    seen escapes for nothing. Below the empty context all 256 bytes are alike. codes[k] has a row for each gram of
    k + 1 bytes that any language has seen, with all escapes on its way; escapes[k] one for each context of k bytes.
    """

    names: list[str]
    grams: list[np.ndarray]
    codes: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def of(cls, trees: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Languages:
        """From each language's counted grams by order."""
        names = sorted(trees)
        out = cls(names, [], [], [], [])
        for k in range(ORDER + 1):
            union = np.unique(np.concatenate([trees[n][k][0] for n in names]))
            above = np.unique(union >> np.uint64(8))
            codes, escapes = np.zeros((len(union), len(names))), np.zeros((len(above), len(names)))
            parent = rows_at(above, union >> np.uint64(8))[0]
            if k:
                shorter = out.codes[k - 1][rows_at(out.grams[k - 1], union & np.uint64((1 << 8 * k) - 1))[0]]
            else:
                shorter = np.full((len(union), len(names)), 8.0)
            for j, name in enumerate(names):
                keys, counts = trees[name][k]
                seen, context = rows_at(union, keys)[0], rows_at(above, keys >> np.uint64(8))[0]
                total, different = np.bincount(context, counts, len(above)), np.bincount(context, minlength=len(above))
                known = total > 0
                escapes[known, j] = np.log2((total + different)[known] / different[known])
                codes[:, j] = escapes[parent, j] + shorter[:, j]
                codes[seen, j] = np.log2((total + different)[context] / counts)
            out.grams.append(union)
            out.codes.append(codes)
            out.contexts.append(above)
            out.escapes.append(escapes)
        return out

    def prepare(self) -> list[tuple[Lookup, Lookup]]:
        return [(Lookup(g), Lookup(c)) for g, c in zip(self.grams, self.contexts)]

    def coded(self, data: np.ndarray, held: np.ndarray, tables: list[tuple[Lookup, Lookup]]) -> np.ndarray:
        """The bits for each byte of data from the ORDER-th on; none where it isn't held."""
        bits = np.zeros((len(held), len(self.names)))
        rest = np.flatnonzero(held)
        asked = grams(data, ORDER)[rest]
        for k in range(ORDER, -1, -1):
            found = tables[k][0].find(asked)
            hit = found >= 0
            bits[rest[hit]] += self.codes[k][found[hit]]
            rest, asked = rest[~hit], asked[~hit]
            if not len(rest):
                return bits
            context = tables[k][1].find(asked >> np.uint64(8))
            bits[rest[context >= 0]] += self.escapes[k][context[context >= 0]]
            asked = asked & np.uint64((1 << 8 * k) - 1)
        bits[rest] += 8.0
        return bits

    def lengths(self, texts: list[bytes], tables: list[tuple[Lookup, Lookup]]) -> np.ndarray:
        """The bits that each language takes to code each text. Bytes are coded in stretches of bounded size, each with the bytes before it as context."""
        data, starts = padded(texts)
        held, sums = own(starts, len(data) - ORDER), np.zeros((len(texts), len(self.names)))
        begins, size = starts - ORDER, max(1024, CODED // len(self.names))
        for a in range(0, len(held), size):
            b = min(a + size, len(held))
            bits = self.coded(data[a : b + ORDER], held[a:b], tables)
            first, last = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b, "left")
            inside = np.maximum(begins[first:last] - a, 0)  # texts without bytes have only what leads to the next one, which takes no bits
            sums[first:last] += np.add.reduceat(bits, inside)
        return sums


def trees_of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, k, gram, n) of a language's sample, which LANGUAGE_BYTES bounds."""
    counts = counted([t.encode() for t in sorted(rows["part"])])
    parts = [pd.DataFrame({"lang": key[0], "k": k, "gram": g.view(np.int64), "n": n}) for k, (g, n) in enumerate(counts)]
    return pd.concat(parts)


def fit(docs: DataFrame, language_bytes: int = LANGUAGE_BYTES, cells: int = CELLS) -> Languages | None:
    """Trees out of docs (text, lang), or None if no row has a language and a text that isn't empty.

    A language's tree is counted from different texts whose hashes are below a bound, so that about `language_bytes` bytes are
    taken (fewer for many languages: `cells` over the square of their number), and from that with the least hash in any case. Of a longer text
    a stretch of that many bytes is taken, at a place that its hash decides. Copies of a text count once. This sample of
    labelled rows is all that is bounded here; a value of lang is taken as it is, and over 1,024 values raise an error.
    """
    text = text_of(F.col("text"))
    labelled = docs.filter("text is not null and text <> '' and lang is not null").select("lang", text.alias("text"), F.xxhash64(text).alias("h"))
    sizes = labelled.groupBy("lang", "h").agg(F.max(F.octet_length("text")).cast("long").alias("size")).groupBy("lang").agg(F.sum("size").alias("total"), F.min("h").alias("least")).limit(1025).collect()
    if not sizes:
        return None
    if len(sizes) > 1024:
        raise ValueError("more than 1,024 values of lang")
    most = max(64, min(language_bytes, cells // len(sizes) ** 2))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["total"]), r["least"]) for r in sizes], "lang string, share double, least long")
    start = F.pmod("h", F.greatest(F.length("text") - most + 1, F.lit(1))) + 1
    cut = F.when(F.octet_length("text") > most, F.substring("text", start.cast("int"), F.lit(most))).otherwise(F.col("text"))
    chosen = labelled.join(F.broadcast(share), "lang").filter((F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < F.col("share") * (1 << 40)) | (F.col("h") == F.col("least")))
    sample = chosen.groupBy("lang", "h").agg(F.min(cut).alias("part"))
    trees: dict[str, list] = {}
    for name, rows in sample.groupBy("lang").applyInPandas(trees_of, "lang string, k int, gram long, n long").toPandas().groupby("lang"):
        by = [rows[rows["k"] == k].sort_values("gram") for k in range(ORDER + 1)]
        trees[name] = [(b["gram"].to_numpy().view(np.uint64), b["n"].to_numpy()) for b in by]
    return Languages.of(trees)


def predict(docs: DataFrame, model: Languages | None) -> DataFrame:
    """docs without `text`, with `lang_pred` and `score`: the language whose tree codes the text in the fewest bits, and its share of all languages' probability.

    Only the text is read. A null text, or one without a letter, is `und` with score 0, as is each where there is no model; of languages
    that take as many bits the first by name counts. Whole texts are coded, row by row, so repeated and very long
    ones need nothing special. An empty table stays empty. Columns of docs with the names of new ones are replaced.
    """
    (source,), kept = free_names(docs, "text"), without(docs, "text", "lang_pred", "score")
    lettered = F.when(F.col("text").cast("string").rlike(r"\p{L}"), F.col("text").cast("string"))
    rows = docs.select(*kept, lettered.alias(source))
    if model is None:
        return rows.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tables = model.prepare()
        names = np.array(model.names, object)
        for batch in batches:
            column = batch.column(source)
            for a, b in slices([n or 0 for n in pc.binary_length(column).to_pylist()], BATCH_BYTES):
                texts = [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
                bits = model.lengths(texts, tables)
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1)
                none = np.array([not t for t in texts], bool)
                found, score = np.where(none, UNKNOWN, names[best]), np.where(none, 0.0, score)
                rest = [batch.column(c).slice(a, b - a) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(found.tolist(), pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(told, T.StructType([docs.schema[c] for c in kept] + new))
