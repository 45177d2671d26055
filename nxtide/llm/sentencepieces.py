"""SentencePiece models run by the tokenizers library."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from nxtide.llm.common import free_names, slices, text_of, without

#: Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
#: Begins a name that no text has, of a piece that no text may become.
NO_TEXT = "\ufdd0"
#: Byte pieces stand for what no other piece covers, so that their own names in a text are text.
LAST = 1e4
#: Code points that the tokenizer gets at a time.
CHARS = 1 << 19


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message; floats are left as bytes."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """What a SentencePiece model file says: pieces (text, score, kind), its kind, and how it normalises."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.suffix = bool(trainer.get(24, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.squeeze = bool(norm.get(4, 1))
        self.escape = bool(norm.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with an escaped, leading space are known")

    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def symbols(self) -> list[str]:
        """User-defined pieces, which are taken out of a text whole."""
        return [p for p, _, kind in self.pieces if kind == USER]

    def _vocabulary(self) -> list[tuple[str, float]]:
        """Pieces and scores of a unigram model: a user-defined piece outdoes what else covers it; no text becomes a control piece."""
        scores = [score for _, score, kind in self.pieces if kind == NORMAL] or [0.0]
        low, high = min(scores), max(scores)
        return [
            (p, score) if kind == NORMAL else (p, len(p) * high - 0.1) if kind == USER else (p, low - LAST) if kind == BYTE else (f"{NO_TEXT}{i}", low)
            for i, (p, score, kind) in enumerate(self.pieces)
        ]

    def normalizer(self):
        """What is done to a text before its pieces are found."""
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
        plain = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
        changed = [p for p in self.symbols() if " " in p or SPACE in p or plain.normalize_str(p) != p]
        if changed:
            raise ValueError(f"user-defined pieces that normalising would change are not known: {changed[:3]}")
        return normalizers.Sequence([*steps, *([normalizers.Prepend(SPACE)] * self.dummy_prefix), normalizers.Replace(" ", SPACE)])

    def tokenizer(self) -> Tokenizer:
        """Scores or merges, user-defined pieces, and byte fallback, as a tokenizer of the other library; its texts are normalised by normalizer()."""
        byte_fallback = any(p[2] == BYTE for p in self.pieces)
        if self.kind == UNIGRAM:
            out = Tokenizer(models.Unigram(self._vocabulary(), self.unknown(), byte_fallback))
        else:
            if any(kind == UNUSED for _, _, kind in self.pieces):
                raise ValueError("unused pieces of a BPE model are not known")
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            plain = {p for p, _, kind in self.pieces if kind == NORMAL}
            merges = [(-score, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, score, kind in self.pieces if kind == NORMAL for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
            out = Tokenizer(models.BPE(ids, [(a, b) for *_, a, b in sorted(merges)], unk_token=self.pieces[self.unknown()][0], fuse_unk=True, byte_fallback=byte_fallback))
            out.add_tokens([AddedToken(p, normalized=False) for p in self.symbols()])  # they have their ids; the text is split at them
        ends = [decoders.Strip(" ", 1, 0)] * self.dummy_prefix
        out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
        out.encode_special_tokens = True
        return out


class Loaded:
    """A model's tokenizer. Without user-defined pieces it normalises texts itself, in its threads; else that is done before it splits them."""

    def __init__(self, data: bytes):
        model = Model(data)
        self.tokenizer, normalizer = model.tokenizer(), model.normalizer()
        self.before = normalizer if model.symbols() and model.kind == BPE else None
        if self.before is None:
            self.tokenizer.normalizer = normalizer

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; a bounded number of texts at a time, by the library's own threads."""
        for a, b in slices(map(len, texts), CHARS):
            part = texts[a:b] if self.before is None else [self.before.normalize_str(t) for t in texts[a:b]]
            for one in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                yield np.array(one.ids, np.int32)

    def decode(self, ids: list) -> list[str]:
        return [x for a, b in slices(map(len, ids), CHARS) for x in self.tokenizer.decode_batch([list(map(int, i)) for i in ids[a:b]], skip_special_tokens=False)]


@lru_cache(maxsize=4)
def loaded(path: str) -> Loaded:
    with open(path, "rb") as f:
        return Loaded(f.read())


#: Texts that a model's rebuilding must get right before it is used.
PROBES = ("", " ", "Hello, world!", "  two  spaces \n\t and more ", "na\u00efve caf\u00e9 \ufb01 \u00bd \u212b", "\u65e5\u672c\u8a9e \ud55c\uad6d\uc5b4 \u0395\u03bb\u03bb\u03b7\u03bd\u03b9\u03ba\u03ac", "<s>quick</s><unk> <pad>", "<0x41><0x0A>", "\u2581under\u2581score", "\U0001f600\U0001f9d1\u200d\U0001f680", "1234567890 3.14", "if (x < 3) { return y; }")


@lru_cache(maxsize=16)
def verify(path: str) -> None:
    """Raises if the rebuilt model and the SentencePiece library give other ids for PROBES, user-defined pieces within words, or runs of pieces."""
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read()
    own, model = sentencepiece.SentencePieceProcessor(model_proto=data), Model(data)
    pieces = [p.replace(SPACE, " ") for p, _, kind in model.pieces if kind in (NORMAL, USER)]
    texts = [*PROBES, *(f"quick{p}foo {p} bar{p}{p}" for p in model.symbols()[:50]), *("".join(pieces[i::97][:40]) for i in range(20))]
    for text, ids in zip(texts, Loaded(data).encode(texts)):
        if ids.tolist() != own.encode(text):
            raise ValueError(f"{path}: the rebuilt model splits {text!r} in another way than the SentencePiece library")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs without `text`, with `ids`, `n_tokens` and `decoded`: whether the ids decode to the text again.

    path: a model file that each executor has at the same place; it is rebuilt, and verified on the driver
    first. Null and empty texts have no ids. No begin, end or special ids are added; control strings in a
    text are text, user-defined pieces are themselves. Each row is encoded on its own, whole, so
    repeated and very long texts need nothing special; a task holds the ids of about CHARS code
    points, or of one text. An empty table stays empty. Columns of docs with the names of new ones are replaced.
    """
    verify(path)
    new = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("decoded", "boolean")
    kept, (source,) = without(docs, "text", *new.names), free_names(docs, "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for batch in batches:
            column = batch.column(source)
            for a, b in slices(pc.utf8_length(column).to_pylist(), CHARS):
                texts = column.slice(a, b - a).to_pylist()
                ids = list(tokenizer.encode(texts))
                sizes = np.array([len(i) for i in ids])
                values = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
                same = [x == y for x, y in zip(tokenizer.decode(ids), texts)]
                rest = [batch.column(c).slice(a, b - a) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(sizes.astype(np.int64)), pa.array(same)], names=[*kept, *new.names])

    rows = docs.select(*kept, text_of(F.col("text")).alias(source))
    return rows.mapInArrow(pieces, T.StructType([docs.schema[c] for c in kept] + new.fields))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with `text`, decoded from their ids; null ids give a null text. A column `text` of rows is replaced."""

    @F.pandas_udf("string")
    def texts(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = loaded(path)
        for column in frames:
            found = iter(tokenizer.decode([i for i in column if i is not None]))
            yield pd.Series([None if i is None else next(found) for i in column], dtype=object)

    return rows.withColumn("text", texts(F.col(ids)))
