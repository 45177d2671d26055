"""Chat formatting by assembly of tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nxtide.llm.common import slices, text_of

#: Control strings of the template and the ids reserved for them, past those of the vocabulary (50,257).
CONTROLS = {"<|turn|>": 50257, "<|text|>": 50258, "<|end|>": 50259}
OPEN, BODY, CLOSE = CONTROLS.values()
STRINGS = {i: s for s, i in CONTROLS.items()}
#: Every control string begins with it.
LEAD = "<|"
LEARNED = "assistant"
CHARS = 1 << 20


def escape(text: str) -> str:
    """The text with its backslashes doubled and one put into each LEAD, so that it holds no control string."""
    return text.replace("\\", "\\\\").replace(LEAD, "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


@lru_cache(maxsize=4)
def loaded(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


def format_chats(turns: DataFrame, path: str) -> DataFrame:
    """(conv_id, n_turns, input_ids, loss_mask) for the rows (conv_id, turn, role, text) of conversations.

    A turn is <|turn|> role <|text|> text <|end|>. Roles and texts are escaped and encoded
    one by one, turn by turn, wherever the rows are; ids of control strings are put between
    them and come from nowhere else. The mask is 1 on the ids of an assistant's text. Turns
    are in order of turn (null first), then role, then text; repeated rows stay. Null roles and
    texts are empty, and a null conv_id is a conversation. A conversation is one row, however long; an
    empty table gives none. Further columns are not read.
    """

    @F.pandas_udf("struct<role_ids: array<int>, text_ids: array<int>>")
    def encoded(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenizer = loaded(path)
        for roles, texts in frames:
            segments = [escape(s) for pair in zip(roles, texts) for s in pair]
            ids = [np.array(e.ids, np.int32) for a, b in slices(map(len, segments), CHARS) for e in tokenizer.encode_batch_fast(segments[a:b], add_special_tokens=False)]
            yield pd.DataFrame({"role_ids": ids[::2], "text_ids": ids[1::2]})

    @F.pandas_udf("struct<input_ids: array<int>, loss_mask: array<byte>>")
    def assembled(conversations: pd.Series) -> pd.DataFrame:
        out = [_assemble(turns) for turns in conversations]
        return pd.DataFrame({"input_ids": [a for a, _ in out], "loss_mask": [b for _, b in out]})

    rows = turns.select("conv_id", "turn", text_of(F.col("role")).alias("role"), text_of(F.col("text")).alias("text"))
    rows = rows.select("conv_id", F.struct("turn", "role", "text", encoded("role", "text").alias("e")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    learned = F.transform("ts", lambda t: F.struct(t["e"]["role_ids"].alias("role_ids"), t["e"]["text_ids"].alias("text_ids"), (t["role"] == LEARNED).alias("learned")))
    return chats.select("conv_id", F.size("ts").cast("long").alias("n_turns"), assembled(learned).alias("a")).select("conv_id", "n_turns", "a.*")


def _assemble(turns) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all turns, and their mask: prefix sums of +1 where a learned text begins and -1 where it ends."""
    parts, steps, at = [], [], 0
    for t in turns:
        role, text = (np.asarray(t[k], np.int32) for k in ("role_ids", "text_ids"))
        parts += [[OPEN], role, [BODY], text, [CLOSE]]
        begin = at + len(role) + 2
        at = begin + len(text) + 1
        if t["learned"]:
            steps.append((begin, at - 1))
    change = np.zeros(at + 1, np.int8)
    for begin, end in steps:
        change[begin] += 1
        change[end] -= 1
    return np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32), np.cumsum(change[:-1], dtype=np.int8)


def read_back(chats: DataFrame, path: str) -> DataFrame:
    """Digests of formatted chats, all read from input_ids and loss_mask: see the contract of op3."""

    @F.pandas_udf("struct<turns_sha256: string, loss_chars: long, loss_sha256: string, formatted_chars: long>")
    def digests(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenizer = loaded(path)
        for ids, masks in frames:
            yield pd.DataFrame([_digest(tokenizer, np.asarray(i), np.asarray(m)) for i, m in zip(ids, masks)], columns=["turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.select("conv_id", "n_turns", digests("input_ids", "loss_mask").alias("d")).select("conv_id", "n_turns", "d.*")


def _digest(tokenizer: Tokenizer, ids: np.ndarray, mask: np.ndarray) -> tuple[str, int, str, int]:
    edges = [0, *(x for i in np.flatnonzero(ids >= OPEN).tolist() for x in (i, i + 1)), len(ids)]
    spans = [(a, b) for a, b in zip(edges, edges[1:])]
    texts = tokenizer.decode_batch([[] if b - a == 1 and ids[a] >= OPEN else ids[a:b].tolist() for a, b in spans], skip_special_tokens=False)
    turns, loss, chars, at = hashlib.sha256(), [], 0, CLOSE
    for (a, b), text in zip(spans, texts):
        if b - a == 1 and ids[a] >= OPEN:
            at = int(ids[a])
            chars += len(STRINGS[at])
            continue
        chars += len(text)
        if at != CLOSE:
            turns.update(unescape(text).encode() + b"\n")
        if b > a and mask[a:b].all():
            loss.append(unescape(text))
    learned = "".join(loss)
    return turns.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), chars
