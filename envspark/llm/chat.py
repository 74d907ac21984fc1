"""Operator 1, chat formatting: offset-aligned loss masks over whole rendered conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import table

BEGIN, END, USER, END_USER, ROLE, END_ROLE = "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"
CONTROL = (BEGIN, END, USER, END_USER, ROLE, END_ROLE)

#: A control string, or one that earlier escapes have kept apart by backslashes after its first character.
_HELD = re.compile(r"(<|\[)(\\*)(/?s>|/?INST\]|/?ROLE\])")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\]|/?ROLE\])")
_MARK = re.compile("|".join(re.escape(x) for x in CONTROL))

FORMATTED = "conv_id long, formatted string, ids array<int>, mask array<boolean>"


def escape(text: str) -> str:
    """The text with one backslash more inside every control string; holds no control string, and can be undone."""
    return _HELD.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of its assistant texts in it, in order.

    User turns are [INST]text[/INST], assistant turns text</s>, all others
    [ROLE]role[/ROLE]text</s>.
    """
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        said = escape(text)
        if role == "user":
            new = [USER, said, END_USER]
        elif role == "assistant":
            spans.append((at, at + len(said)))
            new = [said, END]
        else:
            new = [ROLE, escape(role), END_ROLE, said, END]
        parts += new
        at += sum(map(len, new))
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the string; the inverse of :func:`render`."""
    marks = [(m.start(), m.end(), m.group()) for m in _MARK.finditer(formatted)][1:]
    turns, at, k = [], len(BEGIN), 0
    while k < len(marks):
        start, end, mark = marks[k]
        if mark == END:
            turns.append(("assistant", unescape(formatted[at:start])))
            k += 1
        elif mark == USER:
            turns.append(("user", unescape(formatted[end : marks[k + 1][0]])))
            k += 2
        else:
            role = unescape(formatted[end : marks[k + 1][0]])
            turns.append((role, unescape(formatted[marks[k + 1][1] : marks[k + 2][0]])))
            k += 3
        at = marks[k - 1][1]
    return turns


class Masker:
    """Token ids of a rendered conversation and the mask of those that train.

    Control strings are added tokens, so no token reaches over the edge of a
    turn. Turn spans and token spans are both sorted: the tokens of a turn are
    found by binary search for its two edges.
    """

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.add_tokens([AddedToken(x, normalized=False) for x in CONTROL])

    def encode(self, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        edges = np.array(found.offsets, np.int64).reshape(-1, 2)
        wanted = np.array(spans, np.int64).reshape(-1, 2)
        first = np.searchsorted(edges[:, 1], wanted[:, 0], "right")
        last = np.searchsorted(edges[:, 0], wanted[:, 1], "left")
        steps = np.zeros(len(edges) + 1, np.int64)
        full = wanted[:, 1] > wanted[:, 0]
        np.add.at(steps, first[full], 1)
        np.add.at(steps, last[full], -1)
        return np.array(found.ids, np.int32), np.cumsum(steps[:-1]) > 0

    def masked_texts(self, ids: np.ndarray, mask: np.ndarray) -> list[str]:
        """The texts of the runs of masked tokens, decoded from their ids."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
        return [self.tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in edge.reshape(-1, 2)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def format_conversations(turns: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, mask (true where an assistant's text trains).

    Rows (conv_id, turn, role, text) are put in order of turn; rows of the same
    turn by role, then text, nulls first, repeated rows each. Null roles and
    texts are empty. Rows with a null conv_id form one conversation with a null
    id. Other columns are not read; an empty table gives no rows. A
    conversation is rendered whole, so it has to fit in a task; the rows of one
    are sent there once.
    """
    path = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masker = Masker(path)
        for pdf in batches:
            strings, ids, masks = [], [], []
            for roles, texts in zip(pdf["_roles"], pdf["_texts"]):
                formatted, spans = render(list(zip(roles, texts)))
                found = masker.encode(formatted, spans)
                strings.append(formatted)
                ids.append(found[0])
                masks.append(found[1])
            yield pd.DataFrame({"conv_id": pd.array([None if x is None else int(x) for x in pdf["_id"]], "Int64"), "formatted": strings, "ids": ids, "mask": masks})

    rows = turns.select("conv_id", F.struct("turn", "role", "text").alias("_turn"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    empty = F.lit("")
    columns = whole.select(
        F.col("conv_id").cast("string").alias("_id"),
        F.transform("_turns", lambda x: F.coalesce(x["role"], empty)).alias("_roles"),
        F.transform("_turns", lambda x: F.coalesce(x["text"], empty)).alias("_texts"),
    )
    return columns.mapInPandas(encode, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digest_of(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Counts and digests read back from formatted conversations: turns from the string, loss text from masked ids."""
    path = tokenizer or default_tokenizer()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masker = Masker(path)
        for pdf in batches:
            rows = []
            for conv, text, ids, mask in zip(pdf["_id"], pdf["formatted"], pdf["ids"], pdf["mask"]):
                turns = parse(text)
                said = hashlib.sha256()
                for role, words in turns:
                    said.update(f"{role}\n{words}\n".encode())
                loss = "".join(map(unescape, masker.masked_texts(np.asarray(ids), np.asarray(mask, bool))))
                rows.append((None if conv is None else int(conv), len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(ids), int(np.sum(mask))))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])
            yield out.assign(conv_id=pd.array([x[0] for x in rows], "Int64"))

    return formatted.select(F.col("conv_id").cast("string").alias("_id"), "formatted", "ids", "mask").mapInPandas(read, DIGEST)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{USER} ok {END_USER}"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_of(format_conversations(turns))
