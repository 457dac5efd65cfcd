"""Chat formatting at the level of tokens.

Each turn becomes <|turn|> role <|content|> text <|end|>. Role and text are encoded each for itself,
so that no token spans two segments; the marks are reserved ids spliced in between, which no text can
produce. The loss mask is a prefix sum: +1 where an assistant's text begins, -1 where it ends.

Control strings (of this template and of other common ones) that occur in a text are escaped by one
backslash behind their first character, or one more if there are some, which is undone in reading back.

Scale: format_turns formats turns each for itself in whatever partition they lie. digest shuffles the turns
as they are, not their tokens: conversations are put together by a sort within partitions of their ids,
and then formatted and read back as a stream, never gathered.

Edge cases: null texts and roles count as empty; a null turn comes first, and a null conv_id is a
conversation of its own; equal turns are ordered by role and text; repeated rows are turns each; an
empty table gives an empty result; input columns named as a result column are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.functions.shipping import release, ship

from .bpe import Codec, codec, map_columns, slices, vocabulary

TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
RESERVED = (TURN, CONTENT, END)
#: What stands behind the first character of a control string, after any backslashes.
REST = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|/?<?/?SYS>>)"
ANY, ESCAPED = regex.compile(r"([<\[])(\\*)" + REST), regex.compile(r"([<\[])\\(\\*)" + REST)


def escape(text: str) -> str:
    return ANY.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def join(segments: list[np.ndarray], trained: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, mask and number of tokens of each turn. segments: role, text, role, text and so on."""
    sizes = np.array([len(x) for x in segments], np.int64).reshape(-1, 2)
    length = sizes.sum(1) + 3
    start = np.cumsum(length) - length
    content = start + 1 + sizes[:, 0]
    end = content + 1 + sizes[:, 1]
    ids = np.empty(int(length.sum()), np.int32)
    spliced = np.zeros(len(ids), bool)
    for at, mark in zip((start, content, end), marks, strict=True):
        ids[at], spliced[at] = mark, True
    ids[~spliced] = np.concatenate(segments) if segments else []
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, content[trained] + 1, 1)
    np.add.at(change, end[trained], -1)
    return ids, np.cumsum(change)[:-1].astype(bool), length


def assemble(roles: list[str | None], texts: list[str | None], own: Codec, trained_role: str) -> Iterator[tuple[slice, list[str], list[np.ndarray], list[np.ndarray]]]:
    """Turns in slices: their range, the escaped role and text of each, one behind another, and tokens and mask of each."""
    marks = np.array([own.reserved[x] for x in RESERVED])
    for a, b in slices(texts):
        parts = [escape(x or "") for pair in zip(roles[a:b], texts[a:b], strict=True) for x in pair]
        trained = np.array([r == trained_role for r in roles[a:b]], bool)
        ids, mask, length = join(own.encode(parts, special=False), trained, marks)
        edges = np.cumsum(length)[:-1]
        yield slice(a, b), parts, np.split(ids, edges), np.split(mask, edges)


def format_turns(turns: DataFrame, vocab_path: str, *, role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """turns with token_ids, loss_mask (a value for each token) and formatted (the turn as a string)."""
    held = vocabulary(turns.sparkSession, vocab_path)
    fields = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType())), T.StructField("formatted", T.StringType())]

    def make(batch: pa.RecordBatch) -> Iterator:
        own = codec(held.value, RESERVED)
        for at, parts, ids, mask in assemble(*(batch.column(c).to_pylist() for c in (role_col, text_col)), own, trained_role):
            whole = [f"{TURN}{parts[k]}{CONTENT}{parts[k + 1]}{END}" for k in range(0, len(parts), 2)]
            yield (at.start, at.stop), [ids, mask, whole]

    return map_columns(turns, T.StructType(fields), make)


def read_back(ids: np.ndarray, mask: np.ndarray, own: Codec) -> tuple[str, str, str, str]:
    """Role, text, text under the mask, and the whole string of one formatted turn, from its tokens."""
    raw = list(map(own.bytes.__getitem__, ids.tolist()))
    said = lambda some: b"".join(some).decode("utf-8", "replace")
    at = [int(np.flatnonzero(ids == own.reserved[x])[0]) for x in RESERVED]
    role, text = said(raw[at[0] + 1 : at[1]]), said(raw[at[1] + 1 : at[2]])
    return unescape(role), unescape(text), unescape(said(compress(raw, mask.tolist()))), said(raw)


def digest(turns: DataFrame, vocab_path: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """A row for each conversation: its turns formatted in order, and read back from tokens and mask alone."""
    held = vocabulary(turns.sparkSession, vocab_path)
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    schema = T.StructType([T.StructField(conv_col, turns.schema[conv_col].dataType), *(T.StructField(n, T.StringType() if n.endswith("256") else T.LongType()) for n in names)])
    kinds = [pa.string() if n.endswith("256") else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(held.value, RESERVED)
        conv, kind, n, loss_chars, chars = None, None, 0, 0, 0
        whole, loss = hashlib.sha256(), hashlib.sha256()

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), [kind, *kinds], strict=True)], names=schema.names)

        for batch in batches:
            kind, done = batch.schema.field(conv_col).type, []
            convs, roles, texts = (batch.column(c).to_pylist() for c in (conv_col, role_col, text_col))
            for at, _, ids, mask in assemble(roles, texts, own, trained_role):
                for key, i, m in zip(convs[at], ids, mask, strict=True):
                    if n and key != conv:
                        done.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                        n, loss_chars, chars = 0, 0, 0
                        whole, loss = hashlib.sha256(), hashlib.sha256()
                    role, text, learned, formatted = read_back(i, m, own)
                    whole.update(f"{role}\n{text}\n".encode())
                    loss.update(learned.encode())
                    conv, n, loss_chars, chars = key, n + 1, loss_chars + len(learned), chars + len(formatted)
            if done:
                yield rows(done)
        if n:
            yield rows([(conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars)])
        own.forget()
        release()

    ship(turns.sparkSession)
    ordered = turns.select(conv_col, turn_col, role_col, text_col).repartition(conv_col).sortWithinPartitions(conv_col, turn_col, role_col, text_col)
    return ordered.select(conv_col, role_col, text_col).mapInArrow(run, schema)
