"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole: its turns in order, each with a header that names the role
and a mark at its end. The marks are control tokens of the tokenizer, so no token crosses from
a mark into a text. Control strings inside roles and texts are escaped with a backslash after
their first character, and backslashes are doubled, so that nothing but the template makes
control tokens and the texts come back exactly. The rendered text is encoded once with
offsets; the spans of assistant texts and of tokens are both sorted, and binary search finds
the tokens under each span.

Rows are dealt by conversation and sorted by Spark, and one pass renders conversation after
conversation, so a task holds one call's conversations at a time, however many rows it reads.

Defined results: null texts and roles count as empty; turns with equal numbers are ordered by
role and text; repeated rows are turns of their own; rows without a conversation id are one
conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARNED = "assistant"
#: Characters rendered before one call to the tokenizer.
CALL = 400_000


class Template:
    """The tokenizer with the template's marks, and the escaping of its control strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.add_special_tokens([BEGIN, HEAD, BODY, END])
        controls = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.control = re.compile("|".join(map(re.escape, controls)))

    def escape(self, text: str) -> str:
        return self.control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted conversation and the spans of the learned texts in it."""
        out, spans, at = [BEGIN], [], len(BEGIN)
        for role, text in turns:
            head = HEAD + self.escape(role) + BODY
            body = self.escape(text)
            if role == LEARNED:
                spans.append((at + len(head), at + len(head) + len(body)))
            out += (head, body, END)
            at += len(head) + len(body) + len(END)
        return "".join(out), spans


@functools.cache
def template(path: str) -> Template:
    return Template(path)


def under(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted spans."""
    mask = np.zeros(len(starts) + 1, dtype=np.int64)
    if spans:
        low, high = np.array(spans).T
        np.add.at(mask, np.searchsorted(ends, low, side="right"), 1)
        np.add.at(mask, np.searchsorted(starts, high, side="left"), -1)
    return mask.cumsum()[:-1] > 0


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(conversations: DataFrame, path: str) -> DataFrame:
    """(conv_id, formatted, ids, starts, ends, loss) of every conversation: the rendered text, its
    tokens with their offsets in characters, and the loss mask."""
    names = ["conv_id", "formatted", "ids", "starts", "ends", "loss"]
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = template(path)
        held: list[tuple] = []

        def encode() -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for (conv, text, spans), e in zip(held, rules.tokenizer.encode_batch([h[1] for h in held], add_special_tokens=False)):
                offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
                row = conv, text, e.ids, offsets[:, 0], offsets[:, 1], under(spans, offsets[:, 0], offsets[:, 1])
                for column, value in zip(columns, row):
                    column.append(value)
            held.clear()
            kinds = (pa.int64(), pa.string(), ints, ints, ints, pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        turns: list[tuple[str, str]] = []
        now, size = None, 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if turns and conv != now:
                    held.append((now, *rules.render(turns)))
                    size += len(held[-1][1])
                    turns = []
                    if size >= CALL:
                        yield encode()
                        size = 0
                now = conv
                turns.append((role or "", text or ""))
        if turns:
            held.append((now, *rules.render(turns)))
        if held:
            yield encode()

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(
        run, "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>")


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for turn in text[len(BEGIN):].split(END)[:-1]:
        role, _, body = turn[len(HEAD):].partition(BODY)
        out.append((unescape(role), unescape(body)))
    return out


def masked(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """The text under the loss mask: each run of masked tokens from its first to its last character."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], loss.astype(np.int8), [0]))))
    return "".join(unescape(text[starts[a]:ends[b - 1]]) for a, b in edges.reshape(-1, 2))


def read_back(output: DataFrame) -> DataFrame:
    """Digests of what a formatted table says, from its rendered texts, offsets and masks alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                text = batch.column("formatted")[k].as_py()
                starts, ends, loss = (
                    batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
                turns = parsed(text)
                learned = masked(text, starts, ends, loss)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), _sha(said), len(learned), _sha(learned), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names)

    return output.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
