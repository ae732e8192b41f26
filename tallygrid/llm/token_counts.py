"""Token counts of whole texts, lengths only.

Long texts are cut at single blanks, where the model provably never joins pieces: no
piece holds a blank after another character, and the blank that is cut away comes back
as the dummy prefix of the next part. Parts are encoded in calls of about equal bytes,
and only their lengths leave the worker. Where a model lacks that property, texts are
encoded whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows count
equally; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import map_batches, texts

#: Length of a part in characters, and of one call to the library in bytes.
PART, CALL = 2_000, 500_000
BLANK = "▁"


@functools.cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def splits_at_blanks(path: str) -> bool:
    """Whether cutting at a single blank leaves all pieces as they are."""
    model = processor(path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    inner = any(BLANK in p.lstrip(BLANK) for p in pieces)
    prefixed = "".join(model.encode("a", out_type=str)) == BLANK + "a"
    keeps_blanks = "".join(model.encode("a  a", out_type=str)) == f"{BLANK}a{BLANK}{BLANK}a"
    return not inner and prefixed and keeps_blanks


_CUT = re.compile(f"(?<=[^ {BLANK}]) (?=[^ {BLANK}])")


def parts(text: str, size: int = PART) -> list[str]:
    """The text cut at the first single blank after every ``size`` characters."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.end()
    out.append(text[start:])
    return out


def lengths(path: str, batch: list[str]) -> list[int]:
    """Number of ids of every text."""
    model, cut = processor(path), splits_at_blanks(path)
    counts = [0] * len(batch)
    owners: list[int] = []
    held: list[str] = []
    size = 0

    def encode() -> None:
        for owner, ids in zip(owners, model.encode(held, num_threads=1)):
            counts[owner] += len(ids)
        owners.clear()
        held.clear()

    for k, text in enumerate(batch):
        for part in (parts(text) if cut else [text]):
            owners.append(k)
            held.append(part)
            size += len(part.encode())
            if size >= CALL:
                encode()
                size = 0
    if held:
        encode()
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) with the model file at ``path``."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = lengths(path, texts(batch))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()),
                 pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        return work
    text = F.col("text").cast("string")
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return map_batches(source, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
