"""Order MinHash fingerprints, which follow edit distance rather than set overlap.

Every k-mer of a text gets the number of its occurrence. Each of the hash functions selects
the few numbered k-mers with the smallest values, puts them back in the order of the text and
hashes the tuple. Two texts agree at a position of the fingerprint if they share those k-mers
in the same order.

For comparison with an edited text every document needs the next one by id. Documents are
dealt into ranges of ids and sorted within them; each range also gets the first document of
the next one, so that neighbours meet in one pass over the texts. Ranges are cut at a sample
of the ids, taken by hash; their number follows from the bytes of the texts alone, and so does that
of the tasks. Many rows of one id are cut by the hash of their text too; a task streams its rows and computes
the fingerprint of a run of equal texts once.

Defined results: a null text counts as empty; an empty text has the all-zero fingerprint; a
text shorter than a k-mer is one k-mer; texts of any length are hashed whole; equal ids are
ordered by the hash of their text, a null id comes first; a single document is its own
neighbour; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import map_batches, stored, texts
from tallygrid.llm.ngram_join import mix
from tallygrid.llm.textstats import code_points

#: Length of a k-mer in code points, k-mers per tuple, and hash functions.
K, TUPLE, FUNCTIONS = 8, 2, 64
#: There are a range per so many bytes of text, and as many more as the square root of the number of
#: small pieces, so that little text is spread too; sampled ids per range.
RANGE_BYTES, PIECE_BYTES, SAMPLED = 64 << 20, 256 << 10, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 2048
_LOW = np.uint64(0xFFFFFFFF)


def kmers(text: str, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's k-mers, and of the k-mers with their occurrence numbers."""
    points = code_points(text).astype(np.uint64)
    width = min(k, len(points))
    count = len(points) - width + 1
    total = np.full(count, width, dtype=np.uint64)
    for j in range(width):
        total = total * _STEP + points[j:j + count]
    total = mix(total) >> np.uint64(32)
    # Sorted by hash and place at once; the distance from the first of its kind numbers a k-mer.
    ordered = np.sort(total << np.uint64(32) | np.arange(count, dtype=np.uint64))
    kind, place = ordered >> np.uint64(32), (ordered & _LOW).astype(np.int64)
    first = np.concatenate(([True], kind[1:] != kind[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(count), 0))
    number = np.empty(count, dtype=np.uint64)
    number[place] = (np.arange(count) - start).astype(np.uint64)
    return total, mix(total * _STEP + number)


def fingerprint(text: str, k: int = K, size: int = TUPLE, functions: int = FUNCTIONS) -> np.ndarray:
    """One 32-bit hash per function."""
    if not text:
        return np.zeros(functions, dtype=np.uint32)
    kinds, numbered = kmers(text, k)
    points = (numbered >> np.uint64(32)).astype(np.uint32)
    size = min(size, len(points))
    random = np.random.default_rng(7_919)
    factor = (random.integers(0, 1 << 32, functions, dtype=np.uint32) | np.uint32(1))[:, None]
    shift = random.integers(0, 1 << 32, functions, dtype=np.uint32)[:, None]
    rows = np.arange(functions)
    found = []
    for begin in range(0, len(points), _BLOCK):
        values = points[None, begin:begin + _BLOCK] * factor + shift
        for _ in range(min(size, values.shape[1])):
            at = values.argmin(axis=1)
            found.append(values[rows, at].astype(np.uint64) << np.uint64(32) | (at + begin).astype(np.uint64))
            values[rows, at] = 0xFFFFFFFF
    best = np.sort(np.stack(found), axis=0)[:size] & _LOW
    best.sort(axis=0)
    total = np.full(functions, size, dtype=np.uint64)
    for row in best:
        total = mix(total * _STEP + kinds[row.astype(np.int64)])
    return (total >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The second half of the text, rounded down, replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = [written(fingerprint(t)) for t in texts(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])
        return work
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, "doc_id long, fingerprint string", make)


def cuts(narrow: DataFrame) -> np.ndarray:
    """The (key, mark) at which ranges begin, but for the first; by a sample of the rows."""
    size = narrow.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = size["bytes"] or 0
    count = max(1, math.ceil(total / RANGE_BYTES + math.sqrt(total / PIECE_BYTES)))
    every = max(1, size["rows"] // (count * SAMPLED))
    chosen = narrow.where(F.pmod(F.xxhash64("key", "mark"), F.lit(every)) == 0).select("key", "mark").distinct().toArrow()
    places = np.rec.fromarrays([chosen["key"].to_numpy(), chosen["mark"].to_numpy()], names="key,mark")
    places.sort(order=("key", "mark"))
    return places[[k * len(places) // count for k in range(1, count)]] if len(places) else places


def place(bounds: np.ndarray, key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The number of bounds at or before each (key, mark)."""
    low, high = np.searchsorted(bounds["key"], key, "left"), np.searchsorted(bounds["key"], key, "right")
    out = high.copy()
    for k in np.flatnonzero(low < high):  # the key itself is a bound
        out[k] = low[k] + np.searchsorted(bounds["mark"][low[k]:high[k]], mark[k], "right")
    return out


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(part, guest, key, mark, doc_id, text) sorted by the first four within each partition: rows of
    a range, then the first row of the next range as its guest; after the last range the first."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("mark"),
                         doc_id.alias("doc_id"), text.alias("text"))
    narrow = stored(source.select("key", "mark", F.octet_length("text").alias("bytes")), "id_ranges")
    bounds = cuts(narrow)

    @F.pandas_udf("int")
    def part(key: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series(place(bounds, key.to_numpy(), mark.to_numpy()))

    # A row per range.
    firsts = narrow.groupBy(part("key", "mark").alias("part")).agg(F.min(F.struct("key", "mark")).alias("first")).select(
        "part", "first.*").orderBy("part").toPandas()
    first = {(k, m): int(p) for k, m, p in zip(firsts["key"], firsts["mark"], np.roll(firsts["part"], 1))}

    @F.pandas_udf("array<int>")
    def parts(key: pd.Series, mark: pd.Series) -> pd.Series:
        own = place(bounds, key.to_numpy(), mark.to_numpy())
        hosts = (first.get(row) for row in zip(key, mark))
        return pd.Series([[p] if host is None else [p, host] for p, host in zip(own.tolist(), hosts)])

    rows = source.select(F.posexplode(parts("key", "mark")).alias("guest", "part"), "key", "mark", "doc_id", "text")
    tasks = max(len(bounds) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "part").sortWithinPartitions("part", "guest", "key", "mark")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next text."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, repeated = None, (None, ())  # the text of a run of equal ones, and its result
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))
            for part, guest, doc_id, text in zip(*columns):
                own = before[3] if before is not None and before[2] == text else fingerprint(text)
                if before is not None and before[0] == part:
                    _, last_id, last_text, last = before
                    if own is not last or last is not repeated[0]:
                        changed = edited(last_text, text)
                        new = fingerprint(changed)
                        shown = (len(last_text), hashlib.sha256(changed.encode()).hexdigest(),
                                 written(last), written(new), likeness(last, new), likeness(last, own))
                        repeated = (last if own is last else None, shown)
                    out.append((last_id, *repeated[1]))
                before = None if guest else (part, doc_id, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * len(names), kinds)], list(names))

    return with_neighbours(docs).select("part", "guest", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
