"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams in order of
frequency. A document's own list is compared with each profile by the out-of-place
distance: the sum over its n-grams of the difference in rank, or the profile length
where the profile lacks the n-gram. Profiles are counted over all labelled texts.

Profiles are sparse: for each n-gram the languages that list it and its rank there, so a
text costs the entries of its own n-grams. They go to the tasks in blocks of at most
``BLOCK_LANGUAGES`` languages, about, however many labels there are; with several blocks each
is a pass over the texts that keeps the nearest language so far.

Defined results: a null text or one without a letter is ``und`` with score 0; with
nothing to learn from, every text is ``und``; ties go to the smaller language name;
texts of any length are read whole; repeated rows score equally; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import id_fold, map_batches, stored
from tallygrid.llm.textstats import LETTER, UPPER, classes, code_points

#: N-grams of one to this many characters; three code points fill 63 bits.
LONGEST = 3
#: Length of a profile and of a document's list.
PROFILE = 400
#: Languages whose profiles are held at once; each is ``PROFILE`` entries at most.
BLOCK_LANGUAGES = 10_000
#: Distinct n-grams a task holds before it passes its partial counts on.
HELD = 1_000_000


class Profiles(NamedTuple):
    """The entries (language, rank) of each n-gram, one n-gram after the other."""

    names: list[str]
    grams: np.ndarray  # sorted
    starts: np.ndarray  # first entry of each n-gram, and the end
    langs: np.ndarray
    ranks: np.ndarray


def letters(text: str) -> np.ndarray:
    """Lower-cased letters with single blanks between and around words; empty without a letter."""
    points = code_points(text.lower())
    kind = classes()[points]
    is_letter = (kind == UPPER) | (kind == LETTER)
    if not is_letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate(([32], np.where(is_letter, points, 32), [32])).astype(np.int64)
    blank = points == 32
    return points[~(blank & np.concatenate(([False], blank[:-1])))]


def ngrams(points: np.ndarray) -> np.ndarray:
    """All n-grams of 1 to ``LONGEST`` characters as numbers, the blank alone left out."""
    out, code = [points[points != 32]], points
    for n in range(1, LONGEST):
        code = (code[:-1] << 21) | points[n:]
        out.append(code)
    return np.concatenate(out)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts; tasks add up their own counts first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (grams, counts) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())],
                    ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs.tolist()):
                found: list[np.ndarray] = []
                size = 0
                for k in np.flatnonzero(langs == lang):
                    found.append(ngrams(letters(texts[k])))
                    size += len(found[-1])
                    if size > HELD:
                        _add(held, lang, found)
                        found, size = [], 0
                _add(held, lang, found)
            if sum(len(g) for g, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    return (
        docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )


def _add(held: dict, lang: str, found: list[np.ndarray]) -> None:
    if not found:
        return
    grams, counts = np.unique(np.concatenate(found), return_counts=True)
    if lang in held:
        old, old_counts = held[lang]
        merged, where = np.unique(np.concatenate([old, grams]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([old_counts, counts]), minlength=len(merged)).astype(np.int64)
        grams = merged
    held[lang] = grams, counts


def learn(docs: DataFrame) -> Iterator[Profiles]:
    """Profiles of every language among the labelled documents outside the held-out fold, in blocks.
    With nothing to learn from, one block without languages."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_fold("doc_id", 4) != 2))
    counts = gram_counts(labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    # Counts are dealt by language and n-gram; each task hands on its first PROFILE of a language only.
    top = stored(counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE), "profiles")
    blocks = max(1, math.ceil(top.select("lang").distinct().count() / BLOCK_LANGUAGES))
    for k in range(blocks):
        mine = top.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).select("lang", "gram", "rank").toArrow()
        yield packed(mine["lang"].to_pylist(), mine["gram"].to_numpy(), mine["rank"].to_numpy() - 1)


def packed(langs: list[str], grams: np.ndarray, ranks: np.ndarray) -> Profiles:
    names, lang = np.unique(np.array(langs, dtype=object), return_inverse=True) if langs else (np.zeros(0, object), np.zeros(0, np.int64))
    order = np.lexsort((lang, grams))
    kinds, starts = np.unique(grams[order], return_index=True)
    return Profiles(names.tolist(), kinds.astype(np.int64), np.r_[starts, len(grams)].astype(np.int64),
                    lang[order].astype(np.int32), ranks[order].astype(np.int32))


def similarities(profiles: Profiles, text: str | None) -> np.ndarray | None:
    """1 minus the distance to every profile as a share of the largest possible; None without a letter."""
    points = letters(text) if text else ()
    if not len(points) or not profiles.names:
        return None
    found, counts = np.unique(ngrams(points), return_counts=True)
    found = found[np.argsort(-counts, kind="stable")[:PROFILE]]
    at = np.minimum(np.searchsorted(profiles.grams, found), len(profiles.grams) - 1)
    own = np.flatnonzero(profiles.grams[at] == found)
    start = profiles.starts[at[own]]
    size = profiles.starts[at[own] + 1] - start
    entry = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    # An n-gram that a profile lacks is PROFILE away; one that it has is nearer by this.
    nearer = PROFILE - np.abs(profiles.ranks[entry] - np.repeat(own, size))
    return np.bincount(profiles.langs[entry], nearer, minlength=len(profiles.names)) / (PROFILE * len(found))


def identify(profiles: Profiles, text: str | None) -> tuple[str, float]:
    """The nearest language and its similarity."""
    near = similarities(profiles, text)
    if near is None:
        return "und", 0.0
    best = int(near.argmax())
    return profiles.names[best], float(near[best])


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    def nearest(profiles: Profiles):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            best = list(zip(batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist()))
            for k, text in enumerate(batch.column("text").to_pylist()):
                name, score = identify(profiles, text)
                old, reached = best[k]
                if name != "und" and (old == "und" or (-score, name) < (-reached, old)):
                    best[k] = name, score
            names, scores = zip(*best)
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out", "text")), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "text", "lang_pred", "score"])
        return work
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = "doc_id long, held_out boolean, text string, lang_pred string, score double"
    return over_blocks(out, schema, learn(docs), nearest).drop("text")


def over_blocks(df: DataFrame, schema, blocks: Iterator[Profiles], make) -> DataFrame:
    """``df`` after one pass for each block; passes but the last are written, so that a task holds one block."""
    for k, profiles in enumerate(blocks):
        df = map_batches(stored(df, "languages") if k else df, schema, lambda p=profiles: make(p))
    return df


def reject_unknown(docs: DataFrame, margin: float = 0.05) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a recognised language
    that is not at odds with the row's own label by more than ``margin`` of similarity."""
    def nearest(profiles: Profiles):
        place = {name: k for k, name in enumerate(profiles.names)}

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row = batch.column("row")
            best, own = batch.column("best").to_pylist(), batch.column("own").to_pylist()
            for k, (text, lang) in enumerate(zip(row.field("text").to_pylist(), row.field("lang").to_pylist())):
                near = similarities(profiles, text)
                if near is not None:
                    best[k] = max(float(near.max()), best[k] or 0.0)
                    own[k] = float(near[place[lang]]) if lang in place else own[k]
            return pa.RecordBatch.from_arrays(
                [row, pa.array(best, pa.float64()), pa.array(own, pa.float64())], ["row", "best", "own"])
        return work
    none = F.lit(None).cast("double")
    whole = docs.select(F.struct("*").alias("row"), none.alias("best"), none.alias("own"))
    judged = over_blocks(whole, whole.schema, learn(docs), nearest)
    return judged.where(F.col("best").isNotNull() & (F.col("own").isNull() | (F.col("own") >= F.col("best") - margin))).select("row.*")
