"""Counts over whole texts, for quality rules and the quality classifier."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import Counter

import numpy as np

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

OTHER, UPPER, LETTER, DIGIT, PUNCT, SYMBOL, SPACE = range(7)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    kinds = {"L": LETTER, "N": DIGIT, "P": PUNCT, "S": SYMBOL, "Z": SPACE}
    for point in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(point))
        table[point] = UPPER if category == "Lu" else kinds.get(category[0], OTHER)
    table[9:14] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def repeated_words(words: list) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    pairs = ids[:-1] * len(numbers) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * len(numbers) + ids[2:]
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    hit = times[where] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift:shift + n] |= hit
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    per_class = np.bincount(classes()[code_points(text)], minlength=7)
    blank = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return (
        len(words), len(text) - blank, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), int(per_class[UPPER]), int(per_class[UPPER] + per_class[LETTER]),
    )


FEATURES = (
    "log_chars", "log_words", "mean_word", "std_word", "longest_word", "upper", "digits", "punctuation", "symbols",
    "spaces", "beyond_ascii", "exclamation", "bars", "stars", "distinct_words", "top_word", "dup_lines",
    "words_per_line", "ended_lines", "capitalised", "repeated", "entropy", "kinds", "short_words", "echo",
)


def features(text: str) -> list[float]:
    """One row of document statistics in the order of ``FEATURES``; all zero for a text without a word."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(text), len(words)
    points = code_points(text)
    per_class = np.bincount(classes()[points], minlength=7) / n
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=m)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    ended = sum(line.rstrip()[-1] in ".!?:;\"'”»" for line in lines)
    shares = np.bincount(np.minimum(points, 1023))
    shares = shares[shares > 0] / n
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(sizes.mean()), float(sizes.std()), float(np.log1p(sizes.max())),
        *(float(per_class[k]) for k in (UPPER, DIGIT, PUNCT, SYMBOL, SPACE)), float((points > 127).mean()),
        text.count("!") / m, text.count("|") / m, sum(text.count(c) for c in "*#$%&") / m,
        len(counts) / m, counts.most_common(1)[0][1] / m, 1 - len(set(lines)) / len(lines), m / len(lines),
        ended / len(lines), sum(w[0].isupper() for w in words) / m, repeated_words(words) / m,
        float(-(shares * np.log(shares)).sum()), float(len(shares)), float((sizes <= 3).mean()),
        sum(a == b for a, b in zip(words, words[1:])) / m,
    ]
