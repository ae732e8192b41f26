"""Exact encoding with a merge-type piece model by backtracking, and decoding.

Merging pieces by score gives the one sequence whose adjacent pieces all survive when
just those two are merged again from single characters. The encoder looks for that
sequence directly: an Aho-Corasick automaton gives the longest piece at every position,
the search takes it if it is compatible with the piece before, tries shorter pieces
otherwise, and steps back from positions that a bitfield marks as failed. Compatible
pairs and encoded words are remembered up to a bound.

Words are independent because no piece holds a blank after another character, and runs of
letters, digits and other characters are, but for the few pieces that mix them, which are
looked up in the model; a text that holds one of those is cut at blanks only. A model whose
pieces span blanks is encoded text by text. Characters without a piece become byte pieces.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows encode equally; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import map_batches, texts
from tallygrid.llm.token_counts import BLANK, processor, splits_at_blanks

#: Words of each of two generations, and pairs of pieces, that one worker remembers.
WORDS, PAIRS = 250_000, 500_000
#: Longer words are not remembered.
LONG_WORD = 48


class PieceModel:
    """The pieces of a model file with what the search needs about them."""

    def __init__(self, path: str):
        import ahocorasick

        model = processor(path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(k) for k in range(size)]
        plain = [k for k in range(size) if not (
            model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.bytes = {int(self.pieces[k][3:5], 16): k for k in range(size) if model.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.unknown = model.unk_id()
        scores = sorted({model.get_score(k) for k in plain}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.ids = {self.pieces[k]: k for k in plain}
        self.rank = {self.pieces[k]: place[model.get_score(k)] for k in plain}
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self.by_word = splits_at_blanks(path)
        self.mixed = [p for p in self.ids if not _RUN.fullmatch(p)]
        # Only pieces that merging can arrive at take part in the search.
        self.reachable = {p for p in self.ids if self.merged(p) == [p]}
        self.longest = ahocorasick.Automaton()
        for p in self.reachable:
            self.longest.add_word(p, p)
        self.longest.make_automaton()
        self.shorter: dict[str, str | None] = {
            p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.reachable), None) for p in self.reachable}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost among equals."""
        parts = list(text)
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def search(self, text: str) -> list[str]:
        """The pieces of a text whose characters all are pieces."""
        n = len(text)
        longest: list[str] = [""] * n
        for end, piece in self.longest.iter(text):
            longest[end - len(piece) + 1] = piece
        failed = bytearray(n // 8 + 1)
        shorter, compatible = self.shorter, self.compatible
        path: list[str] = []
        at, piece = 0, longest[0]
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not path or compatible(path[-1], piece)):
                path.append(piece)
                at = end
                if at < n:
                    piece = longest[at]
                continue
            follow = shorter[piece]
            while follow is None:
                failed[at >> 3] |= 1 << (at & 7)
                if not path:
                    raise ValueError("no sequence of compatible pieces")
                last = path.pop()
                at -= len(last)
                follow = shorter[last]
            piece = follow
        return path

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word; characters without a piece become bytes and part it."""
        if self.alphabet.issuperset(word):
            ids = self.ids
            return [ids[p] for p in self.search(word)]
        out: list[int] = []
        start = 0
        for k in [k for k, c in enumerate(word) if c not in self.alphabet] + [len(word)]:
            if k > start:
                out.extend(self.ids[p] for p in self.search(word[start:k]))
            if k < len(word):
                out.extend(self.bytes.get(b, self.unknown) for b in word[k].encode())
            start = k + 1
        return out

    def split(self, text: str) -> list[str]:
        """The text with its dummy prefix, in words that begin with their blanks."""
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        if not self.by_word:
            return [text]
        return (_WORD if any(p in text for p in self.mixed) else _RUN).findall(text)

    def encode(self, text: str) -> list[int]:
        return [k for word in self.split(text) for k in self.word_ids(word)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces together, blanks back, the dummy prefix off."""
        if self.byte_of.keys().isdisjoint(ids):
            pieces = self.pieces
            text = "".join([pieces[k] for k in ids]).replace(BLANK, " ")
            return text[1:] if text.startswith(" ") else text
        out = bytearray()
        for k in ids:
            byte = self.byte_of.get(k)
            out += self.pieces[k].encode() if byte is None else bytes((byte,))
        text = out.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text

    def entry(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal, decoded text) of one word."""
        ids = self.word_ids(word)
        # A further blank in front stands for the dummy prefix, which decoding takes off.
        return len(ids), ",".join(map(str, ids)), self.decode([self.ids[BLANK], *ids] if self.by_word else ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text)."""
        count, written, decoded = 0, [], []
        words = self.words
        for word in self.split(text):
            known = words.get(word)
            if known is None:
                known = self.older.get(word) or self.entry(word)
                if len(word) <= LONG_WORD:
                    if len(words) >= WORDS:
                        self.older, self.words = words, {}
                        words = self.words
                    words[word] = known
            count += known[0]
            written.append(known[1])
            decoded.append(known[2])
        back = "".join(decoded)
        back = back[1:] if self.by_word else back
        return count, _sha(",".join(written)), _sha(back)


_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_RUN = re.compile(rf"{BLANK}*[^\W\d_]+|{BLANK}*(?:[^\w{BLANK}]|_)+|{BLANK}*\d+|{BLANK}+")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@functools.cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the whole id sequence of every text."""
    def make():
        model = piece_model(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([model.encode(t) for t in texts(batch)], pa.list_(pa.int32()))],
                ["doc_id", "ids"])
        return work
    return map_batches(_source(docs), "doc_id long, ids array<int>", make)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    def make():
        model = piece_model(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            back = [model.decode(row or []) for row in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.string())], ["doc_id", "text"])
        return work
    return map_batches(ids.select("doc_id", "ids"), "doc_id long, text string", make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, digested and decoded in one pass."""
    def make():
        model = piece_model(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [model.digest(t) for t in texts(batch)]
            counts, ids, back = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return work
    return map_batches(_source(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
