"""Token counts, piece encoding and packing against the tokenizer libraries and a plain packer."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import packing as pk
from tallygrid.llm import piece_encoding as pe
from tallygrid.llm import token_counts as tc
from tallygrid.llm.common import vocabulary

MODEL, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
DOCS = "doc_id long, text string, length string, piece string"
ALPHABET = list("  abcthe▁\n\t0129é́ñ²³.日本語😀<>s/[INST]xq,;'\"　\x00\x1c|end")


def odd_texts(n, longest, seed):
    rnd = random.Random(seed)
    out = ["", " ", "   ", "<s>a</s>", "<|endoftext|>", "a <|endoftext|> b", "x².y", "▁▁a", "don't  you'll\n 's", "a" * 3000, " " * 500]
    return out + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(longest))) for _ in range(n)]


def test_piece_search_equals_library():
    library, own = tc.processor(MODEL), pe.piece_model(MODEL)
    for text in odd_texts(1500, 60, 1) + odd_texts(5, 20_000, 2):
        ids = library.encode(text)
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids)
        count, written, back = own.digest(text)
        assert (count, written) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert back == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_search_equals_plain_merging():
    own = pe.piece_model(MODEL)
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice("▁abcdeinorst") for _ in range(rnd.randrange(1, 40)))
        assert own.search(text) == own.merged(text)


def test_lengths_with_cuts():
    library = tc.processor(MODEL)
    for text in odd_texts(40, 9000, 4):
        assert "".join(p + " " for p in tc.parts(text, 50))[:-1] == text
        assert tc.lengths(MODEL, [text, "b", text]) == [len(library.encode(x)) for x in (text, "b", text)]


def test_counts_and_digests_of_awkward_rows(spark):
    rows = [(1, None, "", ""), (2, "", "", ""), (3, "same text", "", ""), (3, "same text", "", ""), (None, "x y", "", ""), (4, "ab " * 60_000, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    counts = tc.token_counts(docs, MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in counts) == [(0, 3), (1, 0), (2, 0), (3, 9), (3, 9), (4, 180_000)]
    assert {r["doc_id"] for r in counts if r["over_limit"]} == {4} and {r["n_tokens"] for r in counts if r["n_bytes"] == 0} == {0}
    digests = pe.digests(docs, MODEL).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in digests} == {(r["doc_id"], r["n_tokens"]) for r in counts}
    back = {r["doc_id"]: r["text"] for r in pe.decoded(pe.encoded(docs, MODEL), MODEL).collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    for made in (tc.token_counts(docs.limit(0), MODEL), pe.digests(docs.limit(0), MODEL)):
        assert made.count() == 0


def test_byte_tokens_equal_library():
    for own in (pk.TokenBytes(BYTES), pk.TokenBytes(BYTES, vocabulary("byte_bpe_50k.tiktoken"))):
        for text in odd_texts(800, 80, 5) + ["Word, word. été: x!! don't. ǅ. ²."] * 2:
            ids = own.one(text)
            assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def plain_best_fit(lengths, room):
    open_, bins = [], 0
    for length in sorted(lengths, reverse=True):
        fit = [k for k, left in enumerate(open_) if left >= length]
        if fit:
            open_[min(fit, key=lambda k: open_[k])] -= length
        else:
            open_.append(room - length)
    return sorted(open_)


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    room = rnd.choice([7, 20, 64, 100])
    lengths = [rnd.randint(1, room) if seed % 2 else min(room, 1 + int(rnd.expovariate(0.1))) for _ in range(rnd.choice([1, 50, 700]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    used: dict = {}
    at = {n: 0 for n in counts}
    for length, place, low, each, offset in pk.best_fit(counts, room).tolist():
        assert place == at[length]
        following = [r for r in pk.best_fit(counts, room).tolist() if r[0] == length and r[1] > place]
        end = min((r[1] for r in following), default=counts[length])
        for k in range(place, end):
            b, slot = divmod(k - place, each)
            used.setdefault(low + b, []).append((offset + slot * length, length))
        at[length] = end
    assert sum(len(v) for v in used.values()) == len(lengths)
    for items in used.values():
        end = 0
        for start, length in sorted(items):
            assert start == end
            end += length
        assert end <= room
    assert sorted(room - sum(n for _, n in v) for v in used.values()) == plain_best_fit(lengths, room)


def test_capacities():
    tree = pk.Capacities(100)
    rnd = random.Random(9)
    held = {}
    for _ in range(2000):
        c = rnd.randint(1, 100)
        if held.get(c) and rnd.random() < 0.5:
            held[c] -= 1
            tree.add(c, -1)
        else:
            held[c] = held.get(c, 0) + 1
            tree.add(c, 1)
        least = rnd.randint(1, 100)
        assert tree.tightest(least) == min((k for k, n in held.items() if n and k >= least), default=None)


def test_packing(spark):
    rnd = random.Random(10)
    rows = [(k, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(0, 60))), "", "") for k in range(300)]
    rows += [(1000, None, "", ""), (1001, "long " * 400, "", ""), (5, rows[5][1], "", ""), (None, "no id", "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    out = pk.pack(docs, BYTES, room=64).collect()
    library = pk.TokenBytes(BYTES).tokenizer
    want = sorted((r[0] is None, r[0] or 0, len(ids := library.encode(r[1] or "", add_special_tokens=False).ids) + 1,
                   zlib.crc32(np.array(ids + [0], "<u4").tobytes())) for r in rows if r[0] != 1001)
    one = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["length"], r["ids_crc32"]) for r in out if r["doc_id"] != 1001)
    assert one == want
    cut = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 1001)
    assert [c[2] for c in cut[1:]] == [64] * (len(cut) - 1) and [c[1] for c in cut] == [0, *np.cumsum([c[2] for c in cut])[:-1].tolist()]
    held: dict = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in held.values():
        items.sort()
        assert [s for s, _ in items] == [0, *np.cumsum([n for _, n in items])[:-1].tolist()] and sum(n for _, n in items) <= 64
    assert len(held) == len(plain_best_fit([r["length"] for r in out], 64))
    assert pk.pack(docs.limit(0), BYTES).count() == 0


def test_workers_keep_no_parts_after_a_task(spark):
    """A worker lives on after the packing stage; what it remembered must not stay in its memory."""
    docs = spark.createDataFrame([(k, " ".join(f"word{k}x{j}" for j in range(50))) for k in range(40)], "doc_id long, text string")
    assert pk.pieces(docs, BYTES).count() == 40

    def kept(batches):
        for batch in batches:
            model = pk.token_bytes(BYTES, None)
            yield pa.RecordBatch.from_arrays([pa.array([len(model.known) + len(model.older)], pa.int64())], ["n"])
    assert {row["n"] for row in docs.select("doc_id").mapInArrow(kept, "n long").collect()} == {0}
