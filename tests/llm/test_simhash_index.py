"""The Gray-order index and the groups it finds against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tallygrid.llm import simhash_index as si

DOCS = "doc_id long, text string, code long, place long, range int, own boolean, label string"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(codes, distance=2):
    label = {c: c for c in codes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in combinations(codes, 2):
        if (a ^ b).bit_count() <= distance:
            label[find(a)] = find(b)
    return {c: find(c) for c in codes}


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    of = components(sorted(set(prints)))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    return sorted(((i, f"{p:016x}", least.get(of[p])) for (i, _), p in zip(rows, prints)), key=repr)


def texts():
    rnd = random.Random(3)
    words = [f"W{k}é" if k % 7 == 0 else f"w{k}" for k in range(4000)]
    rows, k = [], 0
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 40, 400]))]
        for _ in range(rnd.choice([1, 2, 5])):
            copy = list(base)
            if rnd.random() < 0.6:
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((k, rnd.choice([" ", "\n", "\t "]).join(copy)))
            k += 1
    # \x85 and \xa0 are no blanks here; A-Z alone are lower-cased.
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "A\xa0B c"), (904, "a\xa0b C"), (905, "É x"), (906, "é x"),
                   (None, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (907, "w9 " * 30_000), (0, rows[0][1]), (0, "other text here")]


def test_fingerprints_by_the_plain_rule():
    for _, text in texts():
        assert si.fingerprint((text or "").encode()) == plain_print(text)


def test_groups_equal_all_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, 2, 3, True, "x") for r in rows], DOCS).withColumn("a.b", F.lit(1)).repartition(3)
    out = [tuple(r) for r in si.near_duplicates(docs).collect()]
    assert sorted(out, key=repr) == plain(rows)


@pytest.mark.parametrize("ranges", [1 / 8, 2.0])
def test_links_of_dense_and_scattered_codes(spark, monkeypatch, ranges):
    """A chain, a ball of codes around one, and scattered codes; few ranges and many."""
    monkeypatch.setattr(si, "RANGES", ranges)
    monkeypatch.setattr(si, "BATCH", 64)
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    ball = {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in (rnd.sample(range(64), 3) for _ in range(250))}
    chain, code = set(), rnd.getrandbits(64)
    for k in range(40):
        code ^= 1 << (k * 3 % 64)
        chain.add(code)
    far = {rnd.getrandbits(64) for _ in range(300)}
    pairs = {c ^ 3 << rnd.randrange(63) for c in list(far)[:100]}
    codes = sorted(ball | chain | far | pairs | {0, 1, 7, (1 << 64) - 1})
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    frame = spark.createDataFrame(signed, "code long")
    got = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in si.links(si.ranged(frame)).collect()}
    assert all(a != b and (a ^ b).bit_count() <= 64 for a, b in got)
    label = {c: c for c in codes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in got:
        label[find(a)] = find(b)
    want = components(codes)
    same = lambda of: {frozenset(c for c in codes if of(c) == r) for r in {of(c) for c in codes}}
    assert same(find) == same(want.get)


def test_gray_rank_is_the_place_in_the_sequence(spark):
    rows = [(k, k ^ (k >> 1)) for k in [*range(200), (1 << 62) + 5]]
    ranks = spark.createDataFrame(rows, "k long, code long").select("k", si.gray_rank(F.col("code")).alias("r")).collect()
    assert all(r["r"] + (1 << 63) == r["k"] for r in ranks)


def test_nodes_hold_what_their_children_share():
    """Along every path the nodes' bits are apart and make up the code; a search equals brute force."""
    numbers = sorted(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64).tolist())
    codes = np.array([n ^ (n >> 1) for n in numbers], np.uint64)
    index = si.GrayIndex(codes, codes)
    assert len(index.levels) == 5 and any((own != 0).any() for _, own in index.levels[1:-1])
    for leaf, code in enumerate(codes):
        held = np.uint64(0)
        for up, (pattern, own) in enumerate(reversed(index.levels)):
            node = leaf // si.FAN ** up
            assert held & own[node] == 0 and (pattern[node] ^ code) & own[node] == 0
            held |= own[node]
        assert held == np.uint64(0xFFFFFFFFFFFFFFFF)
    near = codes[::50] ^ np.uint64(9)
    query, leaf = index.search(near, 2)
    want = {(a, b) for a in range(len(near)) for b in range(len(codes)) if np.bitwise_count(near[a] ^ codes[b]) <= 2}
    assert set(zip(query.tolist(), leaf.tolist())) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    out = si.near_duplicates(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0
