"""Language profiles and Order MinHash against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import language_id as li
from tallygrid.llm import order_minhash as om

DOCS = "doc_id long, text string, lang string, rank int, score double"


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = " " + " ".join(letters.split()) + " "
    grams = [letters[k:k + n] for n in (1, 2, 3) for k in range(len(letters) - n + 1)]
    return [g for g in grams if g != " "]


def plain_top(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:li.PROFILE]]


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_profiles_and_distances(spark):
    rnd = random.Random(4)
    words = {"xx": ["lorem", "ipsum", "dolor", "été"], "yy": ["quick", "brown", "foxes", "jump"]}
    rows = [(k, " ".join(rnd.choice(words[lang]) for _ in range(12)), lang, 1, 0.0) for k, lang in enumerate(["xx", "yy"] * 30)]
    docs = spark.createDataFrame(rows, DOCS)
    profiles, = li.learn(docs)
    learned = {r["doc_id"] for r in docs.where(li.id_fold("doc_id", 4) != 2).collect()}
    tops = {}
    for lang in words:
        counts = Counter(g for k, t, name, _, _ in rows if name == lang and k in learned for g in plain_grams(t))
        tops[lang] = plain_top(counts)
        mine = profiles.langs == profiles.names.index(lang)
        listed = np.repeat(profiles.grams, np.diff(profiles.starts))[mine][np.argsort(profiles.ranks[mine])]
        assert listed.tolist() == [code(g) for g in tops[lang]] and sorted(profiles.ranks[mine]) == list(range(len(listed)))
    for _, text, _, _, _ in rows[:6] + [(0, "Ipsum; foxes 12 DOLOR", "", 0, 0)]:
        mine = plain_top(Counter(plain_grams(text)))
        for lang in words:
            place = {g: k for k, g in enumerate(tops[lang])}
            distance = sum(abs(place[g] - k) if g in place else li.PROFILE for k, g in enumerate(mine))
            got = li.similarities(profiles, text)[profiles.names.index(lang)]
            assert abs(got - (1 - distance / (li.PROFILE * len(mine)))) < 1e-12


def test_language_of_awkward_rows(spark):
    rows = [(k, "alpha beta gamma" if k % 2 else "uno dos tres", "en" if k % 2 else "es", 0, 0.0) for k in range(40)]
    rows += [(90, None, None, 0, 0.0), (91, "", "en", 0, 0.0), (92, "12 !! 34", "en", 0, 0.0), (None, "uno dos", None, 0, 0.0),
             (93, "alpha " * 50_000, "en", 0, 0.0), (94, "uno dos tres", "en", 0, 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in li.languages(docs).collect()}
    assert {k for k, r in out.items() if r["lang_pred"] == "und"} == {90, 91, 92}
    assert out[None]["lang_pred"] == "es" and out[93]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in out.values())
    kept = {r["doc_id"] for r in li.reject_unknown(docs).collect()}
    assert kept == set(out) - {90, 91, 92, 94} and li.reject_unknown(docs).columns == docs.columns
    empty = docs.limit(0)
    assert li.languages(empty).count() == 0
    nothing = docs.withColumn("lang", li.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in li.languages(nothing).collect()} == {"und"}


def test_blocks_of_languages_give_the_same(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(k, "".join(rnd.choice("abcdefgh"[k % 5:]) for _ in range(40)), f"l{k % 7}", 0, 0.0) for k in range(140)]
    rows += [(200, None, "l1", 0, 0.0), (201, rows[0][1], "l6", 0, 0.0)]
    docs = spark.createDataFrame(rows, DOCS)
    whole = sorted(map(tuple, li.languages(docs).collect()))
    kept = sorted(map(repr, li.reject_unknown(docs).collect()))
    monkeypatch.setattr(li, "BLOCK_LANGUAGES", 2)
    assert len(list(li.learn(docs))) == 4
    assert sorted(map(tuple, li.languages(docs).collect())) == whole
    assert sorted(map(repr, li.reject_unknown(docs).collect())) == kept and 0 < len(kept) < len(rows)


def test_thirty_thousand_labels(spark):
    """More labels than one block holds; every text is nearest to its own label's profile."""
    text = lambda k: "".join(chr(97 + (k // 26 ** j) % 26) for j in range(4)) * 3
    docs = spark.range(30_000, numPartitions=4).select(
        (F.col("id") * 4).alias("doc_id"), F.concat(*[F.repeat(F.concat(*[
            F.char(97 + (F.floor(F.col("id") / 26 ** j) % 26).cast("int")) for j in range(4)]), 3)]).alias("text"),
        F.format_string("%05d", "id").alias("lang"))
    held_out = docs.where(li.id_fold("doc_id", 4) == 2).count()
    blocks = list(li.learn(docs))
    assert len(blocks) == 3 and sum(len(b.names) for b in blocks) == 30_000 - held_out
    assert all(len(b.ranks) <= len(b.names) * li.PROFILE for b in blocks)
    some = docs.where("doc_id % 3000 = 0").where(li.id_fold("doc_id", 4) != 2).select("text", "lang").collect()
    assert some and all(r["text"] == text(int(r["lang"])) for r in some)
    for r in some:
        best = min(((-s, n) for n, s in (li.identify(b, r["text"]) for b in blocks)))
        own = max(li.similarities(b, r["text"])[b.names.index(r["lang"])] for b in blocks if r["lang"] in b.names)
        assert own == -best[0] == 1


def test_profiles_are_cut_before_they_are_gathered(spark):
    order = li.Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    counts = spark.createDataFrame([("a", 1, 2)], "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    plan = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= li.PROFILE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def plain_print(text, k=om.K, size=om.TUPLE, functions=om.FUNCTIONS):
    if not text:
        return [0] * functions
    kinds, numbered = om.kmers(text, k)
    points = [int(x) >> 32 for x in numbered]
    random_ = np.random.default_rng(7_919)
    factor = random_.integers(0, 1 << 32, functions, dtype=np.uint32) | np.uint32(1)
    shift = random_.integers(0, 1 << 32, functions, dtype=np.uint32)
    out = []
    for a, b in zip(factor.tolist(), shift.tolist()):
        order = sorted(range(len(points)), key=lambda j: ((points[j] * a + b) % (1 << 32), j))[:size]
        total = np.array([len(order)], dtype=np.uint64)
        for j in sorted(order):
            total = om.mix(total * om._STEP + kinds[j:j + 1])
        out.append(int(total[0]) >> 32)
    return out


def test_fingerprints():
    rnd = random.Random(5)
    for n in (0, 1, 3, 8, 9, 50, 3000):
        text = "".join(rnd.choice("ab é😀") for _ in range(n))
        assert om.fingerprint(text).tolist() == plain_print(text)
    kinds, numbered = om.kmers("abcabcabcabcabcabc", 3)
    assert len(set(kinds.tolist())) == 3 and len(set(numbered.tolist())) == len(numbered)
    words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(400)]
    moved = words[200:] + words[:200]
    text, swapped = " ".join(words), " ".join(moved)
    near = om.likeness(om.fingerprint(text), om.fingerprint(text.replace(words[100], "other")))
    assert near > 0.9 and om.likeness(om.fingerprint(text), om.fingerprint(swapped)) < 0.75


def test_ranges_follow_bytes_and_split_one_id(spark, monkeypatch):
    """With few shuffle partitions there are as many ranges as the bytes ask for, also within one id."""
    monkeypatch.setattr(om, "RANGE_BYTES", 400)
    monkeypatch.setattr(om, "PIECE_BYTES", 1 << 20)
    rows = [(7 if k % 3 else k, f"text {k} " * 3, "", 0, 0.0) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    parts = om.with_neighbours(docs).where("guest = 0").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys")).collect()
    assert len(parts) > 10 and max(r["n"] for r in parts) < 100 and sum(r["n"] for r in parts) == 300
    assert sum(r["keys"] == 1 for r in parts) > 5


@pytest.mark.parametrize("size", [16 << 20, 300])
def test_neighbours_by_id(spark, monkeypatch, size):
    monkeypatch.setattr(om, "RANGE_BYTES", size)
    rnd = random.Random(6)
    ids = rnd.sample(range(10 ** 12), 60) + [-5]
    rows = [(i, "".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 40))), None, 0, 0.0) for i in ids]
    rows += [(None, "first of all", None, 0, 0.0), (10 ** 13, None, "en", 1, 0.0), (10 ** 13 + 1, "x" * 70_000, "en", 1, 0.0)]
    rows += [(10 ** 13 + 2, "same", "", 0, 0.0), (10 ** 13 + 2, "same", "", 0, 0.0)]
    out = om.edit_likeness(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r)
    for k, row in enumerate(ordered):
        text, following = row[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        changed = om.edited(text, following)
        want = hashlib.sha256(changed.encode()).hexdigest()
        mine = [r for r in got[row[0]] if r["edited_sha256"] == want]
        assert mine and mine[0]["n_chars"] == len(text) and mine[0]["fingerprint"] == om.written(om.fingerprint(text))
        assert mine[0]["near_next"] == om.likeness(om.fingerprint(text), om.fingerprint(following))
    one = om.edit_likeness(spark.createDataFrame([(1, "alone here", "", 0, 0.0)], DOCS)).collect()
    assert one[0]["near_next"] == 1.0
    assert om.edit_likeness(spark.createDataFrame([], DOCS)).count() == 0
