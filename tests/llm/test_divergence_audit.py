"""The divergence audit against whole numbers in plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tallygrid.llm import divergence_audit as da

DOCS = "doc_id long, text string, lang string, source string, n long, term string, total long, value long"


def plain(rows, least, ranks):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        docs[lang or ""].update(set(words(text)))
        counts[lang or "", source or ""].update(words(text))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for l, s in counts if l == lang]

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // total for t in kept}
        p = {s: shares(counts[lang, s]) for s in sources}
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:ranks])]
    return sorted(out)


def corpus():
    rnd = random.Random(4)
    words = ["a", "b", "Ab", "é", "É", "ß", "zz", "don't", "x1y", "日本", "\x85q"] + [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(300):
        source = rnd.choice(["hot"] * 6 + ["s1", "s2", "s3", None, ""])
        rows.append((" ".join(rnd.choice(words[: 20 if source == "hot" else None]) for _ in range(rnd.choice([1, 5, 60]))),
                     rnd.choice(["en", "en", "de", None]), source))
    rows += rows[:3] + [(None, "en", "none"), ("", "en", "none"), ("1 2 3", "en", "digits"), ("lonely words here", "xx", "one"),
                        ("lonely", "xx", "two"), (" word" * 20_000, "de", "long"), (None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, 1, "t", 2, 3) for k, r in enumerate(rows)], DOCS).withColumn("a.b", F.lit(1)).repartition(4)


def test_audit_equals_plain(spark):
    rows = corpus()
    assert sorted(map(tuple, da.audit(frame(spark, rows)).collect())) == plain(rows, 3, 200)


def test_ranks_are_cut_within_equal_values(spark, monkeypatch):
    """Few ranks, many ties; and sums handed on after every batch, pairs in tiny blocks."""
    monkeypatch.setattr(da, "HELD", 1)
    monkeypatch.setattr(da, "PAIRS", 3)
    rows = corpus() + [(f"tie{chr(97 + k)}", "fr", s) for k in range(20) for s in ("p", "p", "r")]
    assert sorted(map(tuple, da.audit(frame(spark, rows), ranks=7).collect())) == plain(rows, 3, 7)


def test_shares_of_large_counts(spark):
    rows = [(c, c + d) for c in (0, 7, 10 ** 10, 8 * 10 ** 15) for d in (1, 3, 10 ** 12)]
    out = spark.createDataFrame(rows, "c long, d long").select("c", "d", F.expr(da.share("c", "d")).alias("p")).collect()
    assert all(r["p"] == 1 + 10 ** 9 * (r["c"] + 1) // r["d"] for r in out)


def test_empty_table(spark):
    out = da.audit(spark.createDataFrame([], DOCS))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0
