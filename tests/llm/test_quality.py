"""Quality rules and classifier: counts against plain Python, limits, trees, awkward rows."""

import re
from collections import Counter

import numpy as np
import pytest

from tallygrid.llm import quality_classifier as qc
from tallygrid.llm import quality_rules as qr
from tallygrid.llm.textstats import FEATURES, base_counts, features

DOCS = "doc_id long, text string, lang string, source string, n_words string, score string"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


@pytest.mark.parametrize("text", [
    "", "   ", "a", "a b", "a b c a b c", "x\nx\n\n x\nx\n", "a b c d", "a\x0bb\x0cc\rd\te", "### <b> $5 | 10%", "é " * 40,
    "a a a a a", "one two three four one two three five " * 3,
])
def test_base_counts(text):
    assert base_counts(text)[:5] == plain_counts(text)


def test_rules_cover_awkward_rows(spark):
    clean = " ".join(f"word{k}" for k in range(80))
    rows = [(k, clean + f" tail{k}", "en", "s", "x", "y") for k in range(30)]
    rows += [(100, None, None, None, None, None), (101, "", "en", None, "a", "b"), (None, clean, None, "s", "a", "b"),
             (0, rows[0][1], "en", "s", "x", "y"), (102, " ".join(["#$%&"] * 90), "en", "s", "", ""), (103, "z" * 300_000, "en", "s", "", "")]
    out = {}
    for row in qr.quality_rules(spark.createDataFrame(rows, DOCS)).collect():
        out.setdefault(row["doc_id"], []).append(row)
    assert sum(map(len, out.values())) == len(rows)
    assert len(out[0]) == 2 and all(r["kept"] for r in out[0])
    assert all(out[k][0]["kept"] for k in range(1, 30)) and out[None][0]["kept"]
    assert all(out[k][0]["base_failed"] and not out[k][0]["kept"] for k in (100, 101, 102, 103))
    assert qr.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_limits_follow_the_group(spark):
    """The same share of symbols is common in one language and an outlier in another."""
    def text(k, symbols):
        return " ".join([f"w{k}x{j}" for j in range(60)] + ["#"] * symbols)
    rows = [(k, text(k, 20), "aa", "s", "", "") for k in range(250)]
    rows += [(1000 + k, text(k, 0), "bb", "s", "", "") for k in range(250)] + [(5000, text(5000, 20), "bb", "s", "", "")]
    out = {r["doc_id"]: r["kept"] for r in qr.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not out.pop(5000) and all(out.values())


def test_sketch_deciles_are_close_and_merge(spark):
    """A large group's deciles are its own; a group of one document has nearly those of its language and the corpus."""
    rng = np.random.default_rng(1)
    values = np.round(rng.lognormal(1, 1, 40_000), 3)
    counts = [("l0", "s", 100, int(v * 100), 0, 0, 0, 1, 0, 1) for v in values] + [("l1", None, 100, 5_000_000, 0, 0, 0, 1, 0, 1)]
    df = spark.createDataFrame(counts, "lang string, source string, n_words long, word_chars long, n_symbols long, "
                               "n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long")
    fine = qr.sketches(df)
    assert sum(r["n"] for r in fine.where("signal = 'word_length'").collect()) == len(counts)
    got = {r["lang"]: r for r in qr.deciles(qr.merged(fine)).where("signal = 'word_length'").collect()}
    whole = np.sort([c[3] / 100 for c in counts[:-1]])
    for name, q in (("q1", 0.1), ("q5", 0.5), ("q9", 0.9)):
        exact = whole[int(np.ceil(q * len(whole))) - 1]
        assert exact / qr.GAMMA <= got["l0"][name] * 1.0000001 <= exact * qr.GAMMA ** 2
    # 21 of its 41 documents' weight are the language's one document, itself.
    assert got["l1"]["q9"] >= 50_000 and got["l1"]["q1"] < 10


def test_limits_move_smoothly_with_the_group(spark):
    """From one document to many the ninth decile goes from the corpus's to the group's own, without a jump at a size."""
    base = [("a", "big", 100, 500, 0, 0, 0, 1, 0, 1)] * 900 + [("a", "big", 100, 520, 0, 0, 0, 1, 0, 1)] * 100
    schema = ("lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, n_lines long, n_upper long, n_letters long")
    medians = []
    for size in (1, 30, 60, 400):
        rows = base + [("a", "own", 100, 900, 0, 0, 0, 1, 0, 1)] * size
        own = qr.deciles(qr.merged(qr.sketches(spark.createDataFrame(rows, schema)))).where(
            "signal = 'word_length' AND source = 'own'").first()
        medians.append((own["q1"], own["q5"], own["q9"]))
    q1, q5, q9 = zip(*medians)
    assert q1 == tuple(sorted(q1)) and q5[0] < 5.2 < q5[2] and q9[0] < 5.5 and q9[3] > 8.8 and q1[2] < 5.2 < q1[3]


def test_flattened_trees_equal_nested_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = qc.grow(x, y)
    score = qc.predict(trees, x)

    def walk(t, row):
        node = 0
        for _ in range(qc.DEPTH):
            node = 2 * node + 1 + (row[trees.feature[t, node]] > trees.threshold[t, node])
        return trees.leaf[t, node - (2 ** qc.DEPTH - 1)]
    plain = [1 / (1 + np.exp(-(trees.base + sum(walk(t, row) for t in range(qc.TREES))))) for row in x[:50]]
    assert np.allclose(score[:50], plain)
    assert ((score >= 0.5) == (y == 1)).mean() > 0.97


def test_growth_equals_exhaustive_search(monkeypatch):
    """Trees grown from histograms against a search over every feature and edge, by plain sums."""
    monkeypatch.setattr(qc, "TREES", 3)
    monkeypatch.setattr(qc, "DEPTH", 2)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-3 * x[:, 0] + 2 * (x[:, 1] > 0.4)))).astype(float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    margin = np.full(len(y), np.log(rate / (1 - rate)))
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, qc.BINS)[1:-1]))) for f in range(3)]

    def best_split(rows, grad, hess):
        top, found = 1e-9, None
        for f in range(3):
            for edge in edges[f]:
                left = [k for k in rows if x[k, f] <= edge]
                right = [k for k in rows if x[k, f] > edge]
                hl, hr = hess[left].sum(), hess[right].sum()
                if hl < qc.LEAST_WEIGHT or hr < qc.LEAST_WEIGHT:
                    continue
                gl, gr = grad[left].sum(), grad[right].sum()
                gain = gl ** 2 / (hl + qc.RIDGE) + gr ** 2 / (hr + qc.RIDGE) - (gl + gr) ** 2 / (hl + hr + qc.RIDGE)
                if gain > top + 1e-12:
                    top, found = gain, (left, right)
        return found or (list(rows), [])
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        nodes = [list(range(300))]
        for _ in range(2):
            nodes = [part for rows in nodes for part in best_split(rows, grad, hess)]
        for rows in nodes:
            if rows:
                margin[rows] += qc.RATE * grad[rows].sum() / (hess[rows].sum() + qc.RIDGE)
    assert np.allclose(qc.predict(qc.grow(x, y), x), 1 / (1 + np.exp(-margin)))


def test_sample_is_bounded_by_rows(spark):
    """A labelled id on very many rows counts once; very long texts are read whole."""
    docs = spark.createDataFrame([(k, f"text {k}", "", "", "", "") for k in range(60)] + [(3, f"again {k}", "", "", "", "") for k in range(500)]
                                 + [(5, None, "", "", "", ""), (100, "long " * 60_000, "", "", "", "")], DOCS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(100, 1)] * 3, "doc_id long, quality int")
    x, y = qc.sample(docs, labels)
    wanted = labels.where(qc.id_fold("doc_id", 3) != 1).select("doc_id").distinct().count()
    assert len(x) == len(y) == wanted
    assert len(qc.sample(docs, labels, 10)[0]) == 10
    assert qc.quality_scores(docs, labels).count() == docs.count()


def test_classifier_learns_outside_the_fold_and_scores_all(spark):
    good = [(k, " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(60)) + ".", "en", "s", "", "") for k in range(240)]
    poor = [(1000 + k, " ".join(["BUY!!"] * 40 + [f"N{k}!!"] * 20), "en", "s", "", "") for k in range(240)]
    extra = [(5000, None, None, None, None, None), (None, "a few words", None, None, None, None), (5001, "", "", "", "", "")]
    docs = spark.createDataFrame(good + poor + extra + good[:1], DOCS)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in poor] + [(77_777, 1, 0), (5000, None, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = qc.quality_scores(docs, labels).collect()
    assert len(rows) == 484 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 5000]
    assert len(held) > 100 and np.mean([r["predicted"] == (r["doc_id"] < 1000) for r in held]) > 0.98
    kept = qc.reject_poor(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {r["doc_id"] for r in rows if r["predicted"] and r["doc_id"]}


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", "", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert qc.quality_scores(docs, none).first()["score"] == 0.5
    assert qc.quality_scores(docs.limit(0), none).count() == 0


def test_features_have_names():
    assert len(features("Some words. Here!")) == len(FEATURES) == len(features(""))
