"""The n-gram join against all pairs, and the pipeline against its parts."""

import random
from itertools import combinations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tallygrid.llm import ngram_join as nj

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, bands string"


def grams(text):
    w = (text or "").split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def corpus():
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, k = [], 0
    for _ in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 20, 120, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            changed = list(words)
            for _ in range(rnd.choice([0, 0, 1, 3])):
                changed[rnd.randrange(len(changed))] = rnd.choice(vocabulary)
            rows.append((k, " ".join(changed)))
            k += 1
    shared = " ".join(rnd.choice(vocabulary) for _ in range(40))
    rows += [(k + j, shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(60))) for j in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (0, rows[0][1]), (2003, "v " * 20_000)] + [(3000 + j, "a b c d e f g") for j in range(50)]
    return [(i, t, "en", "s", 0, 1, "x") for i, t in rows]


def plain(rows):
    sets = [grams(r[1]) for r in rows]
    links, label = [0] * len(rows), list(range(len(rows)))
    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            label[find(b)] = find(a)
    groups: dict = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted((rows[k][0], min(groups[find(k)]), links[k]) for k in range(len(rows)))


def test_join_equals_all_pairs(spark):
    rows = corpus()
    out = nj.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == plain(rows)


@pytest.mark.parametrize("block", [("BLOCK_GRAMS", 500), ("BLOCK_CLASSES", 3)])
def test_blocks_of_large_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(nj, *block)
    rows = corpus()
    out = nj.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == plain(rows)


def test_one_document_of_each_group(spark):
    rows = corpus()
    clashes = {c: F.lit(1) for c in ("row", "kept", "number", "_kept", "a.b")}
    docs = spark.createDataFrame(rows, DOCS).withColumns(clashes)
    kept = nj.one_of_each_group(docs)
    assert kept.columns == docs.columns
    wordless = {2000, 2001, 2002}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in plain(rows)} | wordless)


def test_one_row_of_each_group_whatever_the_ids(spark):
    """Null ids and ids with several texts bring no copy of a kept document back."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [
        (7, a), (None, a), (None, a + " more"),  # a copy and a near copy without an id
        (None, b), (None, b), (None, b + " more"),  # a group without any id
        (5, c), (5, c + " more"),  # near copies under one id
        (3, d), (5, d + " more"),  # a copy of another document under an id that is kept
        (None, ""), (None, ""), (None, None), (9, " "), (9, " "), (9, "")]  # wordless
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x") for i, t in rows], DOCS).repartition(3)
    kept = [(r["doc_id"], (r["text"] or "").split()[:1]) for r in nj.one_of_each_group(docs).collect()]
    assert sorted((i for i, w in kept if w and i is not None)) == [3, 5, 7]
    assert sorted(w[0] for _, w in kept if w) == ["a0", "b0", "c0", "d0"]
    assert sorted(str(i) for i, w in kept if not w) == ["9", "9", "None", "None", "None"]


def test_a_third_of_the_rows_without_ids_and_a_third_with_one(spark):
    """Near copies without ids, and under one id, meet only their own class when full sets are fetched."""
    rnd = random.Random(2)
    base = [f"w{k}" for k in range(200)]

    def near(k):
        words = list(base)
        words[rnd.randrange(200)] = f"x{k}"
        return " ".join(words)
    rows = [(None, near(k)) for k in range(100)] + [(1, near(k)) for k in range(100, 200)] + [(k, near(k)) for k in range(200, 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x") for i, t in rows], DOCS).repartition(3)
    join = nj.Join(docs)
    fetched = nj.full_sets(docs, join.classes.select("first", "node"), nj.WORDS)
    met = [int(n.value()) for n in _row_counts(fetched)]
    assert fetched.count() == join.classes.count() and max(met, default=0) <= len(rows)
    out = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in join.documents().collect()), key=repr)
    sets = [grams(t) for _, t in rows]
    links = [sum(10 * len(a & b) >= 8 * len(a | b) for b in sets) - 1 for a in sets]
    assert out == sorted(((i, 1, n) for (i, _), n in zip(rows, links)), key=repr)


def _row_counts(df):
    """Rows that joins of an executed plan gave."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if "Adaptive" in node.nodeName():
            return walk(node.executedPlan())
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows"))
        below = node.plan() if "QueryStage" in node.nodeName() else None
        if below is not None:
            walk(below)
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
    walk(plan)
    assert found
    return found


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "one two three four five six", "", "", 0, 0, ""), (7, "one two three four five six", "", "", 0, 0, "")]
    out = nj.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r["class_id"], r["n_links"]) for r in out] == [(7, 1), (7, 1)]
    empty = spark.createDataFrame([], DOCS)
    assert nj.near_duplicates(empty).count() == 0 and nj.one_of_each_group(empty).count() == 0


def test_bands_reach_the_recall():
    bands, rows = nj.choose_bands()
    assert bands * rows <= nj.MOST_ROWS and 1 - (1 - nj.SIMILARITY ** rows) ** bands >= nj.RECALL


def test_components_of_a_long_chain(spark):
    rnd = random.Random(1)
    nodes = rnd.sample(range(10 ** 6), 60)
    links = [(*sorted(p), 1.0) for p in zip(nodes[:40], nodes[1:40])] + [(*sorted(p), 1.0) for p in zip(nodes[40:], nodes[41:])]
    out = dict(map(tuple, nj.components(spark.createDataFrame(links, "a long, b long, jaccard double")).collect()))
    assert {out[n] for n in nodes[:40]} == {min(nodes[:40])} and {out[n] for n in nodes[40:]} == {min(nodes[40:])}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "ngram_join", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        if name == "ngram_join":
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(
                {c for _, c, _ in plain([tuple(r) for r in before.select("doc_id", "text").collect()])})
        before = after
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in before.collect()}
