"""Sparse rank-sum against the dense definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import aggregate, ranktest
from tallygrid.operators.matrix import Matrix


def dense(a, b):
    both = sorted(a + b)
    n1, n2, n = len(a), len(b), len(a) + len(b)
    rank, ties, i = {}, 0, 0
    while i < n:
        j = i
        while j + 1 < n and both[j + 1] == both[i]:
            j += 1
        rank[both[i]] = (i + j) / 2 + 1
        ties += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    u = sum(rank[v] for v in a) - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = abs((abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var))
    return min(1.0, math.erfc(z / math.sqrt(2)))


def labels(a, b):
    return [("t", "s1", "A")] * len(a) + [("t", "s2", "B")] * len(b)


FREE = ranktest.Gates(0.0, 0.0)


@pytest.fixture(scope="module")
def big(make):
    rng = random.Random(11)
    n = 240
    types = [("x", "y", "z")[i % 3] for i in range(n)]
    rows = {}
    for g in range(12):
        rows[f"g{g}"] = [0.0 if rng.random() < 0.4 else round(rng.gauss(0.3 * (types[i] == "x") * g, 1.2), 1) for i in range(n)]
    rows["flat"] = [0.0] * n
    rows["const"] = [1.0] * n
    return make(rows, [(t, f"s{i % 8}", "AB"[i % 2]) for i, t in enumerate(types)]), rows, types


def test_stored_zeros_and_negatives(make):
    a, b = [0, 0.5, 0, 0, 2.5, 0.5, 0], [0, 1.0, 0, 0.5, 0, 0]
    m = make({"g": a + b}, labels(a, b))
    row = ranktest.wilcoxon(m, None, "B", "A", FREE).first()
    assert abs(row["pct1"] - 3 / 7) < 1e-12 and abs(row["p"] - dense(a, b)) < 1e-12
    rng = random.Random(21)
    a, b = ([round(rng.gauss(m, 2), 1) for _ in range(10)] for m in (0.8, -0.4))
    m = make({"g": a + b}, [("p", "s", "c")] * 10 + [("q", "s", "c")] * 10)
    rows = {r["grp"]: r for r in ranktest.markers(m, gates=FREE).collect()}
    assert abs(rows["p"]["p"] - dense(a, b)) < 1e-12 and abs(rows["q"]["p"] - dense(b, a)) < 1e-12
    assert rows["p"]["lfc"] * rows["q"]["lfc"] < 0


def test_floor_of_three(make):
    for k, tested in ((2, 0), (3, 1)):
        a, b = [1.0, 2.0, 3.0][:k], [0.5, 0, 0]
        m = make({"g": a + b}, labels(a, b))
        assert ranktest.wilcoxon(m, None, "B", "A", FREE).count() == tested


def test_markers_equal_dense_and_one_at_a_time(big):
    m, rows, types = big
    got = {(r["gene"], r["grp"]): r for r in ranktest.markers(m, gates=FREE).collect()}
    for g, col in rows.items():
        if g == "flat":
            assert (g, "x") not in got
            continue
        for t in "xyz":
            a = [v for v, k in zip(col, types) if k == t]
            b = [v for v, k in zip(col, types) if k != t]
            assert abs(got[(g, t)]["p"] - dense(a, b)) < 1e-10, (g, t)
    one = {r["gene"]: r for r in ranktest.markers(m, want=["x"], gates=FREE).collect()}
    for g, r in one.items():
        want = got[(g, "x")]
        assert r["n1"] == want["n1"] and all(abs(r[c] - want[c]) < 1e-12 for c in ("lfc", "p", "padj", "fdr", "nlp"))


def test_a_group_without_the_gene_is_still_compared(make):
    m = make({"g": [1.0, 2.0, 1.5, 3.0, 0, 0, 0, 0]}, [("p", "s", "c")] * 4 + [("q", "s", "c")] * 4)
    rows = {r["grp"]: r for r in ranktest.markers(m).collect()}
    assert rows["q"]["pct1"] == 0 and rows["q"]["lfc"] < 0 and abs(rows["q"]["p"] - rows["p"]["p"]) < 1e-12


def test_wide_gates_keep_the_rows_and_carry_the_untested(big):
    m, _, _ = big
    wide = {r["gene"]: r for r in ranktest.wilcoxon(m, None, "B", "A", ranktest.NO_GATES).collect()}
    tight = {r["gene"]: r for r in ranktest.wilcoxon(m, None, "B", "A", ranktest.Gates(0.1, 0.25)).collect()}
    for g, r in tight.items():
        assert abs(r["lfc"] - wide[g]["lfc"]) < 1e-12  # sums add up in any order
        if r["p"] is None:
            assert abs(r["lfc"]) < 0.25 and r["padj"] is None and r["nlp"] is None
        else:
            assert abs(r["p"] - wide[g]["p"]) < 1e-12


def test_several_levels_and_types_on_a_side(big):
    m, rows, types = big
    got = {r["gene"]: r for r in ranktest.wilcoxon(m, ["x", "y"], ["B"], ["A"], FREE).collect()}
    for g in ("g3", "g7"):
        a = [v for i, (v, t) in enumerate(zip(rows[g], types)) if t != "z" and i % 2 == 0]
        b = [v for i, (v, t) in enumerate(zip(rows[g], types)) if t != "z" and i % 2 == 1]
        assert abs(got[g]["p"] - dense(a, b)) < 1e-10


def test_overlapping_sides_are_refused(big):
    with pytest.raises(ValueError):
        ranktest.wilcoxon(big[0], None, ["A", "B"], ["B"])
    with pytest.raises(ValueError):
        ranktest.wilcoxon(big[0], None, [], ["B"])


def test_reading_the_rows(big):
    de = ranktest.markers(big[0], gates=FREE)
    top = ranktest.top_markers(de, 2).collect()
    assert all(r["lfc"] > 0 and r["padj"] < 0.05 and r["rank"] <= 2 for r in top)
    assert ranktest.table_view(de, "G1").select("gene").distinct().count() == 3
    counts = {r["grp"]: r for r in ranktest.up_down(de).collect()}
    assert counts["x"]["up"] == de.where(ranktest.significant() & (F.col("lfc") > 0) & (F.col("grp") == "x")).count()


def test_every_measured_gene_has_a_row_without_gates(make):
    """Silent genes, and genes of a third condition only, are tested and not found."""
    rng = random.Random(3)
    labels_ = [("t", "s", "ABC"[i % 3]) for i in range(30)]
    rows = {"both": [float(rng.choice([0, 1, 2])) for _ in range(30)], "silent": [0.0] * 30, "third": [float(i % 3 == 2) for i in range(30)]}
    m = make(rows, labels_)
    got = {r["gene"]: r for r in ranktest.wilcoxon(m, None, "A", "B", ranktest.NO_GATES).collect()}
    assert set(got) == set(rows)
    for g in ("silent", "third"):
        assert (got[g]["p"], got[g]["padj"], got[g]["fdr"], got[g]["nlp"], got[g]["lfc"], got[g]["pct1"]) == (1, 1, 1, 0, 0, 0)
    a, b = ([v for v, (_, _, c) in zip(rows["both"], labels_) if c == side] for side in "BA")
    assert abs(got["both"]["p"] - dense(a, b)) < 1e-12
    assert {r["gene"] for r in ranktest.wilcoxon(m, None, "A", "B").collect()} == {"both"}


def test_small_groups_without_the_floor(make):
    m = make({"g": [3.0, 1.0, 0, 2.0, 0, 0, 1.0, 0]}, [("one", "s", "c")] + [("two", "s", "c")] * 2 + [("rest", "s", "c")] * 5)
    assert {r["grp"] for r in ranktest.markers(m, gates=FREE).collect()} == {"rest"}
    got = {r["grp"]: r for r in ranktest.markers(m, gates=FREE, min_cells=1).collect()}
    assert set(got) == {"one", "two", "rest"} and abs(got["one"]["p"] - dense([3.0], [1.0, 0, 2.0, 0, 0, 1.0, 0])) < 1e-12


def test_many_levels(spark):
    """More levels than 16 bits can number."""
    cells = spark.range(70_000).select(
        F.col("id").alias("cell_id"), F.concat(F.lit("t"), F.col("id")).alias("type"), F.lit("s").alias("sample"), F.lit("c").alias("cond"))
    expr = spark.createDataFrame([("g", 5, 2.0)], "gene string, cell_id bigint, value float")
    m = Matrix(expr, cells, spark.createDataFrame([("g", 0)], "gene string, gene_id bigint"))
    rows = ranktest.markers(m, gates=ranktest.Gates(0.1, 0.0), min_cells=1).collect()
    assert [r["grp"] for r in rows] == ["t5"]
    assert aggregate.dot_grid(m).count() == 70_000
