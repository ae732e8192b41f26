"""Module scores, metacells and correlation against plain Python."""

import math
import random

import pytest
import numpy as np
from pyspark.sql import functions as F

from tallygrid.operators import aggregate, axes, correlate, score
from tests.test_special import mulberry, text_hash


@pytest.fixture(scope="module")
def small(make):
    rng = random.Random(2)
    n = 60
    dense = {f"g{i:02d}": [round(rng.random() * (i % 7), 2) if rng.random() < 0.6 else 0.0 for _ in range(n)] for i in range(40)}
    dense["none"] = [0.0] * n
    return make(dense, [("pq"[i % 2], f"s{i % 5}", "AB"[i % 3 == 0]) for i in range(n)]), dense


def plain_score(dense, used, nbin, ctrl):
    genes = list(dense)
    n = len(next(iter(dense.values())))
    f32 = {g: [float(v) for v in col] for g, col in dense.items()}
    avg = {g: sum(f32[g]) / n for g in genes}
    order = sorted(range(len(genes)), key=lambda i: (round(avg[genes[i]], 12), i))
    bins = {}
    for pos, i in enumerate(order):
        bins.setdefault(min(nbin - 1, pos * nbin // len(genes)), []).append(genes[i])
    draw = mulberry(text_hash("|".join(used)))
    control = []
    for g in used:
        pool = [x for x in next(b for b in bins.values() if g in b) if x not in used]
        control += [pool[int(next(draw) * len(pool))] for _ in range(min(ctrl, 4 * len(pool)))] if pool else []
    control = control or [g for g in genes if g not in used]
    return [sum(f32[g][c] for g in used) / len(used) - sum(f32[g][c] for g in control) / len(control) for c in range(n)]


@pytest.mark.parametrize("nbin", [6, 24, 500])
def test_module_scores(spark, small, nbin):
    m, dense = small
    sets = {"A": ["g05", "g01", "g20"], "B": ["g33", "g12"]}
    rows = [(s, g, i) for s, gs in sets.items() for i, g in enumerate(gs)]
    got = {(r["set_id"], r["cell_id"]): r["score"] for r in score.score_many(
        m, spark.createDataFrame(rows, "set_id string, gene string, pos int"), nbin, 25).collect()}
    for s, gs in sets.items():
        for c, want in enumerate(plain_score(dense, gs, min(nbin, len(dense)), 25)):
            assert abs(got[(s, c)] - want) < 1e-5


def plain_pools(cells, k, xy):
    if k <= 1 or len(cells) < 2:
        return [cells]
    wide = [max(xy[c][a] for c in cells) - min(xy[c][a] for c in cells) for a in (0, 1)]
    a = 0 if wide[0] >= wide[1] else 1
    ranked = sorted(cells, key=lambda c: xy[c][a])
    half = k >> 1
    cut = max(1, min(len(ranked) - 1, math.floor(len(ranked) * half / k + 0.5)))
    return plain_pools(ranked[:cut], half, xy) + plain_pools(ranked[cut:], k - half, xy)


def test_metacells_equal_the_recursion(spark):
    rng = random.Random(9)
    # Heavy ties: a third of the cells share one point.
    rows = [(i, "ab"[i % 5 == 0], float(rng.randrange(6)) if i % 3 else 2.0, float(rng.randrange(4)) if i % 3 else 2.0) for i in range(230)]
    rows += [(1000 + i, "rare", 0.0, 0.0) for i in range(7)]
    cells = spark.createDataFrame(rows, "cell_id bigint, type string, x float, y float")
    axis = axes.pool_axis(cells, 14, ["type"])
    got = {r["cell_id"]: r["bucket"] for r in axis.assign.collect()}
    xy = {i: (x, y) for i, _, x, y in rows}
    blocks = []
    for t in "ab":
        mine = [i for i, k, _, _ in rows if k == t]
        share = max(1, min(len(mine) // 10, math.floor(14 * len(mine) / len(rows) + 0.5)))
        blocks += plain_pools(mine, share, xy)
    want = {c: b for b, block in enumerate(blocks) for c in block}
    assert got == want
    assert {r["bucket"]: r["n"] for r in axis.sizes.collect()} == {b: len(x) for b, x in enumerate(blocks)}


def pearson(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(
        sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


def ranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def test_correlation_over_cells_and_groups(small):
    m, dense = small
    got = {r["gene"]: r for r in correlate.correlate(m, axes.cell_axis(m.cells), correlate.seed_profile(m, axes.cell_axis(m.cells), "g05")).collect()}
    for g, col in dense.items():
        hits = sum(v != 0 for v in col)
        if hits < 0.1 * 60:
            assert g not in got
        else:
            assert abs(got[g]["r"] - pearson(dense["g05"], col)) < 1e-6 and abs(got[g]["pct"] - hits / 60) < 1e-12
    axis = axes.group_axis(m.cells, "sample", 3)
    groups = {}
    for r in axis.assign.collect():
        groups.setdefault(r["bucket"], []).append(r["cell_id"])
    mean = {g: [sum(col[c] for c in groups[b]) / len(groups[b]) for b in sorted(groups)] for g, col in dense.items()}
    for method, f in (("pearson", lambda v: v), ("spearman", ranks)):
        seed = correlate.seed_profile(m, axis, "g05")
        for r in correlate.correlate(m, axis, seed, method).collect():
            assert abs(r["r"] - pearson(f(mean["g05"]), f(mean[r["gene"]]))) < 1e-5, (method, r["gene"])


def test_composite_is_the_weighted_mean_of_member_correlations(spark, small):
    m, dense = small
    axis = axes.cell_axis(m.cells)
    shape = spark.createDataFrame([("g05", 1, 0.8), ("g12", -1, 0.5)], "gene string, sign int, weight double")
    seed = {r["bucket"]: r["s"] for r in correlate.composite(m, axis, shape).collect()}

    def unit(v):
        mu = sum(v) / len(v)
        norm = math.sqrt(sum((x - mu) ** 2 for x in v))
        return [(x - mu) / norm for x in v]

    want = unit([0.8 * a - 0.5 * b for a, b in zip(unit(dense["g05"]), unit(dense["g12"]))])
    assert all(abs(seed[c] - w) < 1e-6 for c, w in enumerate(want))


def test_coherence_of_one_programme(spark, make):
    base = [float(i % 7) for i in range(60)]
    m = make({"a": base, "b": [2 * v + 1 for v in base], "c": [10 - v for v in base], "flat": [3.0] * 60},
             [(f"t{i % 7}", "s", "c") for i in range(60)])
    axis = axes.group_axis(m.cells, "cond", 3)
    sets = spark.createDataFrame([("s", g) for g in ("a", "b", "c", "flat")], "set_id string, gene string")
    rows = {r["gene"]: r for r in correlate.set_coherence(m, axis, sets).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["sign"] == rows["b"]["sign"] == -rows["c"]["sign"]
    assert rows["a"]["flipped"] == 1 and abs(rows["a"]["coherence"] - 1) < 1e-9 and abs(rows["a"]["mean_r"] - 1) < 1e-9
    pairs = {(r["gene_a"], r["gene_b"]): r["r"] for r in correlate.within_set(m, axis, sets).collect()}
    assert abs(pairs[("a", "c")] + 1) < 1e-9 and abs(pairs[("a", "a")] - 1) < 1e-9


def test_coherence_and_seeds_of_many_sets_equal_plain_matrices(spark, make, monkeypatch):
    """Sets of one, of equal members, of opposed ones, and one that holds every gene, against numpy's eigenvectors."""
    monkeypatch.setattr(correlate, "POWER_STEPS", 6)
    rng = np.random.default_rng(12)
    genes = {f"g{k:02d}": [float(v) for v in rng.integers(0, 6, 80) * (rng.random(80) < 0.6)] for k in range(24)}
    genes["twin"] = list(genes["g00"])
    genes["anti"] = [6.0 - v for v in genes["g00"]]
    genes["flat"] = [2.0] * 80
    m = make(genes, [(f"t{i % 9}", f"s{i % 2}", f"c{i % 2}") for i in range(80)])
    axis = axes.group_axis(m.cells, "cond", 3)
    groups: dict = {}
    for r in axis.assign.collect():
        groups.setdefault(r["bucket"], []).append(r["cell_id"])
    mean = {g: np.array([np.mean([np.float32(col[c]) for c in groups[b]]) for b in sorted(groups)]) for g, col in genes.items()}
    plan = {"hot": list(genes), "one": ["g03"], "same": ["g00", "twin"], "opposed": ["g00", "anti", "g05"], "none": ["flat"],
            "few": ["g01", "g02", "g04", "g06", "g07"]}
    sets = spark.createDataFrame([(s, g) for s, gs in plan.items() for g in gs] + [("few", "g01")], "set_id string, gene string")
    shape = correlate.set_coherence(m, axis, sets).collect()
    assert {r["set_id"] for r in shape} == set(plan) - {"none"}
    for name in set(plan) - {"none"}:
        mine = {r["gene"]: r for r in shape if r["set_id"] == name}
        kept = sorted(g for g in set(plan[name]) if mean[g].std() > 1e-9)
        assert sorted(mine) == kept
        z = np.array([(mean[g] - mean[g].mean()) / np.linalg.norm(mean[g] - mean[g].mean()) for g in kept])
        load = np.full(len(kept), len(kept) ** -0.5)
        for _ in range(6):
            load = z @ (z.T @ load)
            top = np.linalg.norm(load)
            load /= top
        got = np.array([mine[g]["sign"] * mine[g]["weight"] for g in kept])
        # Of the largest loads, equal but for rounding, one is positive.
        assert got[np.abs(got) > np.abs(got).max() - 1e-6].max() > 0
        load *= np.sign(got @ load)
        assert np.allclose(got, load, atol=1e-6), name
        s = np.sign(load)
        off = s @ z @ z.T @ s - len(kept)
        want = 1.0 if len(kept) == 1 else off / (len(kept) * (len(kept) - 1))
        row = mine[kept[0]]
        assert abs(row["coherence"] - min(1, top / len(kept))) < 1e-6 and abs(row["mean_r"] - want) < 1e-6
        assert row["flipped"] == (load < 0).sum()
    per_cell = axes.cell_axis(m.cells)
    seeds = correlate.composite(m, per_cell, spark.createDataFrame(shape)).collect()
    assert len(seeds) == 80 * (len(plan) - 1)
    for name in ("hot", "one", "opposed"):
        total = np.zeros(80)
        for r in (r for r in shape if r["set_id"] == name):
            col = np.array(genes[r["gene"]])
            if col.std() > 0:
                total += r["sign"] * r["weight"] * (col - col.mean()) / np.linalg.norm(col - col.mean())
        total = (total - total.mean()) / np.linalg.norm(total - total.mean())
        got = np.array([s for _, s in sorted((r["bucket"], r["s"]) for r in seeds if r["set_id"] == name)])
        assert np.allclose(got, total, atol=1e-6)


def test_group_axis_floor(spark):
    plan = [("0", "ctrl", "S1", 40), ("0", "treat", "S2", 30), ("1", "ctrl", "S1", 25), ("1", "treat", "S2", 25),
            ("2", "ctrl", "S1", 20), ("2", "treat", "S2", 4)]
    rows = [(t, c, s) for t, c, s, n in plan for _ in range(n)]
    cells = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cell_id bigint, type string, cond string, sample string")
    sizes = lambda k: [r["n"] for r in axes.group_axis(cells, "cond", k).sizes.orderBy("bucket").collect()]
    assert sizes(10) == [40, 30, 25, 25, 20] and sizes(26) == [40, 30]


def test_pseudobulk_axis(spark):
    counts = {"A": [10, 20, 30, 40, 5, 6], "B": [20, 40, 60, 80, 1, 2], "C": [0, 0, 0, 7, 9, 9]}
    cols = [("S1", "T"), ("S2", "T"), ("S3", "T"), ("S4", "T"), ("S1", "U"), ("S2", "U")]
    pb = spark.createDataFrame([(g, s, t, 12, float(v)) for g, vs in counts.items() for (s, t), v in zip(cols, vs)],
                               "gene string, sample string, type string, n_cells int, count double")
    cells = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate([("S1", "ctrl"), ("S2", "ctrl"), ("S3", "treat"), ("S4", "treat")])],
                                  "cell_id bigint, sample string, cond string")
    values, n = correlate.pseudobulk_values(pb, cells)
    assert n == 6
    seed = values.where(F.col("gene") == "A").select("bucket", F.col("mean").alias("s"))
    total = [sum(counts[g][k] for g in counts) for k in range(6)]
    norm = {g: [math.log1p(v / t * 1e4) for v, t in zip(vs, total)] for g, vs in counts.items()}
    got = {r["gene"]: r["r"] for r in correlate.correlate_dense(values, n, seed).collect()}
    for g in counts:
        assert abs(got[g] - pearson(norm["A"], norm[g])) < 1e-9
    few, k = correlate.pseudobulk_values(pb, cells, ["U"])
    assert k == 2 and correlate.correlate_dense(few, k, seed).count() == 0


def test_dot_grid_is_point_reads(small):
    m, dense = small
    got = {(r["gene"], r["grp"]): r for r in aggregate.dot_grid(m).collect()}
    assert len(got) == len(dense) * 2
    for g, col in dense.items():
        for k, t in enumerate("pq"):
            mine = col[k::2]
            assert abs(got[(g, t)]["mean"] - sum(mine) / len(mine)) < 1e-6
            assert got[(g, t)]["pct"] == sum(v > 0 for v in mine) / len(mine)


def test_seeds_per_cell_are_formed_cell_by_cell(spark, small):
    """No product of a value with a set is shuffled: what a set adds to a cell stays in the cell's task."""
    m, dense = small
    shape = spark.createDataFrame(
        [("a", "g01", 1, 0.6), ("a", "g02", -1, 0.8), ("b", "g01", 1, 1.0), ("flat", "none", 1, 1.0)],
        "set_id string, gene string, sign int, weight double")
    out = correlate.composite(m, axes.cell_axis(m.cells), shape)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    unit = lambda g: (np.array(dense[g], np.float32) - np.mean(np.array(dense[g], np.float32), dtype=float)) / (np.std(np.array(dense[g], float)) * 60 ** 0.5)
    want = {"a": 0.6 * unit("g01") - 0.8 * unit("g02"), "b": unit("g01")}
    want["a"] = want["a"] / (np.std(want["a"]) * 60 ** 0.5)
    got = {(r["set_id"], r["bucket"]): r["s"] for r in out.collect()}
    assert set(got) == {(s, i) for s in want for i in range(60)}
    assert all(abs(got[s, i] - want[s][i]) < 1e-6 for s, i in got)


def test_pseudobulk_values_read_the_counts_once(spark, small):
    """The columns, their totals and the values come from one written table, not from the matrix each time."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    pb = spark.createDataFrame([(g, s, "p", 1, 1.0 + k) for k, (g, s) in enumerate((g, s) for g in "xyz" for s in "123")],
                               "gene string, sample string, type string, n_cells long, count double").mapInArrow(
        seen, "gene string, sample string, type string, n_cells long, count double")
    values, n = correlate.pseudobulk_values(pb, spark.createDataFrame([(1, "1", "A")], "cell_id long, sample string, cond string"))
    assert n == 3 and values.count() == 9 and len(values.collect()) == 9
    assert read.value == 9
