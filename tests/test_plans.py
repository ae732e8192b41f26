"""Order-based plans against plain Python, with one group holding a third of all rows."""

import random

from pyspark.sql import functions as F

from tallygrid.operators import ora, ranktest
from tallygrid.operators.setindex import SetIndex
from tallygrid.plans.ordering import Candidate, index_quantiles, numbered, value_bucket
from tallygrid.plans.ordering import step_up as step_up_plan


def skewed(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(5)}"
        value = rng.choice([0.0, 0.0, -1.5, 2.25, rng.gauss(0, 3), rng.expovariate(1)])
        rows.append((group, i * 7919, float(value)))
    return rows


def test_bucket_is_monotone(spark):
    values = sorted([0.0, 1e-30, -1e-30, 1.0, 1.0000001, -2.5, 3e8, -3e8, 0.1, 1e-300])
    out = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert out == sorted(out)


def test_index_quantiles(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, id bigint, v double").withColumn("v", F.col("v").cast("float"))
    got = {r["g"]: r for r in index_quantiles(df, ["g"], "v", {"a": 0.0, "m": 0.5, "q": 0.99, "z": 1.0}).collect()}
    floats = {}
    for r in df.collect():
        floats.setdefault(r["g"], []).append(r["v"])
    for g, vs in floats.items():
        vs.sort()
        n = len(vs)
        for name, f in (("a", 0.0), ("m", 0.5), ("q", 0.99), ("z", 1.0)):
            assert got[g][name] == vs[min(n - 1, int(f * n))]
        assert got[g]["n"] == n


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 2), (0.0, 5), (3.0, 1)], "v float, w int")
    row = index_quantiles(df, [], "v", {"m": 0.5, "u": 0.7, "top": 0.9}, "w").first()
    assert (row["m"], row["u"], row["top"], row["n"]) == (0.0, 1.0, 3.0, 8)


def test_numbered_with_ties(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "g string, id bigint, v double")
    got = {(r["g"], r["id"]): r["pos"] for r in numbered(df, ["g"], "id", "v").collect()}
    groups = {}
    for g, i, v in rows:
        groups.setdefault(g, []).append((v, i))
    for g, vs in groups.items():
        for pos, (_, i) in enumerate(sorted(vs)):
            assert got[(g, i)] == pos
    plain = sorted(i for _, i, _ in rows)
    whole = {r["id"]: r["pos"] for r in numbered(df.drop("v"), [], "id").collect()}
    assert [whole[i] for i in plain] == list(range(len(plain)))


def step_up(ps, m):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, best = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        best = min(best, ps[order[rank - 1]] * m / rank)
        out[order[rank - 1]] = best
    return out


def test_step_up(spark):
    rng = random.Random(5)
    rows = []
    for g in ("hot", "cold"):
        for i in range(600 if g == "hot" else 40):
            p = rng.choice([1.0, 0.5, rng.random() ** 4])
            rows.append((f"{g}{i}", g, p))
    df = spark.createDataFrame(rows, "gene string, grp string, p double").withColumn("nlp", -F.log10("p"))
    extra = spark.createDataFrame([("untested", "hot", None, None)], "gene string, grp string, p double, nlp double")
    df = df.unionByName(extra)
    got = {r["gene"]: r for r in ranktest.adjust(df, ["grp"], 700).collect()}
    for g in ("hot", "cold"):
        mine = [r for r in rows if r[1] == g]
        for r, want in zip(mine, step_up([r[2] for r in mine], 700)):
            assert abs(got[r[0]]["fdr"] - want) < 1e-12
    assert got["untested"]["fdr"] is None and got["untested"]["padj"] is None and got["untested"]["nlp"] is None


def test_bh_fixture_and_log_form(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.5), ("c", 0.03)], "gene string, p double").withColumn("nlp", -F.log10("p"))
    got = {r["gene"]: r for r in ora.bh_both(df, []).collect()}
    for g, want in (("a", 0.03), ("b", 0.5), ("c", 0.045)):
        assert abs(got[g]["padj"] - want) < 1e-12
        assert abs(10 ** -got[g]["nlp_adj"] - want) < 1e-12


def test_step_up_of_several_corrections_at_once(spark):
    """A least and a most in one pass, over many buckets, ties and a group that holds most rows."""
    rng = random.Random(11)
    rows = [(k, "hot" if k % 5 else "cold", rng.choice([0.0, 0.25, rng.random() * 300, rng.random()])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, grp string, v double")
    out = step_up_plan(df, ["grp"], "v", {
        "low": Candidate(lambda rank: F.col("v") + 10 / rank), "high": Candidate(lambda rank: F.col("v") * 2 - rank, most=True)})
    got = {r["id"]: (r["low"], r["high"]) for r in out.collect()}
    for g in ("hot", "cold"):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: -r[2])
        last = {v: max(k + 1 for k, r in enumerate(mine) if r[2] == v) for v in {r[2] for r in mine}}
        low, high = float("inf"), float("-inf")
        for k in range(len(mine) - 1, -1, -1):
            v = mine[k][2]
            low, high = min(low, v + 10 / last[v]), max(high, v * 2 - last[v])
            assert abs(got[mine[k][0]][0] - low) < 1e-9 and abs(got[mine[k][0]][1] - high) < 1e-9


def test_set_index_reads_its_own_buckets(spark, tmp_path):
    lib = spark.createDataFrame(
        [("one", 0, f"S{k % 9}", f"S{k % 9}", f"gene{k}", k) for k in range(200)]
        + [("two", 1, "S1", "S1", "only_here", 1), ("two", 1, "T", "T", "Gene5", 2), ("two", 1, "T", "T", "GENE5", 3)],
        "source string, source_pos int, set_id string, set_name string, gene string, pos int")
    background = spark.createDataFrame([(f"GENE{k}",) for k in range(0, 150)] + [("Only_Here",), ("nowhere",)], "gene string")
    index = SetIndex.build(lib, background, f"{tmp_path}/index")
    assert index.postings.count() == 151 and spark.range(1).select(index.population().alias("v")).first()["v"] == 151
    sizes = {(r["source"], r["set_id"]): r["set_size"] for r in index.sizes.collect()}
    assert sizes["two", "T"] == 1 and sizes["one", "S0"] == 17 and ("two", "S1") not in sizes
    asked = spark.createDataFrame([("GENE5",), ("ONLY_HERE",), ("NOWHERE",)], "u string")
    found = index.find(asked)
    rows = {r["u"]: sorted(s["set_id"] for s in r["sets"]) for r in found.collect()}
    assert rows == {"GENE5": ["S5", "T"], "ONLY_HERE": []}
    read = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in found.inputFiles() if "bucket=" in f}
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert len(read) > 3 and "PartitionFilters: [bucket" in scan
    again = SetIndex(spark, f"{tmp_path}/index")
    assert ora.ora_index(asked.withColumnRenamed("u", "gene"), again, (1, 100)).count() == 2


def test_written_tables_are_removed_on_request(spark):
    from tallygrid.plans import session
    before = list(session._written)
    session._written.clear()
    out = session.cut_lineage(spark.range(5))
    path = session._written[0]
    assert out.count() == 5 and session.clear_written(spark) == 1 and session.clear_written(spark) == 0
    assert not __import__("os").path.exists(path.removeprefix("file:"))
    session._written.extend(before)


def test_a_large_table_starts_shuffles_from_more_partitions(spark, monkeypatch):
    from tallygrid.plans import session

    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    before = {key: spark.conf.get(key, None) for key in (session.START, "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        session.room_for(spark.range(300))
        assert spark.conf.get(session.START, None) == before[session.START]
        session.room_for(spark.range(1001))
        assert spark.conf.get(session.START) == "11"
        session.room_for(spark.range(500))
        assert spark.conf.get(session.START) == "11"
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
