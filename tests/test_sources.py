"""Readers, writers, set files, names, composition, trees and arriving parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import composition, ora, prep, sets, shape
from tallygrid.operators.matrix import Matrix
from tallygrid.plans.session import ensure_checkpoint_dir
from tallygrid.sources import bundle, genesets, levels, tables
from tallygrid.streaming import parts


@pytest.fixture(scope="module")
def split(make, spark):
    rng = random.Random(4)
    dense = {f"G{g}": [float(rng.choice([0, 0, 1, 2, 5, 9])) for _ in range(25)] for g in range(6)}
    m = make(dense, [(rng.choice(["dry", "wet"]), f"s{c // 6}", ("low", "high")[c // 12 % 2]) for c in range(25)])
    cells = m.cells.withColumns({"x": F.col("cell_id").cast("float"), "y": F.lit(rng.random()).cast("float")})
    return Matrix(m.expr, cells, m.genes)


def in_blocks(m, size):
    return bundle.dealt(m, m.cells.withColumn("part", F.floor(F.col("cell_id") / size)))


def test_parts_equal_the_whole(split, spark):
    parts = in_blocks(split, 7)
    assert bundle.violations(parts).count() == 0 and parts.cells.select("part").distinct().count() == 4
    back = bundle.ingest(parts)
    key = ["gene", "cell_id", "value"]
    assert sorted(map(tuple, back.expr.select(*key).collect())) == sorted(map(tuple, split.nonzero().select(*key).collect()))
    labels = ["cell_id", "type", "sample", "cond", "x"]
    assert sorted(map(tuple, back.cells.select(*labels).collect())) == sorted(map(tuple, split.cells.select(*labels).collect()))
    assert [r["gene"] for r in back.genes.orderBy("gene_id").collect()] == [f"G{g}" for g in range(6)]
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/parts-test"
    bundle.split_parts(split, path, 3)
    again = bundle.read_parts(spark, path)
    assert bundle.ingest(again).expr.count() == split.nonzero().count() and bundle.violations(again).count() == 0


def test_damage_is_found(split):
    parts = in_blocks(split, 7)
    short = parts.genes.where("NOT (part = 2 AND gene = 'G0')")
    found = {tuple(r) for r in bundle.violations(parts._replace(genes=short)).collect()}
    has = split.nonzero().where("gene = 'G0' AND cell_id BETWEEN 14 AND 20").count() > 0
    assert found == {(2, "gene list")} | ({(2, "value outside the genes")} if has else set())
    moved = parts.genes.withColumn("pos", F.when(F.col("part") == 3, 5 - F.col("pos")).otherwise(F.col("pos")))
    assert {tuple(r) for r in bundle.violations(parts._replace(genes=moved)).collect()} == {(3, "gene list")}
    cells = parts.cells.where("NOT (part = 1 AND local_id = 0)")
    twice = cells.unionByName(cells.where("part = 0 AND local_id = 1")).withColumn(
        "cond", F.when(F.col("part") < 3, F.col("cond")))
    found = {tuple(r) for r in bundle.violations(parts._replace(cells=twice)).collect()}
    assert found == {(1, "value outside the cells"), (0, "repeated cell"), (3, "cell without a label")}


def test_parts_hold_whole_samples_when_they_can(split):
    whole = bundle.assign_parts(split.cells, 3).groupBy("sample").agg(F.count_distinct("part").alias("n"))
    assert {r["n"] for r in whole.collect()} == {1}
    blocks = bundle.assign_parts(split.cells, 8).orderBy("cell_id").collect()
    assert [r["part"] for r in blocks] == sorted(r["part"] for r in blocks) and len({r["part"] for r in blocks}) == 8


def test_level_union(spark):
    def order(*lists, known=None):
        rows = [(f"p{p}", i, v) for p, vs in enumerate(lists) for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "part string, ord int, level string")
        kn = spark.createDataFrame(list(enumerate(known)), "ord int, level string").select("level", "ord") if known else None
        return [r["level"] for r in levels.union_levels(df, kn).orderBy("ord").collect()]

    assert order("KMP", "LMN", "KL", "NP") == list("KLMNP")
    assert order(["day 12"], ["day 3"], ["day 3.5"]) == ["day 3", "day 3.5", "day 12"]
    assert order(["warm", "cold"], ["cold"], ["warm"]) == ["warm", "cold"]
    assert sorted(order("uv", "vu")) == ["u", "v"]
    assert order("gh", "ij", known=["j", "q", "g"]) == ["j", "g", "h", "i"]


SPELLINGS = [
    '{"North": ["Elm", "Oak"], "South": ["Fig", "Pine"]}', "North\tsome trees\tElm\tOak\nSouth\thttps://trees.example\tFig\tPine\n",
    "North\tElm\tOak\nSouth\tFig\tPine", "North: Elm, Oak\nSouth: Fig; Pine", "North: Elm  Oak\r\n\r\nSouth: Fig,Pine\r\n",
    "North: Ash\nNorth: Elm, Oak, Elm\nSouth: Fig, Pine"]


def test_set_spellings(spark):
    texts = [(f"f{i}", t) for i, t in enumerate(SPELLINGS)] + [("bare", "Elm Oak\nFig")]
    got = {}
    for r in genesets.parse_sets(spark.createDataFrame(texts, "path string, value string")).collect():
        got.setdefault(r["path"], {})[r["set_name"]] = r["genes"]
    assert got.pop("bare") == {"bare": ["Elm", "Oak", "Fig"]}
    for path, found in got.items():
        assert found == {"North": ["Elm", "Oak"], "South": ["Fig", "Pine"]}, path


def test_packed_file_must_match_its_header(spark, tmp_path):
    (tmp_path / "ok.gs").write_text("MSIG1\thuman\tH\tr1\t2\t3\nA\tB\tC\nS1\tOne\t0,2\nS2\tTwo\t1\n")
    rows = genesets.read_packed(spark, str(tmp_path / "ok.gs")).orderBy("set_id", "pos").collect()
    assert [(r["set_id"], r["gene"]) for r in rows] == [("S1", "A"), ("S1", "C"), ("S2", "B")]
    (tmp_path / "bad.gs").write_text("MSIG1\thuman\tH\tr1\t3\t3\nA\tB\tC\nS1\tOne\t0,2\n")
    with pytest.raises(Exception, match="header"):
        genesets.read_packed(spark, str(tmp_path / "bad.gs")).collect()


def members(spark, library):
    rows = [("lib", 0, s, s, g, i) for s, gs in library.items() for i, g in enumerate(gs)]
    return spark.createDataFrame(rows, "source string, source_pos int, set_id string, set_name string, gene string, pos int")


def test_over_representation(spark):
    bg = spark.createDataFrame([(g,) for g in "ABCDEFGHIJ"], "gene string")
    lib = members(spark, {"hit": ["A", "B", "C", "Zed"], "miss": ["H", "I", "J"]})
    query = spark.createDataFrame([("a", 0), ("B", 1), ("C", 2), ("Q", 3)], "gene string, pos int")
    rows = ora.ora(query, lib, bg, (1, 100), overlap=True).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["set_id"], r["set_size"], r["overlap_size"], r["drawn"], r["population"]) == ("hit", 3, 3, 3, 6)
    assert r["fold"] == 2 and abs(r["p"] - 1 / 20) < 1e-12 and sorted(r["overlap"]) == ["B", "C", "a"]


def test_names(spark):
    genes = spark.createDataFrame([(1, "E1", "Sox2"), (2, "E2", "Sox2"), (3, "E3", "Gfap"), (4, "E4", "E4"), (5, "E5", "Sox21")],
                                  "gene_id bigint, id string, alias string")
    named = sets.gene_names(genes)
    assert [r["display"] for r in named.orderBy("gene_id").collect()] == ["Sox2 (E1)", "Sox2 (E2)", "Gfap", "E4", "Sox21"]
    index = named.select("gene_id", F.col("display").alias("gene"), "bare", "other")
    assert [r["gene"] for r in sets.rank_genes(index, "sox2").collect()] == ["Sox2 (E1)", "Sox2 (E2)", "Sox21"]
    words = sets.pasted_words(spark.createDataFrame([("gfap, SOX2  e5\nnope;GFAP",)], "text string"))
    found, missing = sets.resolve(words, index)
    assert [r["gene"] for r in found.orderBy("pos", "gene_id").collect()] == ["Gfap", "Sox2 (E1)", "Sox2 (E2)", "Sox21"]
    assert [r["word"] for r in missing.collect()] == ["nope"]
    for names, want in ((["ENSMUSG0001%d" % i for i in range(12)], ("mouse", "accession")), (["GFAP", "SOX2"], ("human", "symbols")),
                        (["Gfap", "Sox2", "EGFR"], ("mouse", "symbols")), (["1", "2"], ("human", "default"))):
        row = sets.detect_species(spark.createDataFrame([(n,) for n in names], "gene string")).first()
        assert (row["species"], row["decided_by"]) == want
    keys = [r["l"] for r in spark.createDataFrame([("e10.0",), ("e8.5",), ("E9",)], "l string").orderBy(sets.natural_key(F.col("l"))).collect()]
    assert keys == ["e8.5", "E9", "e10.0"]


def test_composition_equals_a_tally(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("tuv"), f"s{i % 6}", "AB"[i % 6 // 3], rng.choice(["x", "y"])) for i in range(200)]
    cells = spark.createDataFrame(rows, "cell_id bigint, type string, sample string, cond string, extra string")
    at = {"type": 1, "sample": 2, "cond": 3, "extra": 4}
    assert composition.fields(cells, ["extra"]) == ["type", "cond", "extra", "sample"]
    for part in at:
        for rows_by in composition.row_axes(composition.fields(cells, ["extra"]), part)[1::3]:
            tally, pools = {}, {}
            for r in rows:
                key = tuple(r[at[f]] for f in rows_by)
                tally[(*key, r[at[part]])] = tally.get((*key, r[at[part]]), 0) + 1
                pools.setdefault(key, set()).add(r[2])
            n = len(rows_by)
            got = {tuple(r[f"row{i}"] for i in range(n)) + (r["part"],): r for r in composition.composition(cells, part, rows_by).collect()}
            assert {k: r["cells"] for k, r in got.items()} == tally
            assert all(r["samples"] == len(pools[k[:n]]) for k, r in got.items())
            flags = composition.composition_flags(cells, part, rows_by).first()
            assert flags["pooled_rows"] == sum(len(p) > 1 for p in pools.values())
            assert flags["refused"] == (part != "sample" and flags["pooled_rows"] > 0)
    assert composition.default_rows(cells, "type") == ["sample"]
    assert composition.export_header("type", ["sample", "cells"]) == ["sample", "cells-2", "type", "cells", "row_total", "samples", "fraction"]


def test_pairs_in_blocks_equal_pairs_at_once(spark, monkeypatch):
    """A column that all rows share splits into blocks, and so does the table of pairs."""
    from tallygrid.plans import pairs
    rng = random.Random(3)
    rows = [(p, f"r{k}", c, float(rng.randrange(1, 9))) for p in ("p", "q") for k in range(13) for c in range(5)
            if c == 0 or rng.random() < 0.5]
    panels = spark.createDataFrame(rows, "panel string, row string, col int, value double")
    whole = {m: sorted(map(tuple, shape.distances(panels, m).collect())) for m in ("correlation", "euclidean")}
    monkeypatch.setattr(pairs, "BLOCK", 4)
    frame = panels.where("panel = 'p'").selectExpr("panel AS grp", "col", "row AS row_a")
    split = pairs.block_joined(frame, frame.withColumnRenamed("row_a", "row_b"), ["grp", "col"])
    assert split.count() == sum(n * n for n in (frame.where(F.col("col") == c).count() for c in range(5)))
    for m, want in whole.items():
        got = sorted(map(tuple, shape.distances(panels, m).collect()))
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))
    plain = {}
    for p, r, c, v in rows:
        plain.setdefault((p, r), [0.0] * 5)[c] = v
    for p, a, b, d in whole["euclidean"]:
        assert abs(d - sum((x - y) ** 2 for x, y in zip(plain[p, a], plain[p, b])) ** 0.5) < 1e-9
    assert len(whole["euclidean"]) == 2 * 13 * 12 // 2


def test_panels_beyond_a_figure_form_no_distances(spark):
    rows = [("wide", f"r{k}", 0, float(k)) for k in range(9)] + [("small", f"r{k}", 0, float(k)) for k in range(3)]
    panels = spark.createDataFrame(rows, "panel string, row string, col int, value double")
    out = shape.cluster_order(panels, "euclidean", most_rows=5).collect()
    assert sorted((r["panel"], r["step"] is None) for r in out) == [("small", False), ("small", False), ("wide", True)]


def test_panel_of_a_frame_reads_its_own_folders(spark, tmp_path, make):
    genes = {f"gene{k}": [float(k + 1)] * 4 for k in range(60)}
    make(genes, [("t", "s", "c")] * 4).write(f"{tmp_path}/m")
    m = Matrix.read(spark, f"{tmp_path}/m")
    assert m.expr.columns == ["gene", "cell_id", "value"] and m.expr.count() == 240
    spark.createDataFrame([("gene3", 1), ("gene7", 1), ("gene9", 0)], "gene string, want int").write.parquet(f"{tmp_path}/asked")
    asked = spark.read.parquet(f"{tmp_path}/asked").where("want = 1")
    for panel in (m.panel(asked), m.panel(["gene3", "gene7"])):
        assert sorted((r["gene"], r["value"]) for r in panel.collect()) == [("gene3", 4.0)] * 4 + [("gene7", 8.0)] * 4
        plan = panel._jdf.queryExecution().executedPlan()
        scans = []

        def walk(node):
            if "Adaptive" in node.nodeName():
                return walk(node.executedPlan())
            if "QueryStage" in node.nodeName():
                return walk(node.plan())
            if "Scan parquet" in node.nodeName():
                scans.append(node)
            for k in range(node.children().size()):
                walk(node.children().apply(k))
        walk(plan)
        files = [s.metrics().apply("numFiles").value() for s in scans if "gene_part" in s.toString()]
        assert files and max(files) == 2
    assert m.panel(asked.where("want > 5")).count() == 0


def test_distances_and_trees(spark):
    def panel(rows):
        return spark.createDataFrame([("p", f"r{i}", j, float(v)) for i, vs in enumerate(rows) for j, v in enumerate(vs)],
                                     "panel string, row string, col int, value double")

    d = {(r["row_a"], r["row_b"]): r["d"] for r in shape.distances(panel([(1, 2, 3), (2, 4, 6), (3, 2, 1), (5, 5, 5)])).collect()}
    assert abs(d[("r0", "r1")]) < 1e-12 and abs(d[("r0", "r2")] - 2) < 1e-12 and d[("r0", "r3")] == 2
    assert shape.distances(panel([(0, 0), (3, 4)]), "euclidean").first()["d"] == 5
    tree = shape.cluster_order(panel([(0,), (1,), (4,), (6,)]), "euclidean").orderBy("step").collect()
    assert [r["height"] for r in tree] == [1, 2, 4.5] and tree[-1]["leaves"] == ["r0", "r1", "r2", "r3"]
    merges = shape.average_linkage(np.array([[0, 1, 1, 10], [1, 0, 1, 20], [1, 1, 0, 30], [10, 20, 30, 0]], dtype=float))
    assert merges[-1][2] == 20 and merges[-1][3][0] == 3
    assert shape.cluster_order(panel([(0,), (1,)]), "euclidean").count() == 0


def test_matrix_kinds(spark):
    def kind(*values):
        return prep.classify(spark.createDataFrame([(float(v),) for v in values], "value double")).first()["kind"]

    assert kind(1, 2, 0, 7) == "counts" and kind(-0.5, 1) == "scaled" and kind(0.6931471805599453, 1.0986122886681098) == "log-counts"
    assert kind(0.5, 1.7) == "lognorm" and kind(0.5, 812.25) == "linear" and kind(0) == "lognorm"


def test_exported_p_values(spark):
    df = spark.createDataFrame([(1e-310,), (1.23456e-7,), (0.5,), (None,)], "p double")
    assert [r["t"] for r in df.select(tables.p_text(F.col("p")).alias("t")).collect()] == ["<1e-308", "1.2346e-7", "5.0000e-1", ""]


def test_parts_that_arrive_add_up_once(spark, split):
    ensure_checkpoint_dir(spark)
    import uuid
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    counts = split.nonzero().withColumnRenamed("value", "count")
    cells = bundle.assign_parts(split.cells, 8)
    for p in range(8):
        prep.pseudobulk(counts, cells.where(F.col("part") == p)).withColumn("part", F.lit(f"p{p}")).select(
            "part", "gene", "sample", "type", F.col("n_cells").cast("long"), F.col("count").cast("double")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if p in (3, 7):
            parts.keep_totals(parts.watch_parts(spark, f"{root}/in"), f"{root}/out", f"{root}/state").awaitTermination(120)
    # One cell has no count at all, and it is a part's only cell of its column: the column list keeps it.
    columns = cells.groupBy("part", "sample", "type").agg(F.count(F.lit(1)).alias("n_cells"))
    got = prep.merge_pseudobulk(parts.read_totals(spark, f"{root}/out"), columns)
    want = prep.pseudobulk(counts, split.cells)
    rows = lambda df: sorted((r["gene"], r["sample"], r["type"], r["n_cells"], round(r["count"], 4)) for r in df.collect())
    assert rows(got) == rows(want)


def test_accessions_settle_the_species_before_names(spark):
    def judged(rows, **more):
        row = sets.detect_species(spark.createDataFrame(rows, "gene string, id string"), **more).collect()[0]
        return row["species"], row["decided_by"], row["support"]

    upper = [(f"ABC{k}", f"ENSMUSG{k}") for k in range(12)]
    assert judged(upper, accession="id") == ("mouse", "accession", 1.0)
    assert judged(upper) == ("human", "symbols", 1.0)
    assert judged(upper[:9], accession="id") == ("human", "symbols", 1.0)  # too few accessions
    turned = [(b, a) for a, b in upper]
    assert judged(turned, accession="id") == ("mouse", "accession", 1.0)
    assert judged([(None, None), ("7", "")], accession="id") == ("human", "default", 0.0)


def test_pseudobulk_is_merged_only_of_like_parts(spark):
    parts = spark.createDataFrame(
        [(0, "g", "s", "t", 2, 5), (1, "g", "s", "t", 3, 1), (1, "h", "s", "t", 3, 4)],
        "part int, gene string, sample string, type string, n_cells long, count long")
    genes = [(p, g) for p in (0, 1) for g in "gh"]

    def merged(genes):
        listed = spark.createDataFrame(genes, "part int, gene string")
        return sorted(map(tuple, prep.merge_pseudobulk(parts, part_genes=listed).collect()))

    assert merged(genes) == [("g", "s", "t", 5, 6), ("h", "s", "t", 5, 4)]
    assert merged(genes[:-1]) == []  # a part without the second gene
    assert merged(genes + [(2, "g"), (2, "h")]) == []  # a part without a table
    assert merged(genes + [(0, "x")]) == []


def test_carried_columns_have_two_levels(spark):
    cells = spark.createDataFrame([("a", None, "x"), ("b", "y", "x"), ("c", "y", "x")], "many string, gap string, one string")
    out = prep.carried_columns(cells, ["many", "gap", "one"])
    assert sorted(map(tuple, out.collect())) == [("gap", 2), ("many", 3)]
    assert [r["column"] for r in prep.carried_columns(cells, ["many", "gap", "one"], 2).collect()] == ["gap"]


def test_json_sets_in_all_shapes(spark):
    """Objects of lists and of records, lists of records; order, repeats, numbers, nulls and what is no set."""
    texts = [
        ("lists", '{"B": ["x", "y", "x"], "A": ["z", 7, null, {"q": 1}, ["n"]], "C": "no", "D": [], "B": ["last"]}'),
        ("records", ' {"one": {"about": 1, "Genes": ["a", "b"]}, "two": {"members": "no"}, "three": {"IDS": ["c"]}, "!!": ["k"]}'),
        ("array", '[{"Pathway": "P", "symbols": ["a"]}, {"genes": ["b", " c "]}, 5, "s", {"name": "none"}, {"id": 9, "list": ["\'d\'"]}]'),
        ("text", "Name: g, h"), ("broken", '{"A": [1, 2')]
    rows = spark.createDataFrame(texts, "path string, value string")
    got = {(r["path"], r["set_name"]): r["genes"] for r in genesets.parse_sets(rows).collect()}
    assert got == {
        ("lists", "B"): ["last"], ("lists", "A"): ["z", "7"], ("records", "one"): ["a", "b"], ("records", "three"): ["c"],
        ("array", "P"): ["a"], ("array", "set 2"): ["b", "c"], ("array", "9"): ["d"], ("text", "Name"): ["g", "h"]}


def test_plans_share_one_scan_and_parts_merge(spark, make):
    """Four statistics from one aggregation; partials of two parts of the cells give the same."""
    from tallygrid.operators import aggregate as ag
    dense = {"a": [1.0, 0, 2.0, 0, 4.0, 0], "b": [0, 0, -1.0, 0, 0, 3.0], "c": [2.0] * 6}
    m = make(dense, [("t", "s", "c")] * 6)
    plans = [ag.AVERAGE, ag.DETECTION, ag.DEVIATION, ag.LARGEST]
    out = ag.run_plans(m, plans)
    got = {r["gene"]: tuple(r)[1:] for r in out.collect()}
    for g, col in dense.items():
        want = (np.mean(col), np.mean(np.array(col) > 0), np.std(col), max(v for v in col if v))
        assert np.allclose(got[g], want)
    plan = ag.gene_partials(m.expr, plans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1
    halves = [ag.gene_partials(m.expr.where(F.col("cell_id") % 2 == k), plans) for k in (0, 1)]
    merged = ag.finish_plans(ag.merge_partials(halves[0].unionByName(halves[1]), plans), plans, F.lit(6))
    assert all(np.allclose(tuple(r)[1:], got[r["gene"]]) for r in merged.collect())


def test_name_index_gives_what_a_full_scan_gives(spark, tmp_path):
    """Short and long words, several of them, names without a third character, nulls and repeats; few folders are read."""
    from tallygrid.operators.nameindex import FOLDERS, NameIndex
    rng = random.Random(4)
    rows = [("".join(rng.choice("abAB1é ") for _ in range(rng.randrange(1, 9))), k) for k in range(300)]
    rows += [("Sox2", 900), ("sox21", 901), ("Sox9", 902), ("", 903), (None, 904), ("Sox2", 900)]
    names = spark.createDataFrame(rows, "gene string, id int").withColumn("other", F.concat(F.lit("acc"), "id"))
    index = NameIndex.build(names, [F.col("gene"), F.col("other")], f"{tmp_path}/names")
    for words in (["SOX2"], ["sox"], ["a"], ["ab", "1"], ["acc90"], ["éa"], ["nowhere"], ["b1a"]):
        low = [(i, " ".join((g or "", f"acc{i}")).lower(), (g or "").lower(), f"acc{i}") for g, i in set(rows)]
        want = {i for i, _, g, o in low if all(w.lower() in g or w.lower() in o for w in words)}
        got = index.candidates(words)
        verified = {r["id"] for r in got.collect() if all(w.lower() in (r["gene"] or "").lower() or w.lower() in r["other"] for w in words)}
        assert verified == want, words
        assert got.count() == got.distinct().count()
    assert index.candidates([]).count() == 0
    top = sets.rank_genes(index.candidates(["sox2"]).select("gene"), "sox2").collect()
    assert [(r["gene"], r["band"]) for r in top] == [("Sox2", 0), ("sox21", 1)]
    plan = index.candidates(["sox2"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(part" in plan and FOLDERS == 16


def test_a_name_that_many_share_and_many_ask_for(spark):
    """Words and genes that share one name meet once per gene, not as often as their product."""
    n = 3000
    genes = spark.range(n).select(F.col("id").alias("gene_id"), F.concat(F.lit("g"), "id").alias("gene"), F.lit("ring").alias("bare"))
    words = spark.range(n).select((F.col("id") + 7).alias("pos"), F.lit(" Ring").alias("word"))
    found, missing = sets.resolve(words, genes)
    rows = found.collect()
    assert len(rows) == n and {r["pos"] for r in rows} == {7} and missing.count() == 0
    assert joined_rows(spark, found) <= 2 * n


def joined_rows(spark, df):
    """Most rows that any join of an executed plan gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            node = node.executedPlan()
        if "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


def test_numbers_are_printed_from_their_exact_value(spark):
    values = [0.5625, 0.0625, 0.12345, 0.00015, 2.5, -0.5625, 1e-7, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        tables._fixed("v", 3).alias("three"), tables._fixed("v", 4).alias("four"), tables.exponential(F.col("v")).alias("e")).collect()
    assert [tuple(r)[:2] for r in got] == [("", "") if v is None else (f"{v:.3f}", f"{v:.4f}") for v in values]
    assert got[0]["three"] == "0.562" and got[6]["e"] == "1.0000e-7" and got[7]["e"] is None


def test_words_are_counted_in_their_rows(spark, tmp_path):
    """Empty, missing and repeated words; ids on several rows meet by a shuffle and count alike."""
    from tallygrid.sources import views
    docs = [(1, "b a, B! a a", "en", "s"), (2, "", "en", "s"), (3, None, "de", "s"), (4, "...", "de", "t"), (5, "a", "de", "t")]
    for name, more in (("one", []), ("two", [(5, "A c", "de", "t")])):
        path = str(tmp_path / name)
        spark.createDataFrame(docs + more, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
        got = {(r["gene"], r["cell_id"]): r["count"] for r in views.text_counts(spark, path).collect()}
        want = {("a", 1): 3, ("b", 1): 2, ("a", 5): 1} if not more else {("a", 1): 3, ("b", 1): 2, ("a", 5): 2, ("c", 5): 1}
        assert got == want
        assert (views.text_rows(spark, path) is None) == bool(more)
    m = views.text(spark, str(tmp_path / "one"))
    labels = m.cells.select("cell_id", F.col("type").alias("grp"))
    columns = ["gene", "cell_id", "grp", "value"]
    assert sorted(map(tuple, m.labelled(labels).select(columns).collect())) == sorted(
        map(tuple, m.nonzero().join(labels, "cell_id").select(columns).collect()))
    assert "Exchange" not in m.expr._jdf.queryExecution().executedPlan().toString()
