"""Queries cover the whole of their tables."""

from catalog import QUERIES
from catalog.base import retail
from tallygrid.sources import views

SF = "/root/testdata/sf0.001"


def test_scores_of_the_whole_library(spark):
    lib = {(r["source"], r["set_id"]) for r in views.retail_sets(spark, SF).select("source", "set_id").distinct().collect()}
    assert {s for s, _ in lib} == {"brand", "type", "size"}
    whole = {(r["set_id"], r["cell_id"]): r["score"] for r in QUERIES["score_many"](spark, SF).collect()}
    assert len(whole) == len(lib) * retail(spark, SF).cells.count()
    assert {s for s, _ in whole} == {"/".join(x) for x in lib}


def test_wholes_hold_every_source_and_type(spark):
    def distinct(name, *columns):
        return {tuple(r) for r in QUERIES[name](spark, SF).select(*columns).distinct().collect()}
    assert distinct("union_parts", "source") == {("brand",), ("type",), ("size",)}
    types = {(r["type"],) for r in retail(spark, SF).cells.select("type").distinct().collect()}
    assert len(types) > 1 and distinct("read_pseudobulk", "type") == types
    assert QUERIES["cell_axis"](spark, SF).count() == retail(spark, SF).cells.count()


def test_scores_in_many_blocks_equal_one(spark, monkeypatch, make):
    """Blocks of few sets, small pieces of products and of results; sets and cells without values too."""
    from tallygrid.operators import score
    m = make({f"g{k}": [(k * j) % 5 for j in range(30)] for k in range(12)}, [("t", "s", "c")] * 30)
    rows = [(f"s{k % 7}", f"g{(k * 5) % 12}", k) for k in range(20)] + [("lost", "unknown", 1)]
    sets = spark.createDataFrame(rows, "set_id string, gene string, pos int")
    plain = {}
    values = {(g, c): (k * c) % 5 for k, g in enumerate(f"g{k}" for k in range(12)) for c in range(30)}
    weights = score.control_weights(sets, score.expression_bins(score.gene_averages(m), 3), 5).collect()
    for c in range(30):
        for s in {r[0] for r in rows}:
            plain[s, c] = sum(values[w["gene"], c] * w["weight"] for w in weights if w["set_id"] == s)
    for block in (2_000_000, 25):
        monkeypatch.setattr(score, "BLOCK_WEIGHTS", block)
        monkeypatch.setattr(score, "PRODUCTS", block)
        monkeypatch.setattr(score, "RESULTS", block)
        got = {(r["set_id"], r["cell_id"]): r["score"] for r in score.score_many(m, sets, 3, 5).collect()}
        assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-9 for k in got)


def test_every_types_pseudobulk_in_one_export(spark, tmp_path):
    from tallygrid.sources import tables
    pb = spark.createDataFrame(
        [("A", "s1", "t/1", 20, 3.0), ("A", "s2", "t/1", 20, 1.0), ("B", "s1", "t/1", 20, 5.0), ("B", "s1", "u", 20, 7.0),
         ("C", "s3", "u", 5, 9.0)], "gene string, sample string, type string, n_cells int, count double")
    cells = spark.createDataFrame([(1, "s1", "x"), (2, "s2", "y"), (3, "s3", "y")], "cell_id long, sample string, cond string")
    tables.export_pseudobulk(pb, cells, ["x"], ["y"], f"{tmp_path}/out")
    back = spark.read.schema("gene string, column string, count double, type string").csv(f"{tmp_path}/out", sep="\t", header=True)
    assert sorted(map(tuple, back.collect())) == [
        ("A", "s1__x", 3.0, "t/1"), ("A", "s2__y", 1.0, "t/1"), ("B", "s1__x", 5.0, "t/1"), ("B", "s1__x", 7.0, "u"), ("B", "s2__y", 0.0, "t/1")]


def test_queries_of_cells_alone_write_no_matrix(spark, monkeypatch):
    def written(*_):
        raise AssertionError("a matrix was written for its cells")
    monkeypatch.setattr(views, "prepared", written)
    for name in ("split_parts", "union_levels_inferred", "composition_pooled", "export_composition", "type_facets",
                 "cell_axis", "annotated_background"):
        assert QUERIES[name](spark, SF).count() > 0
