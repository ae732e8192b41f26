"""Queries over module scores, co-expression axes and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORACLES, RETAIL, SETS, VECTORS, r, register, retail, rounded, vectors
from catalog.cells import PSEUDOBULK, placed, pseudobulk, quantile_sql
from catalog.expression import AVERAGES
from tallygrid.operators import axes, correlate, score
from tallygrid.sources import views

BINS = f"""{AVERAGES}, bins AS MATERIALIZED (SELECT gene, pos, bin, pos - MIN(pos) OVER (PARTITION BY bin) AS place,
  COUNT(*) OVER (PARTITION BY bin) AS bin_size FROM (
    SELECT gene, pos, least(23, CAST(floor(pos * 24.0 / (SELECT COUNT(*) FROM ga)) AS BIGINT)) AS bin FROM (
      SELECT gene, row_number() OVER (ORDER BY avg, gene_id) - 1 AS pos FROM ga)))"""


@register("expression_bins", f"{RETAIL}{BINS} SELECT gene, pos, bin FROM bins")
def _(spark, sf):
    out = score.expression_bins(score.gene_averages(retail(spark, sf)))
    return out.select("gene", "pos", F.col("bin").cast("long").alias("bin"))


# Scores in SQL: pools are listed outright, and the generator runs in 128-bit integers.
_M = "4294967296"


def _imul(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % {_M} AS BIGINT)"


SCORES = f"""{BINS}{SETS},
mine AS MATERIALIZED (SELECT source || '/' || set_id AS set_id, gene, pos FROM members),
sz AS (SELECT set_id, COUNT(*) AS size, string_agg(gene, '|' ORDER BY pos) AS names FROM mine GROUP BY 1),
seed AS (SELECT set_id, size, CASE WHEN h >= 2147483648 THEN {_M} - h ELSE h END AS seed FROM (
  SELECT set_id, size, list_reduce(list_transform(string_split(names, ''), lambda c: CAST(unicode(c) AS BIGINT)),
    lambda h, c: (h * 31 + c) & 4294967295, CAST(0 AS BIGINT)) AS h FROM sz)),
pool AS MATERIALIZED (SELECT s.set_id, b.bin, b.gene, row_number() OVER (PARTITION BY s.set_id, b.bin ORDER BY b.pos) - 1 AS slot,
  COUNT(*) OVER (PARTITION BY s.set_id, b.bin) AS n FROM sz s CROSS JOIN bins b
  WHERE (s.set_id, b.gene) NOT IN (SELECT set_id, gene FROM mine)),
pn AS (SELECT DISTINCT set_id, bin, n FROM pool),
dr AS (SELECT m.set_id, b.bin, m.pos, n, least(100, n * 4) AS draws FROM mine m JOIN bins b USING (gene) JOIN pn ON pn.set_id = m.set_id AND pn.bin = b.bin),
dk AS (SELECT *, COALESCE(SUM(draws) OVER (PARTITION BY set_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k0 FROM dr),
k AS (SELECT set_id, bin, n, CAST(k0 AS BIGINT) + i AS k FROM dk, LATERAL (SELECT unnest(range(0, draws)) AS i)),
r0 AS (SELECT k.*, (seed + {_imul('(k + 1)', '1831565813')}) & 4294967295 AS s FROM k JOIN seed USING (set_id)),
r1 AS (SELECT *, {_imul('xor(s, s >> 15)', '(s | 1)')} AS t FROM r0),
r2 AS (SELECT *, xor((t + {_imul('xor(t, t >> 7)', '(t | 61)')}) & 4294967295, t) AS u FROM r1),
r3 AS (SELECT *, xor(u, u >> 14) / 4294967296.0 AS draw FROM r2),
ct AS (SELECT r3.set_id, pool.gene, COUNT(*) AS c FROM r3 JOIN pool ON pool.set_id = r3.set_id AND pool.bin = r3.bin
  AND pool.slot = CAST(floor(CAST(draw AS DOUBLE) * r3.n) AS BIGINT) GROUP BY 1, 2),
w AS MATERIALIZED (SELECT mine.set_id, gene, 1.0 / CAST(size AS DOUBLE) AS weight FROM mine JOIN sz USING (set_id)
  UNION ALL SELECT set_id, gene, -c / CAST(SUM(c) OVER (PARTITION BY set_id) AS DOUBLE) FROM ct),
sc AS MATERIALIZED (SELECT z.set_id, lab.cell_id, COALESCE(score, 0.0) AS score FROM sz z CROSS JOIN lab LEFT JOIN (
  SELECT set_id, cell_id, SUM(CAST(value AS DOUBLE) * weight) AS score FROM expr JOIN w USING (gene) GROUP BY 1, 2) x
  ON x.set_id = z.set_id AND x.cell_id = lab.cell_id)"""


def all_sets(spark, sf):
    """The whole library, sets named by source and id."""
    return views.retail_sets(spark, sf).select(F.concat_ws("/", "source", "set_id").alias("set_id"), "gene", "pos")


def scores(spark, sf):
    return score.score_many(retail(spark, sf), all_sets(spark, sf))


@register("control_weights", f"{RETAIL}{SCORES} SELECT set_id, gene, {r('weight', 9)} AS weight FROM w")
def _(spark, sf):
    out = score.control_weights(all_sets(spark, sf), score.expression_bins(score.gene_averages(retail(spark, sf))))
    return rounded(out, "weight", digits=9)


@register("score_many", f"{RETAIL}{SCORES} SELECT set_id, cell_id, {r('score', 5)} AS score FROM sc")
def _(spark, sf):
    return rounded(scores(spark, sf), "score", digits=5)


@register("module_score", f"{RETAIL}{SCORES} SELECT cell_id, {r('score', 5)} AS score FROM sc WHERE set_id = 'type/TYPE_PROMO'")
def _(spark, sf):
    promo = all_sets(spark, sf).where("set_id = 'type/TYPE_PROMO'").select("gene", "pos")
    return rounded(score.module_score(retail(spark, sf), promo), "score", digits=5)


@register("score_grid", f"{RETAIL}{SCORES} SELECT set_id, type, {r('AVG(score)', 5)} AS mean FROM sc JOIN lab USING (cell_id) GROUP BY 1, 2")
def _(spark, sf):
    return rounded(score.score_grid(scores(spark, sf), views.retail_cells(spark, sf), ["type"]), "mean", digits=5)


MARKS = {"min": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "max": 1.0}


@register("score_summary", f"""{RETAIL}{SCORES}, sl AS (SELECT set_id, type, CAST(score AS FLOAT) AS v FROM sc JOIN lab USING (cell_id)),
q AS ({quantile_sql('sl', 'set_id, type', 'v', MARKS, 5)}), a AS (SELECT set_id, type, AVG(CAST(v AS DOUBLE)) AS mean FROM sl GROUP BY 1, 2)
SELECT set_id, type, n, {', '.join(MARKS)}, {r('mean', 5)} AS mean FROM q JOIN a USING (set_id, type)""")
def _(spark, sf):
    return rounded(score.score_summary(scores(spark, sf), views.retail_cells(spark, sf), ["type"]), *MARKS, "mean", digits=5)


@register("score_clip", f"""{RETAIL}{SCORES}, sl AS (SELECT set_id, CAST(score AS FLOAT) AS v FROM sc),
q AS ({quantile_sql('sl', 'set_id', 'v', {'lo': 0.01, 'hi': 0.99}, 5)}) SELECT set_id, n, lo, hi FROM q""")
def _(spark, sf):
    return rounded(score.score_clip(scores(spark, sf)), "lo", "hi", digits=5)


# ---- axes ----


@register("cell_axis", f"{RETAIL} SELECT cell_id, cell_id AS bucket FROM lab")
def _(spark, sf):
    return axes.cell_axis(views.retail_cells(spark, sf)).assign


AXIS = """, gs AS (SELECT type, cond, COUNT(*) AS n FROM lab GROUP BY 1, 2 HAVING COUNT(*) >= 10),
gx AS MATERIALIZED (SELECT type, cond, n, row_number() OVER (ORDER BY type, cond) - 1 AS bucket FROM gs),
ax AS MATERIALIZED (SELECT cell_id, bucket FROM lab JOIN gx USING (type, cond)),
prof AS MATERIALIZED (SELECT g.gene, gx.bucket, COALESCE(s, 0.0) / gx.n AS mean, COALESCE(hit, 0) AS hit FROM genes g CROSS JOIN gx LEFT JOIN (
  SELECT gene, bucket, SUM(CAST(value AS DOUBLE)) AS s, COUNT(*) AS hit FROM expr JOIN ax USING (cell_id) WHERE value <> 0 GROUP BY 1, 2) p
  ON p.gene = g.gene AND p.bucket = gx.bucket)"""


@register("group_axis", f"{RETAIL}{AXIS} SELECT cell_id, bucket FROM ax")
def _(spark, sf):
    return axes.group_axis(views.retail_cells(spark, sf)).assign.withColumn("bucket", F.col("bucket").cast("long"))


@register("profiles", f"{RETAIL}{AXIS} SELECT gene, bucket, {r('mean')} AS mean, hit FROM prof WHERE hit > 0")
def _(spark, sf):
    m = retail(spark, sf)
    return rounded(correlate.profiles(m, axes.group_axis(m.cells)), "mean").withColumn("bucket", F.col("bucket").cast("long"))


SEED = "Brand#1/SMALL"


def _corr_sql(scope_cells: str, floor: float = 0.1) -> str:
    """Pearson over the completed grid; NULL when flat, absent below the detection floor."""
    return f"""SELECT a.gene, {r('corr(a.mean, s.mean)')} AS r, {r(f'SUM(a.hit) / CAST(({scope_cells}) AS DOUBLE)')} AS pct
FROM prof a JOIN prof s ON s.bucket = a.bucket AND s.gene = '{SEED}' GROUP BY 1 HAVING SUM(a.hit) >= {floor} * ({scope_cells})"""


@register("corr_groups", f"{RETAIL}{AXIS} {_corr_sql('SELECT COUNT(*) FROM ax')}")
def _(spark, sf):
    m = retail(spark, sf)
    axis = axes.group_axis(m.cells)
    return rounded(correlate.correlate(m, axis, correlate.seed_profile(m, axis, SEED)), "r", "pct")


@register("corr_cells", f"""{RETAIL}, prof AS MATERIALIZED (SELECT g.gene, l.cell_id AS bucket, COALESCE(CAST(value AS DOUBLE), 0.0) AS mean,
  CASE WHEN value <> 0 THEN 1 ELSE 0 END AS hit FROM genes g CROSS JOIN lab l LEFT JOIN expr e ON e.gene = g.gene AND e.cell_id = l.cell_id)
{_corr_sql('SELECT COUNT(*) FROM lab')}""")
def _(spark, sf):
    m = retail(spark, sf)
    axis = axes.cell_axis(m.cells)
    return rounded(correlate.correlate(m, axis, correlate.seed_profile(m, axis, SEED)), "r", "pct")


RANKED = """, rk AS (SELECT gene, bucket, hit, rank() OVER (PARTITION BY gene ORDER BY mean) + (COUNT(*) OVER (PARTITION BY gene, mean) - 1) / 2.0 AS mean FROM prof0),
prof AS MATERIALIZED (SELECT * FROM rk)"""


@register("corr_spearman", f"{RETAIL}{AXIS.replace('prof AS', 'prof0 AS')}{RANKED} {_corr_sql('SELECT COUNT(*) FROM ax')}")
def _(spark, sf):
    m = retail(spark, sf)
    axis = axes.group_axis(m.cells)
    seed = correlate.seed_profile(m, axis, SEED)
    return rounded(correlate.correlate(m, axis, seed, "spearman"), "r", "pct")


CELL_PROFILES = """, prof0 AS MATERIALIZED (SELECT g.gene, l.cell_id AS bucket, COALESCE(CAST(value AS DOUBLE), 0.0) AS mean,
  CASE WHEN value <> 0 THEN 1 ELSE 0 END AS hit FROM genes g CROSS JOIN lab l LEFT JOIN expr e ON e.gene = g.gene AND e.cell_id = l.cell_id)"""


@register("corr_spearman_cells", f"{RETAIL}{CELL_PROFILES}{RANKED} {_corr_sql('SELECT COUNT(*) FROM lab')}")
def _(spark, sf):
    """Ranks over every cell: a profile as long as the table."""
    m = retail(spark, sf)
    axis = axes.cell_axis(m.cells)
    return rounded(correlate.correlate(m, axis, correlate.seed_profile(m, axis, SEED), "spearman"), "r", "pct")


@register("corr_spearman_signed", f"""{VECTORS}, gx AS (SELECT type, COUNT(*) AS n, row_number() OVER (ORDER BY type) - 1 AS bucket FROM lab GROUP BY 1 HAVING COUNT(*) >= 10),
ax AS (SELECT cell_id, bucket FROM lab JOIN gx USING (type)),
prof0 AS MATERIALIZED (SELECT gene, bucket, AVG(CAST(value AS DOUBLE)) AS mean, COUNT(*) FILTER (value <> 0) AS hit FROM expr JOIN ax USING (cell_id) GROUP BY 1, 2)
{RANKED} {_corr_sql('SELECT COUNT(*) FROM ax').replace("'" + SEED + "'", '0')}""")
def _(spark, sf):
    m = vectors(spark, sf)
    axis = axes.group_axis(m.cells)
    return rounded(correlate.correlate(m, axis, correlate.seed_profile(m, axis, 0), "spearman"), "r", "pct")


@register("corr_top", f"""{RETAIL}{AXIS}, c AS ({_corr_sql('SELECT COUNT(*) FROM ax')}), o AS (SELECT gene, r, gene = '{SEED}' AS member,
  row_number() OVER (ORDER BY r DESC, gene) AS i, row_number() OVER (ORDER BY r, gene DESC) AS j FROM c WHERE r IS NOT NULL)
SELECT gene, r, member, 'up' AS "end" FROM o WHERE i <= 25 UNION ALL SELECT gene, r, member, 'down' FROM o WHERE j <= 25""")
def _(spark, sf):
    m = retail(spark, sf)
    axis = axes.group_axis(m.cells)
    rows = rounded(correlate.correlate(m, axis, correlate.seed_profile(m, axis, SEED)), "r", "pct")
    return correlate.corr_top(rows, 25, [SEED]).select("gene", "r", "member", "end")


@register("standardise", f"""{RETAIL}{AXIS}, s AS (SELECT bucket, mean FROM prof WHERE gene = '{SEED}')
SELECT bucket, {r('(mean - (SELECT AVG(mean) FROM s)) / ((SELECT stddev_pop(mean) FROM s) * sqrt((SELECT COUNT(*) FROM s)))')} AS s FROM s""")
def _(spark, sf):
    m = retail(spark, sf)
    axis = axes.group_axis(m.cells)
    out = correlate.standardise(correlate.seed_profile(m, axis, SEED))
    return rounded(out, "s").withColumn("bucket", F.col("bucket").cast("long"))


# ---- pseudobulk axis ----

PBN = """, pc AS (SELECT sample, type FROM (SELECT DISTINCT sample, type FROM pb) JOIN (SELECT DISTINCT sample, cond FROM lab) USING (sample)
  WHERE cond IN ('ASIA', 'EUROPE') AND type IN ('BUILDING', 'MACHINERY')),
pk AS MATERIALIZED (SELECT sample, type, row_number() OVER (ORDER BY sample, type) - 1 AS bucket FROM pc),
pt AS (SELECT bucket, SUM(count) AS total FROM pb JOIN pk USING (sample, type) GROUP BY 1),
pv AS MATERIALIZED (SELECT gene, bucket, ln(1 + count / total * 1e4) AS mean, CAST(count > 0 AS BIGINT) AS hit FROM pb JOIN pk USING (sample, type) JOIN pt USING (bucket))"""


def dense(spark, sf):
    return correlate.pseudobulk_values(pseudobulk(spark, sf), views.retail_cells(spark, sf), ["BUILDING", "MACHINERY"], ["ASIA", "EUROPE"])


@register("pb_normalize", f"{RETAIL}{PSEUDOBULK}{PBN} SELECT gene, bucket, {r('mean')} AS mean, hit FROM pv")
def _(spark, sf):
    values, _ = dense(spark, sf)
    return rounded(values, "mean").withColumn("bucket", F.col("bucket").cast("long"))


@register("corr_pseudobulk", f"""{RETAIL}{PSEUDOBULK}{PBN}, pg AS (SELECT g.gene, pk.bucket, COALESCE(mean, 0.0) AS mean, COALESCE(hit, 0) AS hit
  FROM (SELECT DISTINCT gene FROM pv) g CROSS JOIN pk LEFT JOIN pv ON pv.gene = g.gene AND pv.bucket = pk.bucket)
SELECT a.gene, {r('corr(a.mean, s.mean)')} AS r, {r('SUM(a.hit) / CAST(COUNT(*) AS DOUBLE)')} AS pct FROM pg a JOIN pg s
ON s.bucket = a.bucket AND s.gene = '{SEED}' GROUP BY 1 HAVING SUM(a.hit) / CAST(COUNT(*) AS DOUBLE) >= 0.1""")
def _(spark, sf):
    values, n = dense(spark, sf)
    seed = values.where(F.col("gene") == SEED).select("bucket", F.col("mean").alias("s"))
    return rounded(correlate.correlate_dense(values, n, seed), "r", "pct")


@register("corr_pseudobulk_spearman", f"""{RETAIL}{PSEUDOBULK}{PBN}, prof0 AS (SELECT g.gene, pk.bucket, COALESCE(mean, 0.0) AS mean, COALESCE(hit, 0) AS hit
  FROM (SELECT DISTINCT gene FROM pv) g CROSS JOIN pk LEFT JOIN pv ON pv.gene = g.gene AND pv.bucket = pk.bucket){RANKED}
SELECT a.gene, {r('corr(a.mean, s.mean)')} AS r, {r('SUM(a.hit) / CAST(COUNT(*) AS DOUBLE)')} AS pct FROM prof a JOIN prof s
ON s.bucket = a.bucket AND s.gene = '{SEED}' GROUP BY 1 HAVING SUM(a.hit) / CAST(COUNT(*) AS DOUBLE) >= 0.1""")
def _(spark, sf):
    values, n = dense(spark, sf)
    seed = values.where(F.col("gene") == SEED).select("bucket", F.col("mean").alias("s"))
    return rounded(correlate.correlate_dense(values, n, seed, method="spearman"), "r", "pct")


# ---- metacells and sets as seeds ----


def pools(spark, sf, within=("type",)):
    return axes.pool_axis(placed(spark, sf), 64, list(within))


@register("metacells")
def _(spark, sf):
    axis = pools(spark, sf)
    return axis.assign.groupBy("bucket").agg(F.count(F.lit(1)).alias("cells"))


@register("metacells_unconstrained")
def _(spark, sf):
    return axes.pool_axis(vectors(spark, sf).cells, 16).sizes


@register("corr_pooled")
def _(spark, sf):
    m, axis = retail(spark, sf), pools(spark, sf)
    return rounded(correlate.correlate(m, axis, correlate.seed_profile(m, axis, SEED)), "r", "pct")


@register("within_set_corr", f"""{RETAIL}{AXIS}{SETS}, mem AS (SELECT DISTINCT set_id, gene FROM members)
SELECT ma.set_id, a.gene AS gene_a, b.gene AS gene_b, {r('corr(a.mean, b.mean)')} AS r FROM mem ma JOIN mem mb ON mb.set_id = ma.set_id AND ma.gene <= mb.gene
JOIN prof a ON a.gene = ma.gene JOIN prof b ON b.gene = mb.gene AND b.bucket = a.bucket GROUP BY 1, 2, 3""")
def _(spark, sf):
    m = retail(spark, sf)
    lib = views.retail_sets(spark, sf)
    return rounded(correlate.within_set(m, axes.group_axis(m.cells), lib), "r")


@register("set_coherence")
def _(spark, sf):
    m = retail(spark, sf)
    lib = views.retail_sets(spark, sf)
    return rounded(correlate.set_coherence(m, axes.group_axis(m.cells), lib), "weight", "coherence", "mean_r")


@register("composite_seed")
def _(spark, sf):
    """Every set's seed per cell, signs from metacells that no label constrains."""
    m = retail(spark, sf)
    shape = correlate.set_coherence(m, axes.pool_axis(placed(spark, sf), 64), all_sets(spark, sf))
    return rounded(correlate.composite(m, axes.cell_axis(m.cells), shape), "s")
