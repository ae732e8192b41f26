"""How the sources of a language differ in the words they use, ranked by cells of counts.

Terms with the same counts behave alike, so nothing is evaluated term by term. For a group
(language and source) against its language, terms are grouped into cells (count in the group,
count in the language); the divergence is evaluated once per cell, cells of equal value are
merged, and the cumulative multiplicity of the descending values tells which of them reach the
wanted ranks. Only terms at or above the last such value are written out, in UTF-8 order
within equal values. For two groups the cells are (count in one, count in the other). Cells of
terms that both have are counted from the terms; those with a zero follow from each group's
own counts by inclusion and exclusion:

    sum over all terms of f(a, b) = V f(0, 0) + sum over a's terms of [f(a, 0) - f(0, 0)]
        + sum over b's terms of [f(0, b) - f(0, 0)]
        + sum over common terms of [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)]

Terms are counted in memory per task and handed on as sums, so a source with a third of all
rows shuffles no more than its distinct words per task. Common terms are dealt by their total
count, so equal cells meet in few tasks, where they are merged; a term's pairs of groups exist
only in a bounded block on the way to their cells. All arithmetic is in whole numbers, exact as
long as a language has fewer than 9 * 10^15 words.

Defined results: null texts, languages and sources count as empty strings; a group without
terms has its pairs; a language without kept terms has pairs of value 0 and no terms; equal
values are ordered by UTF-8 bytes; repeated rows count again; texts are read whole; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import stored

#: Documents of its language that a kept term is in, and ranks of terms that are reported.
LEAST_DOCUMENTS, RANKS = 3, 200
#: Distinct terms of a task before it hands on its sums, and pairs in a block.
HELD, PAIRS = 400_000, 1_000_000
#: A-Z lower-cased, ASCII that is no letter blank; bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed per task."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple, Counter] = defaultdict(Counter)
        within: dict[tuple, Counter] = defaultdict(Counter)

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in words.items():
                terms = list(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64()),
                    pa.array(map(within[lang, source].__getitem__, terms), pa.int64())], names)
            words.clear()
            within.clear()

        for batch in batches:
            for lang, source, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "raw"))):
                found = raw.translate(LETTERS).split()
                words[lang, source].update(found)
                within[lang, source].update(set(found))
            if sum(map(len, words.values())) >= HELD:
                yield from sums()
        yield from sums()

    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    source = docs.select(name("lang"), name("source"), name("text").cast("binary").alias("raw"))
    return source.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, groups): the terms in enough documents of their language, with the count in each source."""
    per_group = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return per_group.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"),
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"),
    ).where(F.col("docs") >= least).drop("docs")


def share(count: str, total: str) -> str:
    """SQL of 1 + floor(10^9 (count + 1) / total), three digits at a time so that nothing overflows."""
    first = f"(({count} + 1L) * 1000L)"
    second = f"(({first} % {total}) * 1000L)"
    third = f"(({second} % {total}) * 1000L)"
    return f"(1L + (({first} div {total}) * 1000L + {second} div {total}) * 1000L + {third} div {total})"


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def cells_of_pairs(terms: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): how many terms have the counts ca and cb in the sources a and b, both above zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            groups = batch.column("groups")
            sources = groups.values.field("source").dictionary_encode()
            place, names = sources.indices.to_numpy(), sources.dictionary
            offset = groups.offsets.to_numpy()
            counts, of = np.unique(groups.values.field("n").to_numpy(), return_inverse=True)
            sizes = np.diff(offset)
            for lang in range(len(langs.dictionary)):
                mine = langs.indices.to_numpy() == lang
                for size in np.unique(sizes[mine]).tolist():
                    if size < 2:
                        continue
                    left, right = np.triu_indices(size, 1)
                    starts = offset[:-1][mine & (sizes == size)]
                    step = max(1, PAIRS // len(left))
                    for k in range(0, len(starts), step):
                        at = starts[k:k + step, None]
                        a, b = (at + left).reshape(-1), (at + right).reshape(-1)
                        key = ((place[a].astype(np.int64) * len(names) + place[b]) * len(counts) + of[a]) * len(counts) + of[b]
                        key, m = np.unique(key, return_counts=True)
                        key, cb = np.divmod(key, len(counts))
                        key, ca = np.divmod(key, len(counts))
                        one, other = np.divmod(key, len(names))
                        yield pa.RecordBatch.from_arrays([
                            pa.array([langs.dictionary[lang].as_py()] * len(m), pa.string()), names.take(pa.array(one)),
                            names.take(pa.array(other)), pa.array(counts[ca]), pa.array(counts[cb]), pa.array(m.astype(np.int64))],
                            ["lang", "a", "b", "ca", "cb", "m"])

    dealt = terms.where(F.size("groups") > 1).repartitionByRange("lang", "total", "term").select("lang", "groups")
    cells = dealt.mapInArrow(run, "lang string, a string, b string, ca long, cb long, m long")
    return cells.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def totals(docs: DataFrame, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, d, d_lang, v): every occurring group, the denominators of its and its language's shares, the kept terms."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct()
    of_group = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = terms.groupBy("lang").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("v"))
    some = lambda c: F.coalesce(c, F.lit(0))
    # A language without terms has denominators of 1, which nothing is multiplied with.
    return groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").select(
        "lang", "source", F.greatest(some(F.col("n")) + some(F.col("v")), F.lit(1)).alias("d"),
        F.greatest(some(F.col("total")) + some(F.col("v")), F.lit(1)).alias("d_lang"), some(F.col("v")).alias("v"))


def pair_values(terms: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every source from every other source of its language."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("d").alias("da"), "v")
    other = groups.select("lang", F.col("source").alias("b"), F.col("d").alias("db"))
    zero = {"pa0": F.expr(share("0L", "da")), "pb0": F.expr(share("0L", "db"))}
    both = one.join(other, "lang").where("a != b").withColumns(zero)  # the pairs asked for
    base = both.select("lang", "a", "b", F.expr(f"v * {gap('pa0', 'pb0')}").alias("value"))
    # Counts of one group's terms; their number is that of distinct counts, not of terms.
    margins = rows.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    single = margins.withColumnRenamed("source", "a").join(both, ["lang", "a"]).withColumn("pa", F.expr(share("n", "da")))
    single = single.select("lang", F.explode(F.array(
        F.struct("a", "b", F.expr(f"m * ({gap('pa', 'pb0')} - {gap('pa0', 'pb0')})").alias("value")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.expr(f"m * ({gap('pb0', 'pa')} - {gap('pb0', 'pa0')})").alias("value")),
    )).alias("x")).select("lang", "x.*")
    common = cells_of_pairs(terms).join(both.drop("v"), ["lang", "a", "b"]).withColumns({
        "pa": F.expr(share("ca", "da")), "pb": F.expr(share("cb", "db"))})
    mixed = lambda p, q: f"m * ({gap(f'p{p}', f'p{q}')} - {gap(f'p{p}', f'p{q}0')} - {gap(f'p{p}0', f'p{q}')} + {gap(f'p{p}0', f'p{q}0')})"
    common = common.groupBy("lang", "a", "b").agg(
        F.sum(F.expr(mixed("a", "b"))).alias("ab"), F.sum(F.expr(mixed("b", "a"))).alias("ba"))
    common = common.select("lang", F.explode(F.array(
        F.struct("a", "b", F.col("ab").alias("value")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("value")))).alias("x")).select("lang", "x.*")
    return base.union(single).union(common).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(
        F.sum("value").alias("value"))


def term_values(rows: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms a source uses most above its language, to a rank."""
    shared = lambda df: df.join(groups, ["lang", "source"]).withColumns({
        "p": F.expr(share("n", "d")), "q": F.expr(share("total", "d_lang"))}).where("p > q").withColumn("value", F.expr(gap("p", "q")))
    cells = rows.groupBy("lang", "source", "n", "total").agg(F.count(F.lit(1)).alias("m"))
    merged = shared(cells).groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    # Every value has a term, so only the first so many values can reach the ranks.
    first = merged.withColumn("k", F.row_number().over(falling)).where(F.col("k") <= ranks)
    upto = first.withColumn("before", F.sum("m").over(falling) - F.col("m")).where(F.col("before") < ranks)
    least = upto.groupBy("lang", "source").agg(F.min("value").alias("least"))
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    return shared(rows.join(least, ["lang", "source"])).where("value >= least").withColumn(
        "rank", F.row_number().over(place)).where(F.col("rank") <= ranks).select(
        "lang", "source", F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources and the leading terms of each."""
    terms = stored(kept_terms(docs, least_documents), "divergence_terms")
    rows = terms.select("lang", "term", "total", F.inline("groups"))
    groups = stored(totals(docs, rows, terms), "divergence_groups")
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(terms, rows, groups).withColumn("rank", F.row_number().over(place))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(
        term_values(rows, groups, ranks).withColumn("part", F.lit("term")).select(columns))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, COUNT(*)::HUGEINT AS total FROM w GROUP BY 1, 2 HAVING COUNT(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, COUNT(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, COUNT(*)::HUGEINT AS v, SUM(total)::HUGEINT AS n_lang FROM k GROUP BY 1),
t AS MATERIALIZED (SELECT g.lang, g.source, l.v, l.n_lang, coalesce(s.n_group, 0)::HUGEINT AS n_group
      FROM g LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, SUM(n) AS n_group FROM c GROUP BY ALL) s USING (lang, source)),
full_counts AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (t.n_group + t.v) AS p
  FROM t JOIN k ON k.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, SUM(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
       FROM full_counts a JOIN full_counts b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tv AS (SELECT c.lang, c.source, c.term AS item, 1 + (1000000000 * (c.n + 1)) // (t.n_group + t.v) AS p,
              1 + (1000000000 * (k.total + 1)) // (t.n_lang + t.v) AS q
       FROM c JOIN k USING (lang, term) JOIN t ON t.lang = c.lang AND t.source = c.source),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
       UNION ALL SELECT lang, source, 'term', item, (((p - q) * (p - q)) // q)::BIGINT FROM tv WHERE p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
