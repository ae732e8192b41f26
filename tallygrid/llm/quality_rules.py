"""Quality rules whose limits come from the corpus itself.

Each signal of a document is compared with the distribution of that signal among
the documents of its language and source. Distributions are kept as mergeable
quantile sketches: counts per logarithmic bucket, so that two sketches merge by
adding counts, any quantile is known within a relative error of 1 %, and a group
that holds a third of all rows is pre-aggregated before the shuffle. To a group's
own sketch those of its language and of the corpus are added with the weight of
``PRIOR`` documents each, at every size, so limits move smoothly from the corpus's
to the group's own as a group grows.

A limit lies ``REACH`` times as far beyond the ninth decile as this is from the
median (below the first decile likewise), which is one bucket at least. Shares count events, so a document is
out only if its count exceeds the limit by ``NOISE`` standard deviations of a count
of that size: the allowance depends on the document's length, not on the corpus.

Defined results: a null text counts as empty; null languages and sources are
groups of their own; texts of any length are counted whole; repeated rows give
repeated results; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import map_batches, stored, texts
from tallygrid.llm.textstats import base_counts

#: Ratio between the bounds of neighbouring sketch buckets.
GAMMA = 1.02
#: Distances from the median to a tail decile between that decile and the limit.
REACH = 6.0
#: Standard deviations by which a count may exceed its limit.
NOISE = 4.0
#: Documents that the language's and the corpus's sketches each count for in a group, and units of a document's weight.
PRIOR, UNIT = 20, 10_000

#: signal: (numerator, denominator, a share of events). A signal that is no share has a lower limit too.
SIGNALS = {
    "word_length": ("word_chars", "n_words", False),
    "symbol_share": ("n_symbols", "n_words", True),
    "dup_line_share": ("n_dup_lines", "n_lines", True),
    "repeat_share": ("n_repeat_words", "n_words", True),
    "upper_share": ("n_upper", "n_letters", True),
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [base_counts(t) for t in texts(batch)]
            counts = [pa.array(c, pa.int64()) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + counts, ["doc_id", "lang", "source", *COUNTS])
        return work
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                         F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return map_batches(
        source, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS), make)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(signal: str) -> Column:
    """A signal of one document; 0 where its denominator is 0."""
    top, bottom, _ = SIGNALS[signal]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def bucket(value: Column) -> Column:
    """Sketch bucket of a non-negative value; zero has one of its own."""
    return F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(GAMMA)))).otherwise(F.lit(-1_000_000)).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, n) of the documents that pass the base rules."""
    each = F.explode(F.array(*[
        F.struct(F.lit(s).alias("signal"), bucket(ratio(s)).alias("bucket")) for s in SIGNALS]))
    return (
        counts.where(~base_failed()).select("lang", "source", each.alias("s"))
        .groupBy("lang", "source", "s.signal", "s.bucket").agg(F.count(F.lit(1)).alias("n"))
    )


def merged(fine: DataFrame) -> DataFrame:
    """(lang, source, signal, bucket, weight): each group's sketch with those of its language and the corpus."""
    def scaled(sketch: DataFrame, *keys: str) -> DataFrame:
        # A sketch has some hundred buckets, so a window over it is small.
        total = F.sum("n").over(Window.partitionBy(*keys, "signal"))
        return sketch.withColumn("total", total).select(
            *keys, "signal", "bucket", F.expr(f"({PRIOR * UNIT}L * n) div total").alias("weight"))
    groups = fine.select("lang", "source", "signal").distinct()
    language = scaled(fine.groupBy("lang", "signal", "bucket").agg(F.sum("n").alias("n")), "lang")
    corpus = scaled(fine.groupBy("signal", "bucket").agg(F.sum("n").alias("n")))
    columns = ["lang", "source", "signal", "bucket", "weight"]
    # Sketches have some hundred buckets whatever the tables' size; each group gets its own copy.
    from_language = groups.alias("g").join(
        language.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.signal") == F.col("l.signal"))).select(
        "g.lang", "g.source", "g.signal", "bucket", "weight")
    from_corpus = groups.join(corpus, "signal").select(columns)
    own = fine.withColumn("weight", F.col("n") * UNIT).select(columns)
    return own.union(from_language).union(from_corpus).groupBy("lang", "source", "signal", "bucket").agg(
        F.sum("weight").alias("weight"))


def deciles(sketch: DataFrame) -> DataFrame:
    """(lang, source, signal, q1, q5, q9) read from sketches."""
    group = ["lang", "source", "signal"]
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.when(F.col("bucket") <= -1_000_000, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")))
    placed = (
        sketch.withColumn("cum", F.sum("weight").over(upto))
        .withColumn("total", F.sum("weight").over(Window.partitionBy(*group)))
        .withColumn("value", value)
    )
    return placed.groupBy(*group).agg(*[
        F.min(F.when(10 * F.col("cum") >= k * F.col("total"), F.col("value"))).alias(f"q{k}") for k in (1, 5, 9)])


def limits(sketch: DataFrame) -> DataFrame:
    """One row per group with the lower and upper limit of every signal."""
    q = deciles(sketch)
    # Nearer than one bucket two quantiles cannot be told apart.
    least = (GAMMA - 1) * F.col("q5")
    above, below = F.greatest(F.col("q9") - F.col("q5"), least), F.greatest(F.col("q5") - F.col("q1"), least)
    columns = []
    for s, (_, _, share) in SIGNALS.items():
        mine = F.col("signal") == s
        columns.append(F.max(F.when(mine, F.col("q9") + REACH * above)).alias(f"{s}_max"))
        if not share:
            columns.append(F.max(F.when(mine, F.col("q1") - REACH * below)).alias(f"{s}_min"))
    return q.groupBy("lang", "source").agg(*columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, signals and the verdict ``kept`` of every document."""
    counts = stored(document_counts(docs), "quality_counts")
    fine = stored(sketches(counts), "quality_sketches")
    table = stored(limits(merged(fine)), "quality_limits").withColumnsRenamed({"lang": "l2", "source": "s2"})
    # A row per group: left to adaptive execution, which splits a hot source.
    joined = counts.join(table, F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left")
    good = F.lit(True)
    for s, (top, bottom, share) in SIGNALS.items():
        high = F.col(f"{s}_max")
        if share:
            expected = high * F.col(bottom)
            inside = F.col(top) <= expected + NOISE * F.sqrt(expected + 1)
        else:
            inside = (ratio(s) <= high) & (ratio(s) >= F.col(f"{s}_min"))
        good &= F.coalesce(inside, F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & good).alias("kept"),
        "n_lines", "n_upper", "n_letters")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
w AS MATERIALIZED (
  SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
wc AS (SELECT rid, COUNT(*) AS n_words, SUM(length(word)) AS word_chars FROM w GROUP BY 1),
tri AS (SELECT rid, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w
        WINDOW p AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tri WHERE c IS NOT NULL) WHERE k > 1),
rw AS (SELECT rid, COUNT(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY 1),
ln AS (SELECT rid, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
       FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS MATERIALIZED (
  SELECT d.rid, doc_id, lang, source, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters
  FROM d LEFT JOIN wc USING (rid) LEFT JOIN rw USING (rid) LEFT JOIN ln USING (rid)),
f AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS v1, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS v2,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS v3, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS v4,
    CASE WHEN n_letters > 0 THEN n_upper / n_letters ELSE 0 END AS v5 FROM c),
s AS (SELECT lang, source, unnest([1, 2, 3, 4, 5]) AS sig, unnest([v1, v2, v3, v4, v5]) AS v FROM f WHERE NOT base_failed),
b AS (SELECT lang, source, sig, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / ln(1.02)) AS BIGINT) ELSE -1000000 END AS bucket, COUNT(*) AS n
      FROM s GROUP BY ALL),
bl AS (SELECT *, SUM(n) OVER (PARTITION BY lang, sig) AS total FROM (SELECT lang, sig, bucket, SUM(n) AS n FROM b GROUP BY ALL)),
bc AS (SELECT *, SUM(n) OVER (PARTITION BY sig) AS total FROM (SELECT sig, bucket, SUM(n) AS n FROM b GROUP BY ALL)),
g AS (SELECT DISTINCT lang, source, sig FROM b),
m AS (SELECT lang, source, sig, bucket, SUM(weight) AS weight FROM (
        SELECT lang, source, sig, bucket, n * 10000 AS weight FROM b
        UNION ALL SELECT g.lang, g.source, g.sig, bucket, (200000 * n) // total FROM g JOIN bl ON g.lang IS NOT DISTINCT FROM bl.lang AND g.sig = bl.sig
        UNION ALL SELECT g.lang, g.source, g.sig, bucket, (200000 * n) // total FROM g JOIN bc USING (sig)) GROUP BY ALL),
cm AS (SELECT *, SUM(weight) OVER (PARTITION BY lang, source, sig ORDER BY bucket) AS cum,
              SUM(weight) OVER (PARTITION BY lang, source, sig) AS total,
              CASE WHEN bucket = -1000000 THEN 0.0 ELSE pow(1.02, bucket) END AS val FROM m),
q AS (SELECT lang, source, sig, MIN(CASE WHEN 10 * cum >= total THEN val END) AS q1,
             MIN(CASE WHEN 10 * cum >= 5 * total THEN val END) AS q5, MIN(CASE WHEN 10 * cum >= 9 * total THEN val END) AS q9
      FROM cm GROUP BY ALL),
e AS (SELECT *, q9 + 6.0 * greatest(q9 - q5, (1.02 - 1) * q5) AS up, q1 - 6.0 * greatest(q5 - q1, (1.02 - 1) * q5) AS down FROM q),
lim AS MATERIALIZED (
  SELECT lang, source, MAX(CASE WHEN sig = 1 THEN down END) AS lo1,
         [MAX(CASE WHEN sig = 1 THEN up END), MAX(CASE WHEN sig = 2 THEN up END), MAX(CASE WHEN sig = 3 THEN up END),
          MAX(CASE WHEN sig = 4 THEN up END), MAX(CASE WHEN sig = 5 THEN up END)] AS hi FROM e GROUP BY ALL),
j AS (
  SELECT f.*, lo1, hi, hi[2] * n_words AS e2, hi[3] * n_lines AS e3, hi[4] * n_words AS e4, hi[5] * n_letters AS e5
  FROM f LEFT JOIN lim a ON a.lang IS NOT DISTINCT FROM f.lang AND a.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(
         v1 >= lo1 AND v1 <= hi[1] AND n_symbols <= e2 + 4.0 * sqrt(e2 + 1) AND n_dup_lines <= e3 + 4.0 * sqrt(e3 + 1)
         AND n_repeat_words <= e4 + 4.0 * sqrt(e4 + 1) AND n_upper <= e5 + 4.0 * sqrt(e5 + 1), TRUE) AS kept,
       n_lines, n_upper, n_letters
FROM j
"""
