"""Special functions as Column expressions: normal tails, log-gamma, hypergeometric tail, seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HALF_LN_2PI = 0.5 * math.log(2 * math.pi)
_LN10 = math.log(10.0)
_LN2 = math.log(2.0)

# Terms of the two expansions below; both are converged to double precision.
_FRACTION_TERMS = 80
_SERIES_TERMS = 40


def _fraction_ln_tail(x: Column) -> Column:
    """ln of the upper normal tail by Laplace's continued fraction; meant for x >= 2."""
    steps = F.sequence(F.lit(_FRACTION_TERMS), F.lit(1), F.lit(-1))
    f = F.aggregate(steps, F.lit(0.0), lambda acc, k: k / (x + acc))
    return -x * x / 2 - _HALF_LN_2PI - F.ln(x + f)


def _series_tail(x: Column) -> Column:
    """Upper normal tail by the power series of the central area; meant for x < 2."""
    steps = F.sequence(F.lit(_SERIES_TERMS), F.lit(1), F.lit(-1))
    area = F.aggregate(steps, F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * x * x / (2 * k + 1))
    return F.lit(0.5) - x * area * F.exp(-x * x / 2 - _HALF_LN_2PI)


def ln_normal_tail(z: Column) -> Column:
    """ln P(Z > |z|); never underflows."""
    x = F.abs(z)
    return F.when(x >= 2, _fraction_ln_tail(x)).otherwise(F.ln(_series_tail(x)))


def normal_tail(z: Column) -> Column:
    """P(Z > |z|), floored at the smallest positive double."""
    x = F.abs(z)
    return F.when(x >= 2, F.greatest(F.exp(_fraction_ln_tail(x)), F.lit(5e-324))).otherwise(_series_tail(x))


def two_sided(df: DataFrame, z: str) -> DataFrame:
    """Adds ``p`` and ``nlp`` (-log10 of it) of a z statistic; the tail is evaluated once, in log space.

    NULL z stays NULL. nlp keeps separating values whose p has reached the smallest double.
    """
    ln_p = F.col("_ln_tail") + _LN2
    p = F.least(F.lit(1.0), F.greatest(F.exp(ln_p), F.lit(5e-324)))
    known = F.col("_ln_tail").isNotNull()
    return df.withColumn("_ln_tail", ln_normal_tail(F.col(z))).withColumns({
        "p": F.when(known, p), "nlp": F.when(known, F.greatest(F.lit(0.0), -ln_p / _LN10))}).drop("_ln_tail")


def ln_gamma(x: Column) -> Column:
    """lnGamma for x >= 1: the argument is lifted by eight, then Stirling's series applies."""
    lifted = x + 8
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    inv = F.lit(1.0) / lifted
    sq = inv * inv
    series = inv * (F.lit(1 / 12) - sq * (F.lit(1 / 360) - sq * (F.lit(1 / 1260) - sq * (
        F.lit(1 / 1680) - sq * (F.lit(1 / 1188) - sq * F.lit(691 / 360360))))))
    return (lifted - 0.5) * F.ln(lifted) - lifted + _HALF_LN_2PI + series - F.ln(product)


def ln_choose(n: Column, k: Column) -> Column:
    """ln C(n, k); NULL outside 0 <= k <= n, i.e. a term that is not there."""
    n, k = n.cast("double"), k.cast("double")
    return F.when((k >= 0) & (k <= n), ln_gamma(n + 1) - ln_gamma(k + 1) - ln_gamma(n - k + 1))


def ln_hypergeom_tail(k: Column, set_size: Column, drawn: Column, population: Column) -> Column:
    """ln P(X >= k): the first term in log space, the rest as ratios folded from the far end.

    At most ``set_size`` cheap steps. A fold that overflows means the tail is one.
    NULL when the tail is empty.
    """
    k, set_size, drawn, population = (c.cast("long") for c in (k, set_size, drawn, population))
    first = F.greatest(k, drawn - (population - set_size))
    last = F.least(set_size, drawn)
    steps = F.when(first < last, F.sequence(last - 1, first, F.lit(-1).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))

    def ratio(i: Column) -> Column:
        return ((set_size - i).cast("double") * (drawn - i)
                / ((i + 1).cast("double") * (population - set_size - drawn + i + 1)))

    rest = F.aggregate(steps, F.lit(1.0), lambda acc, i: F.lit(1.0) + acc * ratio(i))
    start = (ln_choose(set_size, first) + ln_choose(population - set_size, drawn - first)
             - ln_choose(population, drawn))
    return F.when(first <= last, F.least(F.lit(0.0), start + F.ln(rest)))


# ---- seeded draws: 32-bit arithmetic on non-negative longs ----

_MASK = 0xFFFFFFFF


def _times32(a: Column, b: Column) -> Column:
    """Low 32 bits of a*b, formed from 16-bit halves so that no product overflows a long."""
    low = a.bitwiseAND(F.lit(65535)) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(65535)) * 65536
    return (low + high).bitwiseAND(F.lit(_MASK))


def string_seed(text: Column) -> Column:
    """|h| of the polynomial rolling hash h*31+c over the characters, kept in 32 signed bits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: (acc * 31 + c).bitwiseAND(F.lit(_MASK)))
    return F.when(h >= 2**31, F.lit(2**32) - h).otherwise(h)


def seeded_uniform(df: DataFrame, seed: str, k: str, out: str) -> DataFrame:
    """Draw number ``k`` (from 0) of the public mulberry32 generator, as a pure function of (seed, k).

    Each step is its own column, so no step's expression is written out twice.
    """
    # The generator's published increment, shifts and multipliers.
    step = _times32((F.col(k) + 1).bitwiseAND(F.lit(_MASK)), F.lit(0x6D2B79F5).cast("long"))
    t, s = F.col("_t"), F.col("_s")
    return (
        df.withColumn("_s", (F.col(seed) + step).bitwiseAND(F.lit(_MASK)))
        .withColumn("_t", _times32(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1))))
        .withColumn("_s", _times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61))))
        .withColumn("_t", (t + s).bitwiseAND(F.lit(_MASK)).bitwiseXOR(t))
        .withColumn(out, t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / 4294967296.0)
        .drop("_s", "_t")
    )
