"""Test statistics and p-values as native column expressions.

Every series has a bounded number of terms whatever the number of rows behind
it, so the expressions are safe on aggregates of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriparity.functions.values import ratio

# Significance level and the chi-square(1) quantile belonging to it.
ALPHA = 0.05
CHI2_1_AT_ALPHA = 3.841458820694124

ERF_TERMS = 60  # of the series below ERF_SERIES_LIMIT and of the continued fraction above
ERF_SERIES_LIMIT = 2.0
GAMMA_SHIFT = 50
# exp-sinh quadrature: step and range of the nodes
NODE_STEP, NODE_FROM, NODE_TO = 0.1, -4.6, 4.3


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body names it.

    Without it the nested formulas below repeat their inputs into very large
    expression trees.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _power_sum(first: Column, ratio_of: Callable[[Column], Column], terms: Column) -> Column:
    """``first * (1 + r2 + r2*r3 + ...)`` over ``terms`` terms, r_k = ratio_of(k)."""

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * ratio_of(k.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    more = F.when(terms >= 2, F.sequence(F.lit(2), terms.cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(first.alias("term"), first.alias("total"))
    return F.aggregate(more, start, step, lambda acc: acc["total"])


def _erfc_series(x: Column) -> Column:
    series = _power_sum(x, lambda k: F.lit(2.0) * x * x / (F.lit(2.0) * k - 1.0), F.lit(ERF_TERMS))
    return F.greatest(1.0 - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * series, F.lit(0.0))


def _erfc_fraction(x: Column) -> Column:
    """Laplace's continued fraction, from its innermost term outwards; no difference is taken."""
    return F.aggregate(
        F.sequence(F.lit(ERF_TERMS), F.lit(1), F.lit(-1)), x, lambda acc, k: x + k.cast("double") / 2.0 / acc
    )


def _erfc_tail(x: Column) -> Column:
    return F.exp(-x * x) / (_erfc_fraction(x) * math.sqrt(math.pi))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: one minus the series of erf where that is small, else its tail."""
    return _bind(
        x.cast("double"),
        lambda v: F.when(v < ERF_SERIES_LIMIT, _erfc_series(v)).otherwise(
            _erfc_tail(F.greatest(v, F.lit(ERF_SERIES_LIMIT)))
        ),
    )


def log_erfc(x: Column) -> Column:
    """Logarithm of ``erfc`` for x >= 0, finite where erfc itself is too small for a double."""
    far = lambda v: -v * v - F.ln(_erfc_fraction(v)) - math.log(math.pi) / 2
    return _bind(
        x.cast("double"),
        lambda v: F.when(v < ERF_SERIES_LIMIT, F.ln(_erfc_series(v))).otherwise(far(F.greatest(v, F.lit(ERF_SERIES_LIMIT)))),
    )


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


def g_statistic(n_priv: Column, dirty_priv: Column, n_dis: Column, dirty_dis: Column) -> Column:
    """Log-likelihood ratio of the 2x2 table group x dirty with Yates' correction.

    Each observed cell moves toward its expected count by at most one half, and
    a cell that reaches zero adds nothing.
    """
    n = (n_priv + n_dis).cast("double")
    dirty = (dirty_priv + dirty_dis).cast("double")

    def part(cell: Column, row: Column, column: Column) -> Column:
        return _bind(
            F.struct(cell.alias("seen"), ratio(row * column, n).alias("expected")),
            lambda c: _bind(
                c["seen"]
                + F.signum(c["expected"] - c["seen"]) * F.least(F.lit(0.5), F.abs(c["expected"] - c["seen"])),
                lambda moved: F.when(moved <= 0, F.lit(0.0)).otherwise(
                    moved * F.ln(ratio(moved, c["expected"]))
                ),
            ),
        )

    def row_parts(total: Column, flagged: Column) -> Column:
        total, flagged = total.cast("double"), flagged.cast("double")
        return part(flagged, total, dirty) + part(total - flagged, total, n - dirty)

    return 2.0 * (row_parts(n_dis, dirty_dis) + row_parts(n_priv, dirty_priv))


def testable(n_priv: Column, dirty_priv: Column, n_dis: Column, dirty_dis: Column) -> Column:
    """Some row is dirty and neither group is dirty throughout (or empty)."""
    return ((dirty_priv > 0) | (dirty_dis > 0)) & (n_priv != dirty_priv) & (n_dis != dirty_dis)


def g_or_null(n_priv: Column, dirty_priv: Column, n_dis: Column, dirty_dis: Column) -> Column:
    """The G statistic where the table is testable, else NULL."""
    counts = (n_priv, dirty_priv, n_dis, dirty_dis)
    return F.when(testable(*counts), g_statistic(*counts))


def g_p_value(g: Column) -> Column:
    """Chi-square(1) tail of ``g``."""
    return F.when(g.isNotNull(), erfc(F.sqrt(F.greatest(g, F.lit(0.0)) / 2.0)))


def g_log_p(g: Column) -> Column:
    """Logarithm of ``g_p_value``: tells strongly significant tables apart whose p is 0 to any printed digits."""
    return F.when(g.isNotNull(), log_erfc(F.sqrt(F.greatest(g, F.lit(0.0)) / 2.0)))


def g_disparate(g: Column) -> Column:
    """p below the level; FALSE when not testable."""
    return F.coalesce(g > CHI2_1_AT_ALPHA, F.lit(False))


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the series in 1/a at a larger argument, brought back by products."""
    far = a + float(GAMMA_SHIFT)
    series = 1.0 + (-1 / 8 + (1 / 128 + (5 / 1024 + (-21 / 32768 - 399 / 262144 / far) / far) / far) / far) / far
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(GAMMA_SHIFT - 1)),
        F.sqrt(far) * series,
        lambda acc, i: acc * (a + i.cast("double")) / (a + i.cast("double") + 0.5),
    )


def _nodes() -> Column:
    """Places z and weights of exp(-z) dz over z > 0."""
    out = []
    for i in range(round((NODE_TO - NODE_FROM) / NODE_STEP) + 1):
        s = NODE_FROM + i * NODE_STEP
        z = math.exp(s - math.exp(-s))
        out.append(F.struct(F.lit(z).alias("z"), F.lit(NODE_STEP * z * (1 + math.exp(-s)) * math.exp(-z)).alias("w")))
    return F.array(*out)


def t_two_sided(t: Column, dof: Column, log: bool = False) -> Column:
    """Two-sided p of Student's t (or its logarithm), one formula for all degrees of freedom.

    With k2 = dof / (dof + t**2) the tail is k2**(dof/2) times the integral of
    exp(-z) / sqrt(1 - k2 * exp(-2 z / dof)) over z > 0, up to a constant; the
    nodes of the quadrature do not depend on the number of pairs.
    """

    def tail(x: Column) -> Column:
        square, n = x["t"] * x["t"], x["dof"]
        k2, rest = n / (n + square), square / (n + square)
        area = F.aggregate(
            _nodes(), F.lit(0.0), lambda acc, at: acc + at["w"] / F.sqrt(rest - k2 * F.expm1(at["z"] * -2.0 / n))
        )
        constant = _gamma_ratio(n / 2.0) * 2.0 / (n * math.sqrt(math.pi))
        if log:
            return F.least(F.ln(constant * area) + F.log1p(square / n) * n * -0.5, F.lit(0.0))
        return F.least(constant * F.exp(F.log1p(square / n) * n * -0.5) * area, F.lit(1.0))

    return _bind(F.struct(t.cast("double").alias("t"), dof.cast("double").alias("dof")), tail)


def paired_t(n: Column, mean: Column, sd: Column) -> Column:
    """Paired t statistic from count, mean and sample deviation of the differences.

    Fewer than two pairs, or differences that are all zero, give 0; equal
    non-zero differences give an infinite value with the sign of their mean.
    """
    nothing = (n < 2) | mean.isNull() | sd.isNull() | ((sd == 0) & (mean == 0))
    return (
        F.when(nothing, F.lit(0.0))
        .when(sd == 0, F.signum(mean) * F.lit(float("inf")))
        .otherwise(ratio(mean * F.sqrt(n.cast("double")), sd))
    )


def paired_p(n: Column, t: Column) -> Column:
    """Two-sided p belonging to ``paired_t``."""
    return (
        F.when((n < 2) | (t == 0), F.lit(1.0))
        .when(F.abs(t) == float("inf"), F.lit(0.0))
        .otherwise(t_two_sided(t, F.greatest(n - 1, F.lit(1))))
    )


def paired_log_p(n: Column, t: Column) -> Column:
    """Logarithm of ``paired_p``; minus infinity for differences that are all equal and not zero."""
    return (
        F.when((n < 2) | (t == 0), F.lit(0.0))
        .when(F.abs(t) == float("inf"), F.lit(float("-inf")))
        .otherwise(t_two_sided(t, F.greatest(n - 1, F.lit(1)), log=True))
    )


def one_sided(t: Column, p_two: Column, direction: str) -> Column:
    """One-sided p from the two-sided one; ``direction`` is positive or negative."""
    if direction not in ("positive", "negative"):
        raise ValueError(f"Unsupported: {direction}")
    agrees = t > 0 if direction == "positive" else t < 0
    return F.when(agrees, p_two * 0.5).otherwise(1.0 - p_two * 0.5)


def impact_verdict(t: Column, p_two: Column, alpha: Column, lower_is_better: bool) -> Column:
    """``positive``, ``negative`` or ``insignificant`` change after cleaning.

    A fairness gap is better when it falls, an accuracy when it rises.
    """
    fell, rose = ("positive", "negative") if lower_is_better else ("negative", "positive")
    significant = p_two < alpha
    return (
        F.when(significant & (one_sided(t, p_two, "negative") < alpha), fell)
        .when(significant & (one_sided(t, p_two, "positive") < alpha), rose)
        .otherwise("insignificant")
    )
