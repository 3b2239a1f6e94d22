"""Statistics as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959964


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """Struct lo, hi of Wilson's interval; 0 and 1 without observations."""
    p, z2 = k / n, z * z
    middle, scale = p + z2 / (2 * n), 1 + z2 / n
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    lo = F.when(n > 0, F.greatest(F.lit(0.0), (middle - half) / scale)).otherwise(0.0)
    hi = F.when(n > 0, F.least(F.lit(1.0), (middle + half) / scale)).otherwise(1.0)
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def mcnemar(b01: Column, b10: Column) -> Column:
    """Exact two-sided p-value of the discordant counts: the binomial tail, summed in logarithms so that large counts don't overflow."""
    m, k = b01 + b10, F.least(b01, b10)
    step = F.aggregate(
        F.sequence(F.lit(0), k),
        F.struct(F.lit(0.0).alias("choose"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s.choose + F.when(i < m, F.log((m - i).cast("double")) - F.log((i + 1).cast("double"))).otherwise(0.0)).alias("choose"), (s.sum + F.exp(s.choose - m * F.log(F.lit(2.0)))).alias("sum")),
    )
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * step.sum))


def rule_of_three(n: Column) -> Column:
    """Upper 95 % limit of a rate at which none was seen in n."""
    return F.when(n > 0, 3.0 / n)


def rate_text(k: Column, n: Column, least: int = 20) -> Column:
    """'k/n' of few observations, a percentage with its interval of many, '-' of none."""
    pct = lambda x: F.format_string("%.1f%%", 100 * x)
    w = wilson(k, n)
    return F.when(n == 0, "-").when(n < least, F.concat_ws("/", k, n)).otherwise(F.concat(pct(k / n), F.lit(" ["), pct(w.lo), F.lit(", "), pct(w.hi), F.lit("]")))


def decision_threshold(cost_false_accept: float, cost_false_reject: float) -> float:
    """The probability from which accepting costs less."""
    if cost_false_accept <= 0:
        raise ValueError("the cost of a false accept must be positive")
    return 1 - cost_false_reject / cost_false_accept
