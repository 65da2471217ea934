"""Column functions on runtimes and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def speedup(before: Column, after: Column) -> Column:
    """before / after; null where after is 0 or a side is missing."""
    return F.try_divide(before, after)


def improvement_percent(before: Column, after: Column) -> Column:
    """The signed change in percent; negative is faster."""
    return F.try_divide(after - before, before) * 100


def gated(ratio: Column, correctness: Column) -> Column:
    """A speedup counts only where everything passes; otherwise it is 1."""
    return F.when(correctness == 1, ratio).otherwise(F.lit(1.0))


def human_ratio(pred: Column, gold: Column) -> Column:
    """The gated speedup as a share of the expert's; 0 where that is 0."""
    return F.when(gold == 0, F.lit(0.0)).otherwise(F.try_divide(pred, gold))


def positive_finite(*xs: Column) -> Column:
    """True where every value is a finite positive number."""
    out = F.lit(True)
    for x in xs:
        out = out & F.coalesce((x > 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))
    return out


def known(x: Column) -> Column:
    """Null in place of NaN."""
    return F.when(~F.isnan(x), x)


def short_number(x: Column, thousands: bool = False, percent: bool = False) -> Column:
    """As a label: whole numbers plain, others with one decimal; with `percent` always one and the sign, with `thousands` large ones as 12k. A dash for null."""
    if percent:
        out = F.format_string("%.1f%%", x)
    else:
        out = F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(F.format_string("%.1f", x))
        if thousands:
            out = F.when(x >= 1000, F.format_string("%.0fk", x / 1000)).otherwise(out)
    return F.when(x.isNull(), "\u2014").otherwise(out)


def bucket_right(x: Column, edges: list[float]) -> Column:
    """The index of the bucket (e[i], e[i+1]] of x; the first edge is included. Null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = x >= edges[i] if i == 0 else x > edges[i]
        high = x <= edges[i + 1] if edges[i + 1] != float("inf") else F.lit(True)
        out = F.when(low & high, F.lit(i)).otherwise(out)
    return out


def log_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The index of the log-spaced bin of x in [low, high]: 0 for what isn't positive; a range without width is widened by a tenth."""
    a, b = F.when(low == high, low * 0.9).otherwise(low), F.when(low == high, high * 1.1).otherwise(high)
    at = F.floor(F.lit(float(bins)) * F.try_divide(F.ln(x) - F.ln(a), F.ln(b) - F.ln(a)))
    return F.when(x > 0, F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
