"""Aggregate expressions that compare predicted with observed intensities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .residues import PSEUDO

#: Relative variance under which a group counts as constant.
FLAT = 1e-12


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where it is not defined (one row, a constant side)."""

    def varies(v):
        return F.var_pop(v) > FLAT * F.greatest(F.lit(1.0), F.avg(v) * F.avg(v))

    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.count(F.lit(1)) > 1) & varies(x) & varies(y), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def share_log_corr(rows: DataFrame, by: list[str], x: str, y: str, out: str = "pearsonr") -> DataFrame:
    """(by..., out): Pearson's r of log2 of both sides' shares of their group's total, plus the pseudo-count.

    The groups' totals are added up first and joined to the rows, so no task holds a group; null is a group too.
    """
    totals = rows.groupBy(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)]).agg(F.sum(x).alias("_x"), F.sum(y).alias("_y"))
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    logged = rows.join(totals, same).select(*by, *[to_log(F.try_divide(F.col(c), F.col(t))).alias(f"_{k}") for k, (c, t) in enumerate(((x, "_x"), (y, "_y")))])
    return logged.groupBy(*by).agg(safe_corr(F.col("_0"), F.col("_1")).alias(out))


def is_compared(charge: Column, ion: Column) -> Column:
    """Rows that published comparisons count: charges 2 to 4, without doubly charged prefix ions."""
    return charge.between(2, 4) & (ion != "B2")


def corr_or_zero(x: Column, y: Column) -> Column:
    return F.coalesce(safe_corr(x, y), F.lit(0.0))


def spectral_angle(x: Column, y: Column, epsilon: float = 1e-7) -> Column:
    """1 - 2 acos(cosine) / pi as an aggregate; norms are floored at ``epsilon``."""
    norm = lambda v: F.greatest(F.sqrt(F.sum(v * v)), F.lit(epsilon))
    cosine = F.sum(x * y) / (norm(x) * norm(y))
    return 1 - 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.pi()


def array_angle(x: Column, y: Column, epsilon: float = 1e-7) -> Column:
    """The same for two arrays of one row."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(epsilon))
    cosine = dot(x, y) / (norm(x) * norm(y))
    return 1 - 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.pi()


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """``values`` to ``digits`` places, halves away from zero."""
    scaled = values * 10.0**digits
    return np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**digits


def unlog(x: Column, clip: bool = True) -> Column:
    """2^x less the pseudo-count; at least 0 if ``clip``."""
    value = F.pow(F.lit(2.0), x) - PSEUDO
    return F.greatest(value, F.lit(0.0)) if clip else value


def to_log(share: Column) -> Column:
    return F.log2(share + PSEUDO)


def share_above(x: Column, floor: float = -9.95) -> Column:
    return F.avg(F.when(x > floor, 1.0).otherwise(0.0))


def share_found(x: Column, tolerance: float = 0.001) -> Column:
    """Share of values that are not the missing-peak value."""
    return F.avg(F.when(F.abs(x - F.log2(F.lit(PSEUDO))) > tolerance, 1.0).otherwise(0.0))
