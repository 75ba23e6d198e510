"""Ranks and running totals in a total order, by ranges and offsets; no task sees more than a range.

Rows are dealt to sorted ranges, each range adds up its own rows, and the ranges' totals (one row a
range and group) tell every range what lies before it. There are as many ranges as shuffle
partitions, so the work spreads with the data, and a group that holds most rows fills several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored_table


def running_totals(rows: DataFrame, order: list[Column | str], amounts: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``rows`` with a column for each amount: its sum over the row and those before it in its group.

    ``order`` has to be total for one answer only; groups of nulls are groups as others. The dealt rows are
    written once, eagerly, as sampled ranges need not be the same when they are computed again; the ranges'
    totals read only the groups and amounts of them.
    """
    by, names = by or [], list(amounts)
    ranged = stored_table(rows.withColumns(amounts).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *by).agg(*[F.sum(n).alias(n) for n in names])
    offsets = totals.select(F.col("_part").alias("_of"), *[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names])
    met = F.col("_part") == F.col("_of")
    for k, b in enumerate(by):
        met = met & F.col(b).eqNullSafe(F.col(f"_by{k}"))
    summed = ranged.select(*[c for c in ranged.columns if c not in names], *[F.sum(n).over(own).alias(n) for n in names])
    joined = summed.join(offsets, met)
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in names])


def picked_ranks(rows: DataFrame, value: str, by: list[str], ranks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(by..., n, names...): the values at 0-based ranks of each group, from expressions of its size ``n``.

    A rank is a pair (low, high) of whole numbers; what comes out is a struct of the two values.
    Nulls are left out. Equal values are counted together first, so one frequent value is one row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    summed = running_totals(counts, [value], {"_upto": F.col("_n")}, by)
    if by:
        sizes = summed.groupBy(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)]).agg(F.max("_upto").alias("n"))
        same = F.lit(True)
        for k, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"_by{k}"))
        joined = summed.join(sizes, same)
    else:
        joined = summed.withColumn("n", F.lit(summed.agg(F.max("_upto")).first()[0]).cast("long"))
    at = lambda rank: F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col(value)))
    picked = [F.struct(at(low).alias("low"), at(high).alias("high")).alias(name) for name, (low, high) in ranks.items()]
    return joined.groupBy(*by, "n").agg(*picked)


def quantiles(rows: DataFrame, value: str, by: list[str], points: list[float]) -> DataFrame:
    """(by..., n, quantiles): exact quantiles with linear interpolation, an array in the order of ``points``."""
    place = {f"_q{k}": F.lit(float(p)) * (F.col("n") - 1) for k, p in enumerate(points)}
    got = picked_ranks(rows, value, by, {name: (F.floor(x), F.ceil(x)) for name, x in place.items()})
    share = {name: x - F.floor(x) for name, x in place.items()}
    return got.select(*by, "n", F.array(*[F.col(f"{name}.low") + (F.col(f"{name}.high") - F.col(f"{name}.low")) * w for name, w in share.items()]).alias("quantiles"))


def upper_medians(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, upper_median): the value at rank n div 2 of each group."""
    middle = F.floor(F.col("n") / 2)
    return picked_ranks(rows, value, by, {"_m": (middle, middle)}).select(*by, "n", F.col("_m.low").alias("upper_median"))
