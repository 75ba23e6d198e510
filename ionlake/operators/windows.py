"""Ranking, q-values, islands, bins and reshaping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stored_table
from .ranks import quantiles, running_totals


def q_values(psms: DataFrame, score: str, is_decoy: str, ties: list[str], partition: list[str] | None = None, out: str = "q_value") -> DataFrame:
    """Decoys over targets among the rows that score as well or better; ``ties`` break equal scores.

    The order is global or, with ``partition``, that of each run; either is dealt to ranges.
    """
    decoy = F.col(is_decoy).cast("int")
    summed = running_totals(psms, [F.desc(score), *ties], {"_bad": decoy, "_good": 1 - decoy}, partition)
    return summed.withColumn(out, F.try_divide(F.col("_bad").cast("double"), F.col("_good"))).drop("_bad", "_good")


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def best_in_sequence(rows: DataFrame, key_sets: list[list[str]], order: list[Column | str]) -> DataFrame:
    """best_per_key for one key set after the other."""
    for keys in key_sets:
        rows = best_per_key(rows, keys, order)
    return rows


def gap_islands(rows: DataFrame, value: str, gap: float, partition: list[str], ties: list[str], out: str = "island") -> DataFrame:
    """Numbers, from 0, runs of neighbouring values that are less than ``gap`` apart, in each group or over all.

    Neighbours are found by number, so a group may hold any share of the rows.
    """
    numbered = stored_table(running_totals(rows, [value, *ties], {"_place": F.lit(1).cast("long")}, partition), "places")
    before = numbered.select(*[F.col(p).alias(f"_before{k}") for k, p in enumerate(partition)], (F.col("_place") + 1).alias("_next"), F.col(value).alias("_value"))
    met = F.col("_place") == F.col("_next")
    for k, p in enumerate(partition):
        met = met & F.col(p).eqNullSafe(F.col(f"_before{k}"))
    marked = numbered.join(before, met, "left").withColumn("_new", F.coalesce((F.col(value) - F.col("_value") >= gap).cast("int"), F.lit(0)))
    summed = running_totals(marked.select(*rows.columns, "_place", "_new"), ["_place"], {out: F.col("_new")}, partition)
    return summed.drop("_place", "_new")


def having_more_than(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of the keys that occur more than ``n`` times."""
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n).drop("_n")
    return rows.join(often, keys, "left_semi")


def quantile_bins(rows: DataFrame, value: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Equal-frequency bins by value, 0 to bins-1: equal values share a bin, the upper edge is in."""
    found = quantiles(rows, value, [], [k / bins for k in range(1, bins)]).first()
    number = F.lit(0)
    for k, e in enumerate(found["quantiles"] if found else [], 1):
        number = F.when(F.col(value) > e, k).otherwise(number)
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), number))


def top_peaks(mzs: Column, intensities: Column, n: int = 3) -> Column:
    """m/z of the n most intense peaks, ascending; of equal intensities the earlier one counts first."""
    ranked = F.sort_array(F.transform(F.arrays_zip(mzs.alias("mz"), intensities.alias("it")), lambda p, i: F.struct((-p["it"]).alias("k"), i.alias("i"), p["mz"].alias("mz"))))
    return F.sort_array(F.transform(F.slice(ranked, 1, n), lambda p: p["mz"]))


def contains_all(observed: Column, predicted: Column, tolerance: float) -> Column:
    """Every predicted m/z has an observed one strictly within the tolerance; an empty observed list has none."""
    near = lambda x: F.exists(observed, lambda m: (m > x - tolerance) & (m < x + tolerance))
    return (F.size(observed) > 0) & F.forall(predicted, near)


#: Rows of either side, pairs of them, and bytes of these pairs that a cell of the match takes on average.
CELL_ROWS, CELL_PAIRS, CELL_BYTES = 100_000, 4_000_000, 256 << 20


def _count_and_width(rows: DataFrame) -> tuple[int, float]:
    """How many rows there are, and the bytes of one on average: 8 for each number, text and lists by their length."""
    lists = [F.coalesce(F.size(c), F.lit(0)) * 8 for c, k in rows.dtypes if k.startswith("array")]
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, k in rows.dtypes if k in ("string", "binary")]
    wide = sum([*lists, *texts], F.lit(8 * len(rows.columns)))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(wide).alias("width")).first()
    return got["n"], got["width"] or 8.0


def _bounds(rows: DataFrame, mz: str, ranges: int) -> np.ndarray:
    found = rows.agg(F.percentile_approx(F.col(mz).cast("double"), [k / ranges for k in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else None
    return np.array(found or [], float)


def range_match(left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, tolerance: float, cell_rows: int = CELL_ROWS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """Pairs whose m/z are strictly less than ``tolerance`` apart; null m/z match nothing.

    Both sides are dealt to the same ranges of m/z, and only a right row near a border stands in more than
    one. In a range both runs are sorted and swept once. A range with more rows than a task should take, or
    more pairs, such as one frequent m/z, is cut into cells: parts of the left by parts of the right. Pairs
    are bounded from counts in buckets of the tolerance; what decides is one row a range.
    """
    left, right = left.where(F.col(left_mz).isNotNull()), right.where(F.col(right_mz).isNotNull())
    (n_left, left_width), (n_right, right_width) = _count_and_width(left), _count_and_width(right)
    cell_pairs = max(1, min(cell_pairs, int(CELL_BYTES / (left_width + right_width))))
    ranges = max(1, -(-max(n_left, n_right) // cell_rows), min(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n_left + n_right) // 1000))
    borders = np.unique(np.concatenate([_bounds(left, left_mz, ranges), _bounds(right, right_mz, ranges)]))

    def touched(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(borders, x - reach, side="right"), np.searchsorted(borders, x + reach, side="right")

    # a rounding error wider than the tolerance, so that the exact test decides
    reach = tolerance * (1 + 1e-9) + 1e-9

    def counted(mz: str, own_reach: float):
        def apply(batches):
            total = np.zeros(len(borders) + 1, np.int64)
            for batch in batches:
                first, last = touched(batch.column(mz).cast(pa.float64()).to_numpy(zero_copy_only=False), own_reach)
                total += np.cumsum(np.bincount(first, minlength=len(total) + 1) - np.bincount(last + 1, minlength=len(total) + 1))[: len(total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["range", "n"])

        return apply

    def totals(rows: DataFrame, mz: str, own_reach: float) -> np.ndarray:
        out = np.zeros(len(borders) + 1, np.int64)
        for r in rows.select(mz).mapInArrow(counted(mz, own_reach), "range int, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
            out[r["range"]] = r["n"]
        return out

    def bounded() -> np.ndarray:
        """At least the pairs of each range: rows of a bucket by those of it and its neighbours."""
        bucket = lambda mz: F.floor(F.col(mz).cast("double") / reach)
        ours = left.groupBy(bucket(left_mz).alias("b")).agg(F.count(F.lit(1)).alias("l"))
        near = F.explode(F.array(*[bucket(right_mz) + k for k in (-1, 0, 1)]))
        theirs = right.select(near.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("r"))
        both = ours.join(theirs, "b").select((F.col("b") * F.lit(reach)).alias("x"), (F.col("l") * F.col("r")).cast("double").alias("pairs"))

        def placed(batches):
            total = np.zeros(len(borders) + 1)
            for batch in batches:
                x, pairs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "pairs"))
                total += np.bincount(np.searchsorted(borders, x, side="right"), pairs, len(total))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["range", "pairs"])

        out = np.zeros(len(borders) + 1)
        for r in both.mapInArrow(placed, "range int, pairs double").groupBy("range").agg(F.sum("pairs").alias("pairs")).collect():
            out[r["range"]] = r["pairs"]
        # a bucket that begins before a border may lie beyond it
        return out + np.concatenate([[0.0], out[:-1]]) if len(out) > 1 else out

    lefts, rights = totals(left, left_mz, 0.0), totals(right, right_mz, reach)
    a, b, pairs = np.maximum(1, -(-lefts // cell_rows)), np.maximum(1, -(-rights // cell_rows)), bounded()
    while (dense := (pairs > cell_pairs * a * b) & ((lefts > a) | (rights > b))).any():
        wide = (lefts // a >= rights // b) & (lefts > a) | (rights <= b)
        a, b = np.where(dense & wide, 2 * a, a), np.where(dense & ~wide, 2 * b, b)
    firsts = np.concatenate([[0], np.cumsum(a * b)])  # the cells of a range lie side by side

    def dealt(rows: DataFrame, mz: str, is_left: bool) -> DataFrame:
        names = rows.columns

        def apply(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                first, last = touched(batch.column(mz).cast(pa.float64()).to_numpy(zero_copy_only=False), 0.0 if is_left else reach)
                row = np.repeat(np.arange(batch.num_rows), last - first + 1)
                at = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
                copies = (b if is_left else a)[at]
                spread = np.repeat(np.arange(len(row)), copies)
                copy = np.arange(len(spread)) - np.repeat(np.cumsum(copies) - copies, copies)
                row, at = row[spread], at[spread]
                part = batch.column("_h").to_numpy()[row].astype(np.uint64) % (a if is_left else b)[at].astype(np.uint64)
                cell = firsts[at] + (part.astype(np.int64) * b[at] + copy if is_left else copy * b[at] + part.astype(np.int64))
                held = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(held.column(c) for c in names), pa.array(cell)], names=[*names, "_cell"])

        kinds = dict(rows.dtypes)
        return rows.withColumn("_h", F.xxhash64(*names)).mapInArrow(apply, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _cell long")

    out, own_names, other_names = [*left.dtypes, *right.dtypes], left.columns, right.columns

    def sweep(own: pa.Table, other: pa.Table) -> pa.Table:
        other = other.sort_by(right_mz)
        x, y = (t[c].cast(pa.float64()).to_numpy() for t, c in ((own, left_mz), (other, right_mz)))
        low, high = np.searchsorted(y, x - reach, side="left"), np.searchsorted(y, x + reach, side="right")
        i = np.repeat(np.arange(len(x)), high - low)
        j = np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[i]
        near = (x[i] > y[j] - tolerance) & (x[i] < y[j] + tolerance)
        i, j = pa.array(i[near]), pa.array(j[near])
        return pa.Table.from_arrays([*(own[c].combine_chunks().take(i) for c in own_names), *(other[c].combine_chunks().take(j) for c in other_names)], names=[*own_names, *other_names])

    sides = [dealt(rows, mz, is_left).groupBy("_cell") for rows, mz, is_left in ((left, left_mz, True), (right, right_mz, False))]
    return sides[0].cogroup(sides[1]).applyInArrow(sweep, ", ".join(f"`{c}` {k}" for c, k in out))


def match_spectra(spectra: DataFrame, peptides: DataFrame, precursor_tolerance: float, peak_tolerance: float = 0.02) -> DataFrame:
    """(spec_id, source_file, title) of spectra that fit a peptide's precursor and hold all its top peaks.

    ``spectra``: title, source_file, precursor_mz, mzs; ``peptides``: spec_id, prec_mz, top_mzs.
    """
    held = spectra.where(F.col("precursor_mz").isNotNull())
    met = range_match(held, peptides, "precursor_mz", "prec_mz", precursor_tolerance)
    return met.where(contains_all(F.col("mzs"), F.col("top_mzs"), peak_tolerance)).select("spec_id", "source_file", "title")


def stable_split(rows: DataFrame, key: str, fraction: float, salt: str = "split") -> tuple[DataFrame, DataFrame]:
    """(train, test) by the key's hash: a key is on one side in every run, wherever its rows are."""
    held = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return rows.where(~held), rows.where(held)


def renamed_values(rows: DataFrame, column: str, names: dict[str, str], where: Column | None = None) -> DataFrame:
    """``rows`` with values of ``column`` renamed, such as a model's label in a figure; only rows that fit ``where``, if given, and names that are listed."""
    own = F.col(column)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    renamed = F.coalesce(F.try_element_at(table, own), own)
    return rows.withColumn(column, renamed if where is None else F.when(where, renamed).otherwise(own))


def global_numbers(rows: DataFrame, order: list[str], start: int = 0, out: str = "scan") -> DataFrame:
    """Consecutive numbers in a total order."""
    return running_totals(rows, order, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1 + start)
