"""Peptide filters, masses and fragment ladders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..functions.mods import Catalogue, blank_mods, parse_mods, shift_total
from ..functions.residues import FRAGMENT_MASS, HYDROGEN, INVALID_RESIDUES, ION_SERIES, PEAK_VERSIONS, PRECURSOR_MASS, SIDE_SERIES, WATER, residue_masses, total
from .features import by_length

MIN_LENGTH, MAX_LENGTH = 3, 99


def is_predictable(peptide: Column) -> Column:
    return ~peptide.rlike(f"[{INVALID_RESIDUES}]") & F.char_length(peptide).between(MIN_LENGTH, MAX_LENGTH)


def clean_peptides(peprec: DataFrame) -> DataFrame:
    """Rows that can be predicted, with blank modifications as ``-``."""
    return peprec.where(is_predictable(F.col("peptide"))).withColumn("modifications", blank_mods(F.col("modifications")))


def is_tryptic(peptide: Column) -> Column:
    return peptide.rlike("[KR]$")


def precursor_mass(peptide: Column, pairs: Column | None = None, catalogue: Catalogue | None = None) -> Column:
    mass = total(residue_masses(peptide, PRECURSOR_MASS)) + WATER
    return mass if pairs is None else mass + shift_total(pairs, catalogue or Catalogue())


#: Mass of water and of one alkylation in the masses that library samplers compare.
COUNTED_WATER, COUNTED_SHIFT = 18.010601, 57.02146


def counted_mass(peptide: Column, count: Column, shift: float = COUNTED_SHIFT) -> Column:
    """The mass of a peptide with ``count`` modifications of one kind, whatever their places."""
    return total(residue_masses(peptide, PRECURSOR_MASS)) + COUNTED_WATER + count * shift


def precursor_mz(mass: Column, charge: Column) -> Column:
    return (mass + charge * HYDROGEN) / charge


def in_window(value: Column, low: float | None, high: float | None) -> Column:
    """Inclusive window, applied only when both ends are set."""
    return F.lit(True) if low is None or high is None else value.between(low, high)


def _series(version: str) -> dict[str, tuple[str, float]]:
    """Ion types of a version: the series that each is made of, and what is added to its m/z."""
    if version != "all":
        return {s: (s, 0.0) for s in PEAK_VERSIONS[version]}
    out = {s: (s, 0.0) for s in ("B", "Y", "B2", "Y2")}
    for name, (base, offset) in SIDE_SERIES.items():
        out[name], out[name + "2"] = (base, offset), (base + "2", offset / 2)
    return out


_MASS = np.full(256, np.nan)
for _a, _m in FRAGMENT_MASS.items():
    _MASS[ord(_a)] = _m


def _slot_masses(names: pa.Array, slots: dict[str, float]) -> np.ndarray:
    coded = names.dictionary_encode()
    known = np.array([slots.get(n, np.nan) for n in coded.dictionary.to_pylist()] or [np.nan])
    return known[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)]


def _placed_mods(pairs: pa.Array, slots: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, mass in that place) of every modification of a batch, in order; NaN for an unknown name."""
    flat = pairs.flatten()
    rows = np.repeat(np.arange(len(pairs)), pc.fill_null(pc.list_value_length(pairs), 0).to_numpy(zero_copy_only=False))
    return rows, flat.field("pos").fill_null(-9).to_numpy(zero_copy_only=False), _slot_masses(flat.field("name"), slots)


def _placed_strings(mods: pa.Array, slots: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from modification strings, which are read as ``parse_mods`` does."""
    some = np.flatnonzero(~pc.is_in(mods, value_set=pa.array(["-", "", None], pa.string())).to_numpy(zero_copy_only=False))
    fields = pc.split_pattern(mods.take(pa.array(some)), "|")
    sizes = pc.list_value_length(fields).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes % 2).any():
        raise ValueError(f"modification string has an odd number of fields: {mods[int(some[np.argmax(sizes % 2)])]}")
    flat, places = fields.flatten(), np.arange(0, sizes.sum(), 2)
    pos = pc.utf8_trim_whitespace(flat.take(pa.array(places))).cast(pa.int32())
    return np.repeat(some, sizes // 2), pos.to_numpy(zero_copy_only=False), _slot_masses(flat.take(pa.array(places + 1)), slots)


def _ladders_by_length(batch: pa.RecordBatch, placed: tuple[np.ndarray, np.ndarray, np.ndarray], version: str, single: bool):
    """(rows, m/z matrix of each ion type) for the peptides of each length, from ``_peptide`` and the placed modifications.

    Masses are added from the terminus on, in one cumulative sum for the peptides of each length;
    ``single`` adds in single precision. A mass that is not known is NaN from its place on.
    """
    mod_row, mod_pos, mod_mass = placed
    wanted, kind = _series(version), np.float32 if single else np.float64
    local = np.full(batch.num_rows, -1)
    for rows, letters in by_length(batch, "_peptide"):
        n = letters.shape[1]
        if n < 2:
            continue
        masses, ends = _MASS[letters], {"prefix": np.zeros((len(rows), 1)), "suffix": np.zeros((len(rows), 1))}
        local[rows] = np.arange(len(rows))
        own = local[mod_row] >= 0
        row, pos, mass = local[mod_row[own]], mod_pos[own], mod_mass[own]
        local[rows] = -1
        inside = (pos > 0) & (pos <= n)
        masses[row[inside], pos[inside] - 1] = mass[inside]  # of several in a place the last stays
        ends["prefix"][row[pos == 0], 0] = mass[pos == 0]
        ends["suffix"][row[pos == -1], 0] = mass[pos == -1]
        ordered = {"prefix": masses[:, :-1], "suffix": masses[:, :0:-1]}
        sums = {s: np.cumsum(np.concatenate([ends[s], m], axis=1).astype(kind), axis=1, dtype=kind)[:, 1:].astype(np.float64) for s, m in ordered.items()}
        made = {}
        for name, (base, shift) in wanted.items():
            side, offset, charge = ION_SERIES[base]
            made[name] = ((sums[side] + offset) / charge).astype(kind) + (np.float64(shift) if version == "all" else 0)
        yield rows, made


def ladders(batch: pa.RecordBatch, version: str, catalogue: Catalogue, single: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(offsets, m/z of each ion type): the ladders of a batch's peptides one behind the other, from ``_peptide`` and ``_pairs``."""
    lengths = pc.fill_null(pc.binary_length(batch.column("_peptide")), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths - 1, 0))])
    out = {s: np.empty(starts[-1]) for s in _series(version)}
    for rows, made in _ladders_by_length(batch, _placed_mods(batch.column("_pairs"), catalogue.slots()), version, single):
        for name, mz in made.items():
            out[name][starts[rows][:, None] + np.arange(mz.shape[1])] = mz
    return starts, out


def ladder_totals(peprec: DataFrame, version: str = "general", catalogue: Catalogue | None = None, keep: tuple[str, ...] = ("spec_id",), digits: int = 9) -> DataFrame:
    """(keep..., ion, n_ions, first_mz, last_mz, sum_mz): one row for each peptide and ion type, m/z rounded to ``digits`` places.

    A ladder is summed up where it is made; its ions are no rows, and nothing is shuffled. An unknown mass counts
    as in ``fragment_ions``: such an m/z is null and left out of the sum. Halves are rounded away from zero.
    """
    slots = (catalogue or Catalogue()).slots()
    series, kinds = _series(version), dict(peprec.dtypes)
    names = list(series)
    mods = F.col("modifications") if "modifications" in peprec.columns else F.lit("-")
    rows = peprec.select(*keep, F.col("peptide").alias("_peptide"), mods.alias("_mods"))

    def apply(batches):
        for batch in batches:
            n, found = np.zeros(batch.num_rows, np.int64), np.full((3, batch.num_rows, len(names)), np.nan)
            placed = _placed_strings(batch.column("_mods"), slots)
            for own, made in _ladders_by_length(batch, placed, "ch2" if version == "all" else version, False):
                n[own] = next(iter(made.values())).shape[1]
                sums = {}
                for base, mz in made.items():
                    known = ~np.isnan(mz)
                    count = known.sum(axis=1)
                    sums[base] = count, mz.sum(axis=1) if known.all() else np.where(count > 0, np.nansum(mz, axis=1), np.nan)
                for k, (base, shift) in enumerate(series.values()):  # a series is its base, moved
                    mz, (count, total) = made[base], sums[base]
                    found[0, own, k], found[1, own, k], found[2, own, k] = mz[:, 0] + shift, mz[:, -1] + shift, total + count * shift
            found = rounded(found, digits)
            some = np.flatnonzero(n)
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(names))
            lists = []
            for values in found:
                flat = values[some].ravel()
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in keep), pa.array(n[some]), *lists], names=[*keep, "n_ions", "_first", "_last", "_sum"])

    laddered = rows.mapInArrow(apply, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_ions long, _first array<double>, _last array<double>, _sum array<double>")
    each = [F.struct(F.lit(s).alias("ion"), *[F.col(f"_{c}")[k].alias(f"{c}_mz") for c in ("first", "last", "sum")]) for k, s in enumerate(names)]
    return laddered.select(*keep, "n_ions", F.explode(F.array(*each)).alias("_i")).select(*keep, "_i.ion", "n_ions", "_i.first_mz", "_i.last_mz", "_i.sum_mz")


def fragment_ions(
    peprec: DataFrame,
    version: str = "general",
    catalogue: Catalogue | None = None,
    single: bool = False,
    keep: tuple[str, ...] = ("spec_id", "charge"),
    values: dict[str, Column] | None = None,
    use: tuple[str, ...] = (),
    found: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Long table (keep..., ion, ionnumber, mz[, prediction][, found...]), one row per ion of each peptide.

    ``version`` names the ion types: general, etd, ch2 or all (with neutral losses). A null
    modification string means none; an ion whose mass is not known has a null m/z. ``values`` gives, for
    the ion types it names, array columns with one prediction for each ion; other types are left out
    then. ``found`` makes further columns from the m/z array of an ion type and the columns ``use``, once
    for each peptide. A peptide's ladders are one row until the last step; nothing is shuffled.
    """
    catalogue = catalogue or Catalogue()
    carried = {} if values is None else {f"_v{k}": v for k, v in enumerate(values.values())}
    pairs = parse_mods(F.col("modifications")) if "modifications" in peprec.columns else F.array().cast("array<struct<pos:int,name:string>>")
    own = [*keep, *(c for c in use if c not in keep)]
    rows = peprec.select(*own, F.col("peptide").alias("_peptide"), pairs.alias("_pairs"), *[v.alias(n) for n, v in carried.items()])
    passed = [*own, *carried]
    held = {} if values is None else dict(zip(values, carried))
    names = {s: f"_m{k}" for k, s in enumerate(_series(version)) if values is None or s in held}
    number = pa.float32() if single and version != "all" else pa.float64()

    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                starts, mz = ladders(batch, version, catalogue, single)
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(mz[s].astype(number.to_pandas_dtype()), mask=np.isnan(mz[s]))) for s in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *lists], names=[*passed, *names.values()])

    kinds = dict(rows.dtypes)
    element = "float" if number == pa.float32() else "double"
    laddered = rows.mapInArrow(apply, ", ".join([*(f"`{c}` {kinds[c]}" for c in passed), *(f"{m} array<{element}>" for m in names.values())]))
    made = {s: {"mz": F.col(m), **({"prediction": F.col(held[s])} if held else {}), **{n: f(F.col(m)) for n, f in (found or {}).items()}} for s, m in names.items()}
    zipped = F.arrays_zip(*[c.alias(f"{k}_{n}") for k, own_columns in enumerate(made.values()) for n, c in own_columns.items()])
    placed = laddered.select(*keep, F.posexplode(zipped).alias("k", "own"))
    columns = list(next(iter(made.values())))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("ion"), *[F.col(f"own.{k}_{n}").alias(n) for n in columns]) for k, s in enumerate(made)]))
    long = placed.select(*keep, "k", each.alias("i"))
    return long.select(*keep, "i.ion", (F.col("k") + 1).cast("int").alias("ionnumber"), *[F.col(f"i.{c}") for c in columns])
