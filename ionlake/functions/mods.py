"""Modification strings: ``pos|name|pos|name``, 0 the N-terminus, -1 the C-terminus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .residues import FRAGMENT_MASS

_ONE = r"(-1|[0-9]{1,2})\|[^|\s]+"
#: Blank, ``-``, or position|name pairs; a bar may end the string.
MOD_STRING = rf"^(-|({_ONE}(\|{_ONE})*\|?)?)$"
SEQUENCE = r"^[ACDEFGHIKLMNPQRSTVWY]{3,99}$"


class InvalidModification(ValueError):
    """A modification definition or string that cannot be read."""


class UnknownModification(InvalidModification):
    """A modification name that the catalogue does not have."""


@dataclass(frozen=True)
class Modification:
    """``site``: a residue, ``N-term`` or ``C-term``."""

    name: str
    mass_shift: float
    site: str
    kind: str = "ptm"

    @classmethod
    def parse(cls, text: str, kind: str = "ptm") -> Modification:
        """From ``name,mass_shift,opt,site``."""
        parts = text.split(",")
        if len(parts) != 4:
            raise InvalidModification(f"expected name,mass_shift,opt,site: {text!r}")
        name, shift, _, site = (p.strip() for p in parts)
        if site not in ("N-term", "C-term") and (len(site) != 1 or site not in FRAGMENT_MASS):
            raise InvalidModification(f"unknown site {site!r} in {text!r}")
        return cls(name, float(shift), site, kind)


@dataclass(frozen=True)
class Catalogue:
    mods: tuple[Modification, ...] = ()

    @classmethod
    def parse(cls, texts: list[str], kind: str = "ptm") -> Catalogue:
        return cls(tuple(Modification.parse(t, kind) for t in texts))

    def __add__(self, other: Catalogue) -> Catalogue:
        return Catalogue(self.mods + other.mods)

    def shifts(self) -> Column:
        return self._map({m.name: m.mass_shift for m in self.mods})

    def slots(self) -> dict[str, float]:
        """Mass that replaces the residue's: the configured residue plus the shift; a terminus has the shift alone."""
        return {m.name: FRAGMENT_MASS.get(m.site, 0.0) + m.mass_shift for m in self.mods}

    def slot_masses(self) -> Column:
        return self._map(self.slots())

    @staticmethod
    def _map(values: dict[str, float]) -> Column:
        if not values:
            return F.create_map().cast("map<string,double>")
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def blank_mods(mods: Column) -> Column:
    """Null and empty become ``-``."""
    return F.coalesce(F.nullif(mods, F.lit("")), F.lit("-"))


def parse_mods(mods: Column) -> Column:
    """array<struct<pos int, name string>>; empty for ``-``, an error on an odd number of fields."""
    fields = F.split(mods, r"\|")
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(fields).cast("int") - 2, F.lit(2)),
        lambda i: F.struct(F.get(fields, i).cast("int").alias("pos"), F.get(fields, i + 1).alias("name")),
    )
    blank = F.array().cast("array<struct<pos:int,name:string>>")
    odd = F.raise_error(F.concat(F.lit("modification string has an odd number of fields: "), mods)).cast("array<struct<pos:int,name:string>>")
    none = mods.isNull() | mods.isin("-", "")
    return F.when(none, blank).when(F.size(fields) % 2 == 1, odd).otherwise(pairs)


def format_mods(pairs: Column) -> Column:
    """The string of pairs, sorted by position with -1 last; ``-`` if none."""
    keyed = F.transform(pairs, lambda m: F.struct(F.when(m["pos"] == -1, 1 << 30).otherwise(m["pos"]).alias("k"), m["pos"].alias("pos"), m["name"].alias("name")))
    joined = F.array_join(F.transform(F.sort_array(keyed), lambda m: F.concat(m["pos"].cast("string"), F.lit("|"), m["name"])), "|")
    return F.when(F.size(pairs) == 0, "-").otherwise(joined)


def named_count(pairs: Column, name: str) -> Column:
    """How many of the pairs have this name, such as the alkylated residues of a peptide."""
    return F.size(F.filter(pairs, lambda m: m["name"] == name))


def shift_total(pairs: Column, catalogue: Catalogue) -> Column:
    shifts = catalogue.shifts()
    return F.aggregate(pairs, F.lit(0.0), lambda a, m: a + F.try_element_at(shifts, m["name"]))


def modified_masses(masses: Column, pairs: Column, catalogue: Catalogue) -> tuple[Column, Column, Column]:
    """(residue masses with modified ones replaced, N-terminal mass, C-terminal mass).

    Of several modifications at a place the last counts. An unknown name gives null.
    """
    slots = catalogue.slot_masses()

    def at(pos):
        own = F.filter(pairs, lambda m: m["pos"] == pos)
        return F.when(F.size(own) > 0, F.try_element_at(slots, F.element_at(own, -1)["name"]))

    def has(pos):
        return F.exists(pairs, lambda m: m["pos"] == pos)

    replaced = F.when(F.size(pairs) == 0, masses).otherwise(F.transform(masses, lambda x, i: F.when(has(i + 1), at(i + 1)).otherwise(x)))
    end = lambda pos: F.when(has(F.lit(pos)), at(F.lit(pos))).otherwise(F.lit(0.0))
    return replaced, end(0), end(-1)


def msp_mods(peptide: Column, pairs: Column) -> Column:
    """``n/pos,residue,name/...`` with 0-based positions, N-terminus 0; ``0`` if none.

    A C-terminal modification is put on the last residue.
    """
    n = F.char_length(peptide)
    moved = F.transform(
        pairs,
        lambda m: F.struct(F.when(m["pos"] == 0, 0).when(m["pos"] == -1, n - 1).otherwise(m["pos"] - 1).alias("pos"), m["name"].alias("name")),
    )
    each = F.transform(F.sort_array(moved), lambda m: F.concat_ws(",", m["pos"].cast("string"), F.substring(peptide, m["pos"] + 1, F.lit(1)), m["name"]))
    return F.when(F.size(pairs) == 0, "0").otherwise(F.concat_ws("/", F.size(pairs).cast("string"), F.array_join(each, "/")))


def signed_decimal(value: Column, precision: int) -> Column:
    """``+16.0`` from 15.99: a sign and ``precision`` decimals."""
    return F.format_string(f"%+.{precision}f", value)


def diff_sequence(peptide: Column, pairs: Column, catalogue: Catalogue, precision: int = 1) -> Column:
    """``M[+16.0]AS``: shifts behind their residues; termini are put on the first and last residue."""
    shifts, n = catalogue.shifts(), F.char_length(peptide)
    placed = F.transform(pairs, lambda m: F.struct(F.when(m["pos"] == 0, 1).when(m["pos"] == -1, n).otherwise(m["pos"]).alias("pos"), m["name"].alias("name")))
    cells = F.transform(
        F.filter(F.split(peptide, ""), lambda c: c != ""),
        lambda c, i: F.concat(
            c,
            F.array_join(
                F.transform(F.filter(placed, lambda m: m["pos"] == i + 1), lambda m: F.concat(F.lit("["), signed_decimal(F.try_element_at(shifts, m["name"]), precision), F.lit("]"))),
                "",
            ),
        ),
    )
    return F.when(F.size(pairs) == 0, peptide).otherwise(F.array_join(cells, ""))


def bracket_ids(peptide: Column, pairs: Column, ids: dict[str, int]) -> Column:
    """Accession notation: ``[unimod:35]M`` in front of the residue; -1 goes to the last residue."""
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    n = F.char_length(peptide)
    placed = F.transform(pairs, lambda m: F.struct(F.when(m["pos"] == 0, 1).when(m["pos"] == -1, n).otherwise(m["pos"]).alias("pos"), m["name"].alias("name")))
    cells = F.transform(
        F.filter(F.split(peptide, ""), lambda c: c != ""),
        lambda c, i: F.concat(
            F.array_join(F.transform(F.filter(placed, lambda m: m["pos"] == i + 1), lambda m: F.concat(F.lit("[unimod:"), F.try_element_at(table, m["name"]).cast("string"), F.lit("]"))), ""),
            c,
        ),
    )
    return F.array_join(cells, "")


def add_fixed(peptide: Column, pairs: Column, fixed: dict[str, str], n_term: str | None = None, c_term: str | None = None) -> Column:
    """``pairs`` with the fixed modification of every matching residue (and terminus) added."""
    cells = F.filter(F.split(peptide, ""), lambda c: c != "")
    kind = "array<struct<pos:int,name:string>>"
    found = pairs
    if fixed:
        table = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
        here = F.transform(cells, lambda c, i: F.struct((i + 1).cast("int").alias("pos"), F.try_element_at(table, c).alias("name")))
        found = F.concat(found, F.filter(here, lambda m: m["name"].isNotNull()))
    for pos, name in ((0, n_term), (-1, c_term)):
        if name:
            found = F.concat(found, F.array(F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"))))
    return F.array_distinct(found.cast(kind))


def _fixed_strings(peptides: pa.Array, fixed: dict[str, str]) -> pa.Array:
    text = peptides.cast(pa.string())
    lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(text.drop_null().cast(pa.binary()).to_pylist()), np.uint8)
    kind = np.full(256, -1, np.int16)
    for k, residue in enumerate(fixed):
        kind[ord(residue)] = k
    at = np.flatnonzero(kind[data] >= 0)
    ends = np.cumsum(lengths)
    row = np.searchsorted(ends, at, side="right")
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    pos = place[at] - place[(ends - lengths)[row]] + 1
    names = pa.array(list(fixed.values()), pa.string()).take(pa.array(kind[data[at]]))
    each = pc.binary_join_element_wise(pa.array(pos).cast(pa.string()), names, "|")
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(text) + 1)), pa.int32()), each)
    joined = pc.binary_join(lists, "|")
    return pc.if_else(text.is_null(), pa.scalar(None, pa.string()), pc.if_else(pc.equal(joined, ""), "-", joined))


def fixed_mods(peptide: Column, fixed: dict[str, str]) -> Column:
    """``format_mods(add_fixed(peptide, none, fixed))`` in Arrow batches, for residues of one ASCII letter.

    Not deterministic to the planner, so that a filter on the string does not make it a second time.
    """

    @F.arrow_udf("string")
    def make(peptides: pa.Array) -> pa.Array:
        return _fixed_strings(peptides, fixed)

    return make.asNondeterministic()(peptide)


def residue_suffix(peptide: Column, pairs: Column, name: str, residues: str = "STY") -> Column:
    """``name`` becomes ``nameS``, ``nameT``, ... by the residue at its position."""
    def rename(m):
        residue = F.substring(peptide, m["pos"], F.lit(1))
        return F.struct(m["pos"].alias("pos"), F.when((m["name"] == name) & residue.isin(*residues), F.concat(m["name"], residue)).otherwise(m["name"]).alias("name"))

    return F.transform(pairs, rename)


def tagged_to_mods(modified: Column, names: dict[str, str]) -> Column:
    """``_(ac)M(ox)K_`` style sequences with two-letter tags to (pos, name) pairs; underscores go first.

    Each tag is four characters; a tag's position is the residue before it (0: N-terminus).
    """
    clean = F.regexp_replace(modified, "_", "")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.split(clean, r"\(")
    tags = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.substring(p, 1, 2))
    lengths = F.transform(parts, lambda p, i: F.when(i == 0, F.char_length(p)).otherwise(F.char_length(p) - 3))
    return F.transform(
        tags,
        lambda t, i: F.struct(F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, x: a + x).alias("pos"), F.try_element_at(table, t).alias("name")),
    )
