"""In-silico digestion, decoys, redundancy removal and modification versions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mods import format_mods
from ..functions.residues import INVALID_RESIDUES
from ..plans.storage import stored_table

#: Where a sequence is cut, as zero-width patterns.
CLEAVAGE_RULES = {
    "trypsin": r"(?<=[KR])(?!P|$)|(?<=WK)(?=P)|(?<=MR)(?=P)",
    "trypsin_simple": r"(?<=[KR])(?!$)",
    "lysc": r"(?<=K)(?!$)",
    "argc": r"(?<=R)(?!$)",
    "gluc": r"(?<=E)(?!$)",
    "aspn": r"(?<!^)(?=D)",
    "chymotrypsin": r"(?<=[FY])(?!P|$)|(?<=W)(?![MP]|$)",
}

#: The same rules by the residues around a cut: the last but one before it, the last, the next; ``^``: any but these, blank: any.
CLEAVAGE_SITES = {
    "trypsin": (("", "KR", "^P"), ("W", "K", "P"), ("M", "R", "P")),
    "trypsin_simple": (("", "KR", ""),),
    "lysc": (("", "K", ""),),
    "argc": (("", "R", ""),),
    "gluc": (("", "E", ""),),
    "aspn": (("", "", "D"),),
    "chymotrypsin": (("", "FY", "^P"), ("", "W", "^MP")),
}
#: Bytes of short sequences that are cut together.
_RUN_BYTES = 1 << 20

#: Peptides that are cut out at a time.
_CUT_ROWS = 200_000
_BANNED = np.frombuffer(INVALID_RESIDUES.encode("utf-32-le"), np.uint32)


def _cuts(sequence: str, rule: str) -> np.ndarray:
    """Places where the rule cuts, with both ends."""
    inner = {m.start() for m in re.finditer(CLEAVAGE_RULES.get(rule, rule), sequence)} - {0, len(sequence)}
    return np.array([0, *sorted(inner), len(sequence)], np.int64)


def _spans(sequence: str, rule: str, missed: int, low: int, high: int, semi: bool):
    """(starts, ends) of the peptides of a fitting length, in parts; no (start, end) comes twice."""
    n = len(sequence)
    if rule == "unspecific":
        for length in range(low, min(high, n) + 1):
            for first in range(0, n - length + 1, _CUT_ROWS):
                starts = np.arange(first, min(first + _CUT_ROWS, n - length + 1))
                yield starts, starts + length
        return
    cuts = _cuts(sequence, rule)
    step = max(1, _CUT_ROWS // (missed + 1) // (2 * high if semi else 1))
    held = np.zeros((0, 2), np.int64)  # semi-specific spans that the next part may repeat
    for first in range(0, len(cuts) - 1, step):
        own = np.arange(first, min(first + step, len(cuts) - 1))
        pairs = [(cuts[own[own + k < len(cuts)]], cuts[own[own + k < len(cuts)] + k]) for k in range(1, missed + 2)]
        starts, ends = (np.concatenate(c) for c in zip(*pairs, strict=True))
        if not semi:
            fits = (ends - starts >= low) & (ends - starts <= high)
            yield starts[fits], ends[fits]
            continue
        lengths = np.arange(low, high + 1)
        fits = lengths[None, :] <= (ends - starts)[:, None]
        row, k = np.nonzero(fits)
        both = np.concatenate([np.stack([starts[row], starts[row] + lengths[k]], 1), np.stack([ends[row] - lengths[k], ends[row]], 1)])
        both = np.unique(both, axis=0)
        if len(held):
            old = {tuple(x) for x in held.tolist()}
            both = both[[tuple(x) not in old for x in both.tolist()]]
        # a later part's spans begin at its first cut or, as suffixes, end beyond it
        held = np.concatenate([held, both])
        held = held[held[:, 1] > cuts[own[-1] + 1]] if len(held) else held
        yield both[:, 0], both[:, 1]


def _members(letters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in letters.lstrip("^")]] = True
    return table if letters and letters[0] != "^" else ~table


def _cut_before(data: np.ndarray, first: np.ndarray, rule: str) -> np.ndarray:
    """Whether a piece begins at each residue of sequences that lie one behind the other; ``first`` marks their own beginnings."""
    cut = first.copy()
    for earlier, last, ahead in CLEAVAGE_SITES[rule]:
        found = _members(last)[data[:-1]] & _members(ahead)[data[1:]]
        if earlier:  # of the same sequence
            found[:1] = False
            found[1:] &= _members(earlier)[data[:-2]] & ~first[1:-1]
        cut[1:] |= found
    return cut


def _short_runs(sequences: pa.Array):
    """(first, last) of runs of sequences that together have at most _RUN_BYTES bytes; a longer one is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(sequences), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _RUN_BYTES, side="right")))
        yield a, b
        a = b


def _run_pieces(sequences: pa.Array, rule: str, missed: int, low: int, high: int) -> tuple[np.ndarray, ...] | None:
    """(row, start, pieces, is_n_term, is_c_term) of many sequences at once by a named rule; None if they are not plain text."""
    lengths = pc.fill_null(pc.binary_length(sequences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(sequences.drop_null().cast(pa.binary()).to_pylist()), np.uint8)
    if not len(data) or data.max() > 126 or data.min() < 32:
        return None
    ends = np.cumsum(lengths)
    first = np.zeros(len(data), bool)
    first[(ends - lengths)[lengths > 0]] = True
    bounds = np.append(np.flatnonzero(_cut_before(data, first, rule)), len(data))
    bad = _members(INVALID_RESIDUES)[data]
    held = []
    for k in range(1, missed + 2):
        starts, stops = bounds[:-k], bounds[k:]
        fits = (stops - starts >= low) & (stops - starts <= high)
        starts, stops = starts[fits], stops[fits]
        row = np.searchsorted(ends, starts, side="right")
        held.append(np.stack([row, starts, stops])[:, stops <= ends[row]])
    row, starts, stops = np.concatenate(held, axis=1)
    if bad.any():
        before = np.concatenate([[0], np.cumsum(bad)])
        good = before[stops] == before[starts]
        row, starts, stops = row[good], starts[good], stops[good]
    begin = starts - (ends - lengths)[row]
    return row, begin, _gather(data, starts, stops), begin == 0, stops == ends[row]


def _cut_out(sequence: str, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of a sequence; those of plain text are gathered byte by byte at once."""
    if not sequence.isascii():
        return pa.array([sequence[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
    return _gather(np.frombuffer(sequence.encode(), np.uint8), starts, ends)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[places]))


def _bad_before(sequence: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, how many residues of unknown mass stand before each place)."""
    codes = np.frombuffer(sequence.encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(np.isin(codes, _BANNED))])


def _windows(codes: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of ``length`` codes: equal for equal windows and no others.

    Windows grow by joining two that overlap; where the next would not fit 63 bits, they are numbered anew.
    """
    keys = codes.astype(np.int64) - int(codes.min())
    bits, width = max(1, int(keys.max()).bit_length()), 1
    numbered = 0  # how many different windows there are, once they are numbers without places
    while width < length:
        more = min(width, length - width)
        if not numbered and bits * (width + more) > 63:
            found, keys = np.unique(keys, return_inverse=True)
            numbered = len(found)
        ahead, behind = keys[: len(keys) - more], keys[more:]
        if numbered:
            found, keys = np.unique(ahead * numbered + behind, return_inverse=True)
            numbered = len(found)
        else:
            keys = (ahead >> bits * (width - more)) << bits * width | behind
        width += more
    return keys


def digest(
    proteins: DataFrame,
    rule: str = "trypsin",
    missed_cleavages: int = 2,
    min_length: int = 8,
    max_length: int = 30,
    semi_specific: bool = False,
    id_col: str = "protein",
    seq_col: str = "sequence",
) -> DataFrame:
    """(protein, start, peptide, is_n_term, is_c_term); start is 0-based.

    ``rule`` is a name in CLEAVAGE_RULES, ``unspecific`` (every substring of a fitting length) or
    a zero-width pattern. Peptides with a residue of unknown mass are dropped. Semi-specific
    digestion adds every prefix and suffix of a peptide and gives each (start, peptide) of a record once.
    A null sequence has no peptides.

    A sequence is cut once, its peptides are numbers until their length fits, and they are cut out in
    bounded parts; nothing is shuffled. Short sequences are cut together by a named rule.
    """
    if min_length < 1:
        raise ValueError("min_length must be positive")
    kind = proteins.schema[id_col].dataType.simpleString()

    def one_by_one(batch):
        held, count = [], 0
        for k, sequence in enumerate(batch.column("seq").to_pylist()):
            if not sequence:
                continue
            bad = _bad_before(sequence)[1]
            for starts, ends in _spans(sequence, rule, missed_cleavages, min_length, max_length, semi_specific):
                good = bad[ends] == bad[starts]
                starts, ends = starts[good], ends[good]
                if len(starts):
                    own = batch.column("protein").take(pa.array(np.full(len(starts), k)))
                    held.append([own, pa.array(starts.astype(np.int32)), _cut_out(sequence, starts, ends), pa.array(starts == 0), pa.array(ends == len(sequence))])
                    count += len(starts)
            if count >= _CUT_ROWS:
                yield _one_batch(held)
                held, count = [], 0
        if held:
            yield _one_batch(held)

    def apply(batches):
        for batch in batches:
            for first, last in _short_runs(batch.column("seq")):
                own, pieces = batch.slice(first, last - first), None
                if rule in CLEAVAGE_SITES and not semi_specific and (last - first > 1 or len(own.column("seq")[0].as_py() or "") <= _RUN_BYTES):
                    pieces = _run_pieces(own.column("seq"), rule, missed_cleavages, min_length, max_length)
                if pieces is None:
                    yield from one_by_one(own)
                elif len(pieces[0]):
                    row, start, peptide, is_n, is_c = pieces
                    yield _one_batch([[own.column("protein").take(pa.array(row)), pa.array(start.astype(np.int32)), peptide, pa.array(is_n), pa.array(is_c)]])

    rows = proteins.select(F.col(id_col).alias("protein"), F.upper(F.col(seq_col)).alias("seq"))
    return rows.mapInArrow(apply, f"protein {kind}, start int, peptide string, is_n_term boolean, is_c_term boolean")


def _one_batch(parts: list[list[pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], names=["protein", "start", "peptide", "is_n_term", "is_c_term"])


def by_repeats(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose ``key`` occurs once, the others or None); null counts as repeated. Keys are counted eagerly."""
    again = stored_table(rows.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or _again is null").select("_again"), "repeated")
    if again.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("_again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def peptide_counts(
    proteins: DataFrame,
    rule: str = "trypsin",
    missed_cleavages: int = 2,
    min_length: int = 8,
    max_length: int = 30,
    semi_specific: bool = False,
    id_col: str = "protein",
    seq_col: str = "sequence",
) -> DataFrame:
    """(protein, n, n_distinct, sum_start) of each protein's ``digest``; a protein without peptides has no row.

    Peptides are counted where their sequence lies, as numbers, and never leave it. Only proteins that stand
    in several rows are digested to peptides, as these may be the same in two rows.
    """
    if min_length < 1:
        raise ValueError("min_length must be positive")
    kind = proteins.schema[id_col].dataType.simpleString()

    def counts(sequence: str) -> tuple[int, int, int]:
        codes, bad = _bad_before(sequence)
        held: dict[int, list[np.ndarray]] = {}
        for starts, ends in _spans(sequence, rule, missed_cleavages, min_length, max_length, semi_specific):
            good = bad[ends] == bad[starts]
            starts, lengths = starts[good], (ends - starts)[good]
            for length in np.unique(lengths).tolist():
                held.setdefault(length, []).append(starts[lengths == length])
        n = distinct = total = 0
        for length, parts in held.items():
            starts = np.concatenate(parts)
            keys = np.sort(_windows(codes, length)[starts])
            n, distinct, total = n + len(starts), distinct + 1 + int(np.count_nonzero(keys[1:] != keys[:-1])), total + int(starts.sum())
        return n, distinct, total

    def apply(batches):
        for batch in batches:
            found = np.array([counts(x) if x else (0, 0, 0) for x in batch.column("seq").to_pylist()], np.int64).reshape(-1, 3)
            some = np.flatnonzero(found[:, 0])
            own = batch.column("protein").take(pa.array(some))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(found[some, k]) for k in range(3))], names=["protein", "n", "n_distinct", "sum_start"])

    once, repeated = by_repeats(proteins, id_col)
    rows = once.select(F.col(id_col).alias("protein"), F.upper(F.col(seq_col)).alias("seq"))
    counted = rows.mapInArrow(apply, f"protein {kind}, n long, n_distinct long, sum_start long")
    if repeated is None:
        return counted
    found = digest(repeated, rule, missed_cleavages, min_length, max_length, semi_specific, id_col, seq_col)
    return counted.unionByName(found.groupBy("protein").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("n_distinct"), F.sum("start").alias("sum_start")))


def with_decoys(proteins: DataFrame, id_col: str = "protein", seq_col: str = "sequence", prefix: str = "DECOY_") -> DataFrame:
    """Targets, and each one reversed behind its first residue; ``is_decoy`` tells them apart."""
    seq = F.col(seq_col)
    decoy = F.concat(F.substring(seq, 1, 1), F.reverse(F.substring(seq, F.lit(2), F.char_length(seq))))
    targets = proteins.withColumn("is_decoy", F.lit(False))
    decoys = proteins.withColumns({seq_col: decoy, id_col: F.concat(F.lit(prefix), F.col(id_col)), "is_decoy": F.lit(True)})
    return targets.unionByName(decoys)


def peptide_proteins(peptides: DataFrame) -> DataFrame:
    """(peptide, protein, first): each pair once, with the smallest start and its flags; rows, not lists."""
    return peptides.groupBy("peptide", "protein").agg(F.min(F.struct("start", "is_n_term", "is_c_term")).alias("first"))


def unique_peptides(peptides: DataFrame) -> DataFrame:
    """One row per sequence: peptide, n_proteins, protein (the smallest) and the flags of its first place.

    The first place is the smallest (protein, start). Proteins are counted from distinct pairs, so a peptide
    of all proteins is no larger than any other; with_proteins adds the list where one is written.
    """
    at = F.struct("protein", F.col("first.start").alias("start"))
    return peptide_proteins(peptides).groupBy("peptide").agg(
        F.count(F.lit(1)).alias("n_proteins"), F.min("protein").alias("protein"), F.min_by("first.is_n_term", at).alias("is_n_term"), F.min_by("first.is_c_term", at).alias("is_c_term")
    )


def with_proteins(rows: DataFrame, peptides: DataFrame, out: str = "proteins") -> DataFrame:
    """``rows`` with the sorted list of their peptide's proteins: for sinks, whose lines hold such lists."""
    lists = peptides.select("peptide", "protein").distinct().groupBy("peptide").agg(F.sort_array(F.collect_list("protein")).alias(out))
    return rows.join(lists, "peptide", "left")


@dataclass(frozen=True)
class LibraryModification:
    """A modification of a spectral library: where it may be, and whether it always is."""

    name: str
    mass_shift: float
    amino_acid: str | None = None
    peptide_n_term: bool = False
    protein_n_term: bool = False
    peptide_c_term: bool = False
    protein_c_term: bool = False
    fixed: bool = False
    unimod_accession: int | None = None

    def __post_init__(self):
        if not (self.amino_acid or self.terminus):
            raise ValueError(f"modification {self.name} needs a residue or a terminus")

    @property
    def terminus(self) -> str | None:
        return next((t for t in ("peptide_n_term", "peptide_c_term", "protein_n_term", "protein_c_term") if getattr(self, t)), None)


def modified_residues(peptide: Column, mods: list[LibraryModification]) -> Column:
    """The residues, each once, that occur in the peptide and take a modification of the list."""
    taken = [F.lit(a) for a in sorted({m.amino_acid for m in mods if m.terminus is None and m.amino_acid})]
    return F.array_intersect(F.filter(F.split(peptide, ""), lambda c: c != ""), F.array(*taken).cast("array<string>"))


def modification_versions(peptide: Column, is_n_term: Column, is_c_term: Column, mods: list[LibraryModification], max_variable: int = 3) -> Column:
    """array<string>: every modification string a peptide can have; ``-`` is the bare one.

    Sites take one of their variable modifications or none; a fixed one overrides them. Versions
    with more than ``max_variable`` variable modifications are cut off while sites are combined,
    so the product never grows beyond what is returned.
    """
    option = "struct<pos:int,name:string,variable:int>"
    letters = F.filter(F.split(peptide, ""), lambda c: c != "")

    def options(names, pos, variable):
        made = [F.struct(pos.cast("int").alias("pos"), F.lit(n).alias("name"), F.lit(variable).alias("variable")) for n in names]
        return F.array(*made).cast(f"array<{option}>")

    none = F.array().cast(f"array<{option}>")
    side_var, side_fix = {}, {}
    for m in mods:
        if m.terminus is None:
            (side_fix if m.fixed else side_var).setdefault(m.amino_acid, []).append(m.name)
    optional = lambda own: F.concat(F.array(F.lit(None).cast(option)), own)

    def residue(c, i):
        # of several fixed modifications on a residue the last one stays
        found = none
        for aa, names in side_var.items():
            if aa not in side_fix:
                found = F.when(c == aa, optional(options(names, i + 1, 1))).otherwise(found)
        for aa, names in side_fix.items():
            found = F.when(c == aa, options(names[-1:], i + 1, 0)).otherwise(found)
        return found

    sites = F.filter(F.transform(letters, residue), lambda s: F.size(s) > 0)
    for ends, pos, edge in ((("peptide_n_term", "protein_n_term"), 0, F.substring(peptide, 1, 1)), (("peptide_c_term", "protein_c_term"), -1, F.substring(peptide, -1, 1))):
        variable, fixed = none, none
        for m in mods:
            if m.terminus not in ends:
                continue
            fits = F.lit(True) if m.amino_acid is None else edge == m.amino_acid
            if m.terminus.startswith("protein"):
                fits = fits & (is_n_term if pos == 0 else is_c_term)
            own = options([m.name], F.lit(pos), 0 if m.fixed else 1)
            if m.fixed:
                fixed = F.when(fits, own).otherwise(fixed)
            else:
                variable = F.concat(variable, F.when(fits, own).otherwise(none))
        site = F.when(F.size(fixed) > 0, fixed).when(F.size(variable) > 0, optional(variable)).otherwise(none)
        sites = F.concat(sites, F.filter(F.array(site), lambda s: F.size(s) > 0))

    start = F.array(F.struct(none.alias("mods"), F.lit(0).alias("used")))

    def extend(acc, site):
        grown = F.flatten(
            F.transform(
                acc,
                lambda v: F.transform(
                    site,
                    lambda o: F.struct(
                        F.when(o.isNull(), v["mods"]).otherwise(F.array_append(v["mods"], o)).alias("mods"), (v["used"] + F.coalesce(o["variable"], F.lit(0))).alias("used")
                    ),
                ),
            )
        )
        return F.filter(grown, lambda v: v["used"] <= max_variable)

    combined = F.aggregate(sites, start, extend)
    return F.array_distinct(F.transform(combined, lambda v: format_mods(F.transform(v["mods"], lambda m: F.struct(m["pos"].alias("pos"), m["name"].alias("name"))))))


def peptidoforms(peptides: DataFrame, mods: list[LibraryModification], charges: list[int], max_variable: int = 3) -> DataFrame:
    """peptides x modification versions x charges, with an id from their content.

    ``spec_id`` is the 128-bit hash of peptide, modifications and charge: the same in every run
    and unique without a global counter.
    """
    versions = modification_versions(F.col("peptide"), F.col("is_n_term"), F.col("is_c_term"), mods, max_variable)
    rows = peptides.withColumn("modifications", F.explode(versions)).withColumn("charge", F.explode(F.array(*[F.lit(z) for z in charges])))
    return rows.withColumn("spec_id", F.md5(F.concat_ws("/", "peptide", "modifications", F.col("charge").cast("string"))))
