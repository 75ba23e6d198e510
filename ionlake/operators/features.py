"""Feature vectors: one row per peptide, charge and cleavage site, in a fixed column order.

A peptide stays one row until its sites are asked for. Peptides of one length are worked on together,
a site at a time: the sorted residues of all prefixes grow by one residue each, and so do those of the
suffixes from the other end, so no prefix is sorted anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.residues import PROPERTIES, RESIDUES

QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
N_FEATURES = {"general": 139, "ce": 140, "catboost": 143}
#: Residue-sites of peptides that are worked on together.
HELD_SITES = 1 << 20
#: Rows and bytes up to which batches are joined, so that more peptides of one length come together.
HELD_ROWS, HELD_BYTES = 1 << 16, 1 << 24

_CODES = np.full(256, -1, np.int8)
for _k, _a in enumerate(RESIDUES):
    _CODES[ord(_a)] = _k
_CODES[ord("L")] = RESIDUES.index("I")


def feature_names(version: str = "general") -> list[str]:
    names = ["length", "charge", *(f"charge_{k}" for k in ("1", "2", "3", "4", "5plus"))]
    for p in PROPERTIES:
        names += [f"{p}_q{int(q * 100)}" for q in QUANTILES]
    names += ["prefix_length", "suffix_length"]
    for a in RESIDUES:
        names += [f"n_{a}_prefix", f"n_{a}_head"]
    for p in PROPERTIES:
        names += [f"{p}_{w}" for w in ("first", "last", "before", "at", "after", "after2")]
        for side in ("prefix", "suffix"):
            names += [f"{p}_{side}_sum", *(f"{p}_{side}_q{int(q * 100)}" for q in QUANTILES)]
    if version == "ce":
        names.append("collision_energy")
    if version == "catboost":
        names = ["residue_first", "residue_last", "residue_at", "residue_after", *names]
    return names


def prefix_places(m: int) -> list[int]:
    """Where the quantiles of ``m`` sorted values stand: int(q (m - 1)), no interpolation."""
    return [int(q * (m - 1)) for q in QUANTILES]


def suffix_places(m: int) -> list[int]:
    """As prefix_places, but the inner three at int(q m)."""
    return [0, *(int(q * m) for q in QUANTILES[1:-1]), m - 1]


def _sliding(values: np.ndarray, places) -> np.ndarray:
    """[q, m - 1, column]: the values at ``places(m)`` of the first m values of each column in order.

    A value is put in order by one minimum and one maximum over what is in order already, for all columns at once.
    """
    n, columns = values.shape
    out = np.empty((len(QUANTILES), n, columns), values.dtype)
    ordered = np.empty_like(values)
    for m in range(1, n + 1):
        x = values[m - 1]
        if m == 1:
            ordered[0] = x
        else:
            low = np.minimum(ordered[: m - 1], x)
            ordered[m - 1] = np.maximum(ordered[m - 2], x)
            ordered[1 : m - 1] = np.maximum(ordered[: m - 2], low[1:])
            ordered[0] = low[0]
        for k, place in enumerate(places(m)):
            out[k, m - 1] = ordered[place]
    return out


def sliding_quantiles(values: np.ndarray, places) -> np.ndarray:
    """[row, m - 1, q]: the values at ``places(m)`` of the first m values of each row in order."""
    return _sliding(np.ascontiguousarray(values.T), places).transpose(2, 1, 0)


def _running(values: np.ndarray, kind) -> np.ndarray:
    """Running sums down the first axis, a whole row at a time."""
    out = np.empty(values.shape, kind)
    for k in range(len(values)):
        out[k] = values[k] if k == 0 else np.add(out[k - 1], values[k], dtype=kind)
    return out


def _columns(codes: np.ndarray, charge: np.ndarray, energy: np.ndarray | None, wanted):
    """(name, values) of the wanted features of peptides of one length, as [site, peptide]; one row or column where all are the same."""
    c = np.ascontiguousarray(codes.T)
    n, rows = c.shape
    site, whole_row = np.arange(n - 1)[:, None], lambda x: np.asarray(x)[None, :]
    any_of = lambda names: any(x in wanted for x in names)
    yield "length", np.array([[n]])
    yield "charge", whole_row(charge)
    for k in range(1, 5):
        yield f"charge_{k}", whole_row(charge == k)
    yield "charge_5plus", whole_row(charge >= 5)
    yield "prefix_length", site + 1
    yield "suffix_length", n - site
    counted = [k for k, a in enumerate(RESIDUES) if any_of((f"n_{a}_prefix", f"n_{a}_head"))]
    if counted:
        counts = _running(c[: n - 1, None, :] == np.array(counted, np.int8)[None, :, None], np.int16 if n < 1 << 15 else np.int32)
        for j, k in enumerate(counted):
            yield f"n_{RESIDUES[k]}_prefix", counts[:, j]
            yield f"n_{RESIDUES[k]}_head", counts[::-1, j]
    own = {p: [f"{p}_{w}" for w in ("first", "last", "before", "at", "after", "after2", "prefix_sum", "suffix_sum")] for p in PROPERTIES}
    sides = {(p, s): [f"{p}_{s}_q{int(q * 100)}" for q in QUANTILES] for p in PROPERTIES for s in ("prefix", "suffix")}
    whole = {p: [f"{p}_q{int(q * 100)}" for q in QUANTILES] for p in PROPERTIES}
    values = {p: np.array([*table, 0], np.int16)[c] for p, table in PROPERTIES.items() if any_of([*own[p], *whole[p], *sides[p, "prefix"], *sides[p, "suffix"]])}  # an unknown residue, code -1, counts as 0
    for p, v in values.items():
        yield own[p][0], v[:1]
        yield own[p][1], v[-1:]
        if any_of(own[p][2:4]):
            first = np.full((1, rows), PROPERTIES[p][0], np.int16)
            yield own[p][2], np.concatenate([np.zeros((1, rows), np.int16), first, v[: max(0, n - 3)]])[: n - 1]
            yield own[p][3], np.concatenate([first, v[: n - 2]])
        yield own[p][4], v[:-1]
        yield own[p][5], v[1:]
        if any_of(own[p][6:]):
            sums = _running(v, np.int32)
            yield own[p][6], sums[:-1]
            yield own[p][7], sums[-1:] - sums[:-1]
    # properties side by side; the longest prefix is the whole peptide
    some = [p for p in values if any_of([*whole[p], *sides[p, "prefix"]])]
    if some:
        found = _sliding(np.concatenate([values[p] for p in some], axis=1), prefix_places)
        for j, p in enumerate(some):
            own_found = found[:, :, j * rows : (j + 1) * rows]
            yield from zip(whole[p], own_found[:, n - 1 :], strict=True)
            yield from zip(sides[p, "prefix"], own_found[:, : n - 1], strict=True)
    some = [p for p in values if any_of(sides[p, "suffix"])]
    if some:
        found = _sliding(np.concatenate([values[p][:0:-1] for p in some], axis=1), suffix_places)[:, ::-1]
        for j, p in enumerate(some):
            yield from zip(sides[p, "suffix"], found[:, :, j * rows : (j + 1) * rows], strict=True)
    if energy is not None:
        yield "collision_energy", whole_row(energy)
    yield "residue_first", c[:1]
    yield "residue_last", c[-1:]
    yield "residue_at", np.concatenate([np.zeros((1, rows), np.int8), c[: n - 2]])
    yield "residue_after", c[:-1]


def feature_matrix(codes: np.ndarray, charge: np.ndarray, version: str = "general", energy: np.ndarray | None = None, only: list[int] | None = None) -> np.ndarray:
    """[peptide, site, feature] for peptides of one length; ``only`` lists the features wanted, in order."""
    rows, n = codes.shape
    names = feature_names(version)
    wanted = {names[k]: i for i, k in enumerate(range(len(names)) if only is None else only)}
    out = np.zeros((rows, n - 1, len(wanted)), np.int32)
    for name, values in _columns(codes, charge, energy, wanted):
        if name in wanted:
            out[:, :, wanted[name]] = values.T
    return out


def feature_sums(codes: np.ndarray, charge: np.ndarray, version: str, energy: np.ndarray | None, weights: np.ndarray) -> np.ndarray:
    """[weighing, peptide]: the sum of weight x feature over all sites of peptides of one length; ``weights`` is [weighing, feature]."""
    rows, n = codes.shape
    names = feature_names(version)
    own = np.flatnonzero(weights.any(axis=0))
    wanted = {names[k]: i for i, k in enumerate(own)}
    kind = np.int32 if n <= 1000 else np.int64  # a sum of sums of 343 at most
    totals = np.zeros((len(own), rows), kind)
    for name, values in _columns(codes, charge, energy, wanted):
        if name in wanted:
            totals[wanted[name]] = np.add.reduce(values, axis=0, dtype=kind) if len(values) > 1 else values[0].astype(kind) * (n - 1)
    # whole numbers below 2^53 are exact as doubles, whose product is much faster
    exact = rows and float(np.abs(weights).sum(axis=1).max(initial=0)) * float(np.abs(totals).max(initial=0)) < 1 << 53
    return (weights[:, own].astype(np.float64) @ totals.astype(np.float64)).astype(np.int64) if exact else weights[:, own] @ totals.astype(np.int64)


def merged(batches):
    """Batches joined up to HELD_ROWS rows or HELD_BYTES bytes."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
        if rows >= HELD_ROWS or size >= HELD_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_length(batch: pa.RecordBatch, column: str):
    """(rows, their bytes as a matrix) for the peptides of each length, at most HELD_SITES residues at a time."""
    text = batch.column(column).cast(pa.binary())
    lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    starts = np.frombuffer(text.buffers()[1], np.int32)[text.offset :] if len(text) else lengths
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8) if len(text) else lengths
    order = np.argsort(lengths, kind="stable")
    firsts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in zip(firsts, [*firsts[1:], len(order)], strict=True):
        n = int(lengths[order[a]])
        step = max(1, HELD_SITES // max(1, n))
        for s in range(a, b, step):
            rows = order[s : min(s + step, b)]
            yield rows, data[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0), np.uint8)


def _energy(batch: pa.RecordBatch, rows: np.ndarray, version: str) -> np.ndarray | None:
    if version != "ce":
        return None
    return batch.column("ce").cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False)[rows]


def peptide_features(batch: pa.RecordBatch, version: str, only: list[int] | None = None):
    """(rows, [peptide, site, feature]) of a batch with columns peptide and charge (and ce), length by length.

    Peptides of fewer than two residues have no site.
    """
    charge = batch.column("charge").cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False)
    for rows, letters in by_length(batch, "peptide"):
        if letters.shape[1] > 1:
            yield rows, feature_matrix(_CODES[letters], charge[rows], version, _energy(batch, rows, version), only)


def site_features(peptides: DataFrame, version: str = "general", keep: tuple[str, ...] = ("peptide", "charge"), only: set[int] | None = None) -> DataFrame:
    """(keep..., site, features array<int>), one row per site 0 to n-2.

    Site i lies behind residue i+1 (1-based): its row predicts ion i+1 of the prefix series and
    ion n-1-i of the suffix series. Models depend on four habits of the layout: quantiles are single
    elements, at int(q (n - 1)) of a prefix or the peptide but at int(q n) of a suffix; the second
    count of each residue covers the first n-1-i residues; a place before the first residue reads
    as alanine; and two places before it as 0. L reads as I. ``ce`` needs a column ce and appends it;
    ``catboost`` puts four residue codes in front. With ``only`` the other columns are 0 and cost nothing.
    """
    if version not in N_FEATURES:
        raise ValueError(f"unknown feature version {version!r}")
    width = N_FEATURES[version]
    wanted = None if only is None else sorted(only)
    more = [c for c in ("peptide", "charge", *(["ce"] if version == "ce" else [])) if c not in keep]

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            # a charge or energy of a row's own type goes on as it came
            for rows, x in peptide_features(batch, version, wanted):
                if wanted is not None:
                    full = np.zeros((*x.shape[:2], width), np.int32)
                    full[:, :, wanted] = x
                    x = full
                sites = x.shape[1]
                kept = batch.take(pa.array(np.repeat(rows, sites)))
                features = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in keep), pa.array(np.tile(np.arange(sites, dtype=np.int32), len(rows))), features], names=[*keep, "site", "features"])

    kinds = dict(peptides.dtypes)
    rows = peptides.select(*keep, *more)
    return rows.mapInArrow(apply, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", site int, features array<int>")


def site_sums(peptides: DataFrame, weights: dict[str, list[int]], version: str = "general", keep: tuple[str, ...] = ("peptide", "charge")) -> DataFrame:
    """(keep..., n_sites, a long for each weighing): the sum of weight x feature over all sites of ``site_features``.

    ``weights`` has one whole number for each feature. Sums are made where a peptide's features are, which never
    become rows; features without weight are not made. A peptide without sites has no row.
    """
    if version not in N_FEATURES or any(len(w) != N_FEATURES[version] for w in weights.values()):
        raise ValueError(f"weights have to be as many as the features of version {version!r}")
    table = np.array(list(weights.values()), np.int64)
    more = [c for c in ("peptide", "charge", *(["ce"] if version == "ce" else [])) if c not in keep]

    def apply(batches):
        for batch in merged(batches):
            n, sums = np.zeros(batch.num_rows, np.int64), np.zeros((len(table), batch.num_rows), np.int64)
            charge = batch.column("charge").cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False)
            for rows, letters in by_length(batch, "peptide"):
                if letters.shape[1] > 1:
                    n[rows] = letters.shape[1] - 1
                    sums[:, rows] = feature_sums(_CODES[letters], charge[rows], version, _energy(batch, rows, version), table)
            some = np.flatnonzero(n)
            kept = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in keep), pa.array(n[some]), *(pa.array(x[some]) for x in sums)], names=[*keep, "n_sites", *weights])

    kinds = dict(peptides.dtypes)
    return peptides.select(*keep, *more).mapInArrow(apply, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_sites long" + "".join(f", `{k}` long" for k in weights))


__all__ = ["N_FEATURES", "by_length", "feature_matrix", "feature_names", "peptide_features", "site_features", "site_sums", "sliding_quantiles"]
