"""Residue tables and ion constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue order, masses and physico-chemical properties that results depend on.
RESIDUES = "ACDEFGHIKMNPQRSTVWY"
FRAGMENT_MASS = {
    "A": 71.037114,
    "C": 103.00919,
    "D": 115.026943,
    "E": 129.042593,
    "F": 147.068414,
    "G": 57.021464,
    "H": 137.058912,
    "I": 113.084064,
    "K": 128.094963,
    "L": 113.084064,
    "M": 131.040485,
    "N": 114.042927,
    "P": 97.052764,
    "Q": 128.058578,
    "R": 156.101111,
    "S": 87.032028,
    "T": 101.047679,
    "V": 99.068414,
    "W": 186.079313,
    "Y": 163.063329,
}
PRECURSOR_MASS = {
    "A": 71.03711,
    "C": 103.00919,
    "D": 115.02694,
    "E": 129.04259,
    "F": 147.06841,
    "G": 57.02146,
    "H": 137.05891,
    "I": 113.08406,
    "K": 128.09496,
    "L": 113.08406,
    "M": 131.04049,
    "N": 114.04293,
    "P": 97.05276,
    "Q": 128.05858,
    "R": 156.10111,
    "S": 87.03203,
    "T": 101.04768,
    "V": 99.06841,
    "W": 186.07931,
    "Y": 163.06333,
}
BASICITY = [37, 35, 59, 129, 94, 0, 210, 81, 191, 106, 101, 117, 115, 343, 49, 90, 60, 134, 104]
HELICITY = [68, 23, 33, 29, 70, 58, 41, 73, 32, 66, 38, 0, 40, 39, 44, 53, 71, 51, 55]
HYDROPHOBICITY = [51, 75, 25, 35, 100, 16, 3, 94, 0, 82, 12, 0, 22, 22, 21, 39, 80, 98, 70]
ISOELECTRIC = [32, 23, 0, 4, 27, 32, 48, 32, 69, 29, 26, 35, 28, 79, 29, 28, 31, 31, 28]
PROPERTIES = {"basicity": BASICITY, "helicity": HELICITY, "hydrophobicity": HYDROPHOBICITY, "pI": ISOELECTRIC}
INVALID_RESIDUES = "BJOUXZ"
WATER = 2 * 1.00782503207 + 15.99491461956
HYDROGEN = 1.007825032070059
PROTON = 1.007236
# Mass added to the prefix (b-like) or suffix (y-like) residue sum, and the charge.
ION_SERIES = {
    "B": ("prefix", 1.007236, 1),
    "Y": ("suffix", 18.0105647 + 1.007236, 1),
    "B2": ("prefix", 2 * 1.007236, 2),
    "Y2": ("suffix", 18.0105647 + 2 * 1.007236, 2),
    "C": ("prefix", 1.007825032 + 17.0265491, 1),
    "Z": ("suffix", 17.00273965 - 15.01089904 + 1.007825032, 1),
}
# Offsets of the neutral-loss and side series from the B and Y series.
SIDE_SERIES = {
    "A": ("B", -27.99492),
    "B-H2O": ("B", -18.010565),
    "B-NH3": ("B", -17.026001),
    "C": ("B", 17.02654),
    "Y-H2O": ("Y", -18.010565),
    "Z": ("Y", -17.02545),
    "X": ("Y", 25.97926),
}
PEAK_VERSIONS = {"general": ["B", "Y"], "etd": ["B", "Y", "C", "Z"], "ch2": ["B", "Y", "B2", "Y2"]}
# Retention-time calibration peptides (iRT).
IRT_PEPTIDES = [
    ("LGGNEQVTR", -24.92),
    ("GAGSSEPVTGLDAK", 0.00),
    ("VEATFGVDESNAK", 12.39),
    ("YILAGVENSK", 19.79),
    ("TPVISGGPYEYR", 28.71),
    ("TPVITGAPYEYR", 33.38),
    ("DGLDAASYYAPVR", 42.26),
    ("ADVTPADFSEWSK", 54.62),
    ("GTFIIDPGGVIR", 70.52),
    ("GTFIIDPAAVIR", 87.23),
    ("LFLQFGAQGSPFLK", 100.00),
]
REPORTER_RANGES = {"iTRAQ": (113.0, 118.0), "TMT": (125.0, 132.0)}
#: log2 of the pseudo-count that stands for a missing peak.
PSEUDO = 0.001


def by_letter(values: dict[str, float], default: float | None = None) -> Column:
    """An array literal with one slot for each letter A to Z."""
    return F.array(*[F.lit(values.get(chr(k), default)).cast("double") for k in range(65, 91)])


def letters(peptide: Column) -> Column:
    return F.filter(F.split(peptide, ""), lambda c: c != "")


def residue_masses(peptide: Column, table: dict[str, float] = FRAGMENT_MASS) -> Column:
    """The residues' masses; null for a letter that has none."""
    held = by_letter(table)
    return F.transform(letters(peptide), lambda c: F.get(held, F.ascii(c) - 65))


def residue_codes(peptide: Column) -> Column:
    """0-based codes in RESIDUES after L is read as I."""
    codes = F.array(*[F.lit(RESIDUES.find(chr(k))) for k in range(65, 91)])
    return F.transform(letters(F.translate(peptide, "L", "I")), lambda c: F.get(codes, F.ascii(c) - 65))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
