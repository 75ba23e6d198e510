"""Configuration files and the registry of models."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from ..functions.mods import Catalogue, InvalidModification
from ..functions.residues import PEAK_VERSIONS
from ..operators.digest import LibraryModification


class UnsupportedConfig(ValueError):
    """A configuration file of an unknown kind or with unknown keys."""


class UnknownModel(ValueError):
    """A model name that the registry does not have."""


class ModelIntegrityError(ValueError):
    """A model file that does not match its checksum."""


@dataclass(frozen=True)
class Model:
    name: str
    number: int
    version: str = "general"

    @property
    def ions(self) -> list[str]:
        return PEAK_VERSIONS[self.version]


# Model names with their numbers, and aliases.
MODELS = {
    m.name: m
    for m in (
        Model("CID", 0),
        Model("HCD2019", 1),
        Model("TTOF5600", 2),
        Model("TMT", 3),
        Model("iTRAQ", 4),
        Model("iTRAQphospho", 5),
        Model("HCDch2", 7, "ch2"),
        Model("CIDch2", 8, "ch2"),
        Model("HCD2021", 9),
        Model("Immuno-HCD", 10),
        Model("CID-TMT", 11),
        Model("timsTOF2023", 12),
        Model("timsTOF2024", 13),
    )
}
ALIASES = {"HCD": "HCD2021", "timsTOF": "timsTOF2024"}
#: Reporter ions that models of labelled peptides leave out.
LABELS = {"iTRAQ": "iTRAQ", "iTRAQphospho": "iTRAQ", "TMT": "TMT", "CID-TMT": "TMT"}


def model(name: str) -> Model:
    found = MODELS.get(ALIASES.get(name, name))
    if found is None:
        raise UnknownModel(f"unknown model {name!r}; known are {sorted(MODELS) + sorted(ALIASES)}")
    return found


def check_sha1(path: str, expected: str) -> None:
    with open(path, "rb") as f:
        got = hashlib.file_digest(f, "sha1").hexdigest()
    if got != expected:
        raise ModelIntegrityError(f"{path} has SHA-1 {got}, not {expected}")


@dataclass
class PredictionConfig:
    model: str = "HCD"
    frag_error: float = 0.02
    out: list[str] = field(default_factory=lambda: ["csv"])
    ptm: list[str] = field(default_factory=list)
    sptm: list[str] = field(default_factory=list)
    gptm: list[str] = field(default_factory=list)
    model_dir: str | None = None

    def catalogue(self) -> Catalogue:
        return Catalogue.parse(self.ptm) + Catalogue.parse(self.sptm, "sptm")


def _parse_text(text: str) -> dict:
    """``key=value`` lines, split once; ptm, sptm and gptm may repeat; ``#`` starts a comment."""
    out: dict = {"ptm": [], "sptm": [], "gptm": []}
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        key, equals, value = line.partition("=")
        if not equals:
            raise UnsupportedConfig(f"not a key=value line: {line!r}")
        key, value = key.strip(), value.strip()
        if key in ("ptm", "sptm", "gptm"):
            out[key].append(value)
        elif key == "frag_error":
            out[key] = float(value)
        elif key == "out":
            out[key] = [x.strip() for x in value.split(",")]
        else:
            out[key] = value
    return out


def load_config(path: str) -> PredictionConfig:
    """From a .txt, .config, .toml or .json file; TOML and JSON may hold the keys in one section."""
    suffix, text = Path(path).suffix.lower(), Path(path).read_text()
    if suffix == ".toml":
        values = tomllib.loads(text)
    elif suffix == ".json":
        values = json.loads(text)
    elif suffix in (".txt", ".config", ".cfg"):
        values = _parse_text(text)
    else:
        raise UnsupportedConfig(f"{path}: configuration files end in .txt, .config, .cfg, .toml or .json")
    if len(values) == 1 and isinstance(next(iter(values.values())), dict):
        values = next(iter(values.values()))
    if "frag_method" in values:  # an older name of the key
        values.setdefault("model", values.pop("frag_method"))
    known = {f.name for f in fields(PredictionConfig)}
    if unknown := set(values) - known:
        raise UnsupportedConfig(f"{path}: unknown keys {sorted(unknown)}")
    if isinstance(values.get("out"), str):
        values["out"] = [x.strip() for x in values["out"].split(",")]
    return PredictionConfig(**values)


def write_toml(config: PredictionConfig, path: str) -> None:
    def value(v):
        return json.dumps(v)

    lines = [f"{f.name} = {value(getattr(config, f.name))}" for f in fields(config) if getattr(config, f.name) is not None]
    Path(path).write_text("\n".join(lines) + "\n")


@dataclass
class LibraryConfig:
    """Settings of a library made from proteins."""

    min_length: int = 8
    max_length: int = 30
    cleavage_rule: str = "trypsin"
    missed_cleavages: int = 2
    semi_specific: bool = False
    charges: list[int] = field(default_factory=lambda: [2, 3])
    min_precursor_mz: float | None = None
    max_precursor_mz: float | None = None
    max_variable_modifications: int = 3
    modifications: list[LibraryModification] = field(default_factory=lambda: [LibraryModification("Oxidation", 15.994915, "M"), LibraryModification("Carbamidomethyl", 57.021464, "C", fixed=True)])
    add_decoys: bool = False
    model: str = "HCD"
    output_filetypes: list[str] = field(default_factory=lambda: ["msp"])

    def __post_init__(self):
        from ..sinks.libraries import SINKS

        self.modifications = [m if isinstance(m, LibraryModification) else LibraryModification(**m) for m in self.modifications]
        if unknown := set(self.output_filetypes) - SINKS.keys():
            raise UnsupportedConfig(f"unknown output formats {sorted(unknown)}")
        if not 0 < self.min_length <= self.max_length:
            raise UnsupportedConfig("lengths must be positive, the smallest first")
        model(self.model)

    @classmethod
    def load(cls, path: str) -> LibraryConfig:
        values = json.loads(Path(path).read_text())
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise UnsupportedConfig(f"{path}: unknown keys {sorted(unknown)}")
        return cls(**values)

    def catalogue(self) -> Catalogue:
        def site(m: LibraryModification) -> str:
            if m.terminus is None:
                return m.amino_acid
            return "N-term" if m.terminus.endswith("n_term") else "C-term"

        return Catalogue.parse([f"{m.name},{m.mass_shift},opt,{site(m)}" for m in self.modifications])


__all__ = ["InvalidModification", "LibraryConfig", "Model", "PredictionConfig", "check_sha1", "load_config", "model", "write_toml"]
