"""Run configuration: a TOML file with general, ibf and hibf sections. Driver-side only."""

import logging
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

log = logging.getLogger("kmerloom")


@dataclass(frozen=True)
class FlatFilter:
    """Size of a flat Bloom filter; the index is exact, so this only feeds reports."""

    hash_functions: int = 3
    fpr: float = 0.01

    def __post_init__(self):
        _within("ibf.hash_functions", self.hash_functions, 1, 32)
        if not 0 < self.fpr <= 0.5:
            raise ValueError("ibf.fpr must be > 0 and <= 0.5")


@dataclass(frozen=True)
class LayeredFilter:
    """Layout of a hierarchical filter; accepted, checked and without effect on an exact index."""

    hash_functions: int = 2
    maximum_fpr: float = 0.05
    relaxed_fpr: float = 0.3
    threads: int = 0
    sketch_bits: int = 12
    tmax: int = 0
    empty_bin_fraction: float = 0.0
    alpha: float = 1.2
    max_rearrangement_ratio: float = 0.5
    disable_estimate_union: bool = False
    disable_rearrangement: bool = False

    def __post_init__(self):
        _within("hibf.hash_functions", self.hash_functions, 1, 5)
        _within("hibf.sketch_bits", self.sketch_bits, 5, 32)
        for name in ("maximum_fpr", "relaxed_fpr"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"hibf.{name} must be > 0 and < 1")
        for name in ("empty_bin_fraction", "max_rearrangement_ratio"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"hibf.{name} must be between 0 and 1")
        _within("hibf.threads", self.threads, 0, 1 << 31)
        _within("hibf.tmax", self.tmax, 0, 1 << 31)


@dataclass(frozen=True)
class Config:
    ref_dir: str = ""
    query_file: str = ""
    output_dir: str = "."
    output_file: str = ""
    log_file: str = ""
    index_method: str = "ibf"
    fragment_size: int = 0
    kmer_size: int = 14
    hit_threshold: int = 0
    store_fragments: bool = False
    store_index: bool = False
    cleanup_index: bool = False
    single_results_writer: bool = True
    threads: int = 0
    ibf: FlatFilter = field(default_factory=FlatFilter)
    hibf: LayeredFilter = field(default_factory=LayeredFilter)

    def __post_init__(self):
        for name in ("ref_dir", "query_file"):
            if not getattr(self, name):
                raise ValueError(f"missing required key: {name}")
        if self.index_method not in ("ibf", "hibf"):
            raise ValueError("index_method must be ibf or hibf")
        if self.fragment_size < 4:
            raise ValueError("fragment_size must be >= 4")
        _within("kmer_size", self.kmer_size, 1, 32)
        if self.kmer_size > self.fragment_size:
            raise ValueError("kmer_size must be > 0 and <= fragment_size")
        _within("hit_threshold", self.hit_threshold, 0, 1 << 63)
        _within("threads", self.threads, 0, 1 << 31)


def _within(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


def _section(kind: type, given: dict, name: str):
    known = {f.name: f.type for f in fields(kind)}
    for key, value in given.items():
        want = {"int": int, "float": float, "str": str, "bool": bool, int: int, float: float, str: str, bool: bool}.get(known.get(key))
        if want is None:
            raise ValueError(f"unknown key: {name}{key}")
        if want is float and isinstance(value, int) and not isinstance(value, bool):
            given[key] = float(value)
        elif type(value) is not want:
            raise ValueError(f"{name}{key} must be of type {want.__name__}")
    return given


def parse(text: str) -> Config:
    """Keys before any section count as general. Unknown, repeated and missing keys and wrong types are errors (ValueError)."""
    data = tomllib.loads(text)
    sections = {k: v for k, v in data.items() if isinstance(v, dict)}
    if unknown := sections.keys() - {"general", "ibf", "hibf"}:
        raise ValueError(f"unknown section: {sorted(unknown)[0]}")
    general = {k: v for k, v in data.items() if k not in sections}
    if twice := general.keys() & sections.get("general", {}).keys():
        raise ValueError(f"duplicate key: {sorted(twice)[0]}")
    general |= sections.get("general", {})
    config = Config(**_section(Config, general, ""), ibf=FlatFilter(**_section(FlatFilter, sections.get("ibf", {}), "ibf.")), hibf=LayeredFilter(**_section(LayeredFilter, sections.get("hibf", {}), "hibf.")))
    if sections.get("hibf"):
        log.info("hibf settings have no effect on an exact index")
    return config


def load(path: str) -> Config:
    return parse(Path(path).read_text())
