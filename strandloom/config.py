"""Settings of a run, checked once."""

from __future__ import annotations

from dataclasses import dataclass


class StrandloomError(Exception):
    """Base of the library's errors."""


class ConfigError(StrandloomError):
    """A setting is out of range."""


class InputError(StrandloomError):
    """An input can't be used."""


class ToolMissing(StrandloomError):
    """An optional external program isn't there; the step is skipped unless it was asked for."""


RECOVERABLE = (ToolMissing,)
MODES = ("strict", "default", "sensitive")
SINKS = ("matrix", "rtab", "csv", "genes", "graph", "json", "jsonl", "fasta", "gff", "parquet", "variants", "variant_matrix", "dna", "protein", "graph_parquet", "resistance_gff", "graph_html", "summary", "html")


@dataclass(frozen=True)
class Config:
    """identity, lengths and core are shares; formats are names in SINKS; qc are the paths of quality reports, by genome."""

    output: str
    identity: float = 0.98
    family_identity: float = 0.7
    mode: str = "default"
    core: float = 0.99
    formats: tuple[str, ...] = ("matrix", "graph", "json", "summary")
    merge_paralogs: bool = False
    refind: bool = True
    consensus: bool = False
    compat_refind: bool = False
    correct: bool = True
    qc: tuple[str, ...] = ()
    min_cycles: int = 5
    lengths: float | None = None

    def validate(self) -> Config:
        for name in ("identity", "family_identity", "core"):
            if not 0 < getattr(self, name) <= 1:
                raise ConfigError(f"{name} must be above 0 and at most 1, not {getattr(self, name)}")
        if self.lengths is not None and not 0 < self.lengths <= 1:
            raise ConfigError(f"lengths must be above 0 and at most 1, not {self.lengths}")
        if self.mode not in MODES:
            raise ConfigError(f"mode must be one of {', '.join(MODES)}, not {self.mode!r}")
        if unknown := set(self.formats) - set(SINKS):
            raise ConfigError(f"unknown formats: {', '.join(sorted(unknown))}")
        if self.min_cycles < 1:
            raise ConfigError("min_cycles must be 1 at least")
        return self
