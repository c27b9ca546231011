"""What a scan looks for; immutable, resolved on the driver and sent to workers with the lexicon."""

from __future__ import annotations

from dataclasses import dataclass

from ..lexicon import SEVERITIES

MAX_CHARS = 100_000


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...] | None = None  # None: all
    fuzzy: bool = True
    threshold: float = 0.85
    phrases: bool = True
    transliteration: bool = True
    min_severity: str = "low"
    whitelist: tuple[str, ...] = ()
    strict: bool = False  # texts over MAX_CHARS are an error; otherwise they are scanned and flagged

    def __post_init__(self):
        if self.min_severity not in SEVERITIES:
            raise ValueError(f"min_severity {self.min_severity!r} is none of {SEVERITIES}")
        if not all(isinstance(x, str) for x in self.whitelist):
            raise TypeError("the whitelist holds strings")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold is from 0 to 1")

    def lowered(self) -> frozenset[str]:
        return frozenset(x.lower() for x in self.whitelist)
