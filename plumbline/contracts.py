"""Declared column roles and thresholds, passed to operators as plain values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field


class ContractError(ValueError):
    """A declaration that cannot be bound to the given columns."""


@dataclass(frozen=True)
class MultiplicityContract:
    family: str
    test_id: str
    raw: str
    adjusted: str
    call: str
    alpha: str = "0.05"


@dataclass(frozen=True)
class DesignContract:
    condition: str
    reference_level: str
    test_level: str
    replicate: Sequence[str]
    aggregation: Sequence[str]
    pairing: Sequence[str] = ()
    required_adjustments: Sequence[str] = ()
    fitted_fixed: Sequence[str] = ()
    fitted_random: Sequence[str] = ()
    mode: str = "unpaired"


@dataclass(frozen=True)
class LoopContract:
    resolution: int
    view_start: int
    view_end: int
    reference_level: str
    test_level: str
    replicate: Sequence[str]
    tolerance: float
    minimum_background: int = 50


@dataclass(frozen=True)
class SensitivityContract:
    alpha: float = 0.05
    target_power: float = 0.8
    reference_effect: float = 1.0
    minimum_powered_fraction: float = 0.5


@dataclass(frozen=True)
class Predicate:
    """One literal filter; ``op`` is one of == != < <= > >= in not_in."""

    column: str
    op: str
    value: object
    name: str = field(default="")
