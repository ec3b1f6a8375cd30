"""Checks of parameters on the driver, before any plan is made."""

from __future__ import annotations

import math


def finite(name: str, value: object) -> float:
    """A finite number; truth values aren't numbers."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number, not {value!r}")
    return float(value)


def between(name: str, value: object, low: float, high: float) -> float:
    """A finite number strictly between two others."""
    if not low < finite(name, value) < high:
        raise ValueError(f"{name} must lie strictly between {low} and {high}, not {value!r}")
    return float(value)


def whole(name: str, value: object, least: int = 0) -> int:
    """A whole number, not below ``least``; truth values and 1.0 aren't."""
    if type(value) is not int or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {value!r}")
    return value


def truth(name: str, value: object) -> bool:
    """True or False and nothing else."""
    if not isinstance(value, bool):
        raise ValueError(f"{name} must be True or False, not {value!r}")
    return value
