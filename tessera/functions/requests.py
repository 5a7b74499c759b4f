"""Checks of request arguments before a plan is built from them."""

from __future__ import annotations

import math


class ArgumentError(ValueError):
    """An argument outside its bounds."""


def text_of(name: str, value: str, least: int = 1, most: int = 500) -> str:
    """The stripped text if its length is within bounds."""
    if not isinstance(value, str) or not least <= len(value.strip()) <= most:
        raise ArgumentError(f"{name} must have {least} to {most} characters")
    return value.strip()


def number_of(name: str, value: float, least: float, most: float) -> float:
    """The number if it is finite and within bounds; booleans aren't numbers."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not least <= value <= most:
        raise ArgumentError(f"{name} must be a finite number from {least} to {most}")
    return value


def choice_of(name: str, value: str | None, choices: tuple[str, ...]) -> str | None:
    """The value if it is one of the choices; None stays None."""
    if value is not None and value not in choices:
        raise ArgumentError(f"{name} must be one of {', '.join(choices)}")
    return value
