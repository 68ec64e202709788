"""Small helpers of the public interface."""

from __future__ import annotations

from pathlib import Path


def convert_data_type(text: str) -> int | float | str:
    """A text that reads as a number becomes one, a whole one an int; any other stays."""
    try:
        x = float(text)
    except ValueError:
        return text
    return int(x) if x.is_integer() else x


def normalize_distance(distance: float, a: str, b: str) -> float:
    return 1 - distance / max(len(a), len(b), 1)


def is_sorted(values: dict) -> bool:
    """Whether the values of a dict ascend."""
    v = list(values.values())
    return all(a <= b for a, b in zip(v, v[1:], strict=False))


def get_project_root() -> Path:
    return Path(__file__).resolve().parents[1]
