"""Activations and their derivatives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def activate(z: Column, kind: str) -> Column:
    if kind == "tanh":
        return F.tanh(z)
    if kind == "relu":
        return F.greatest(z, F.lit(0.0))
    if kind == "sigmoid":
        return 1 / (1 + F.exp(-z))
    if kind == "linear":
        return z
    raise ValueError(f"unknown activation {kind}")


def slope(z: Column, kind: str) -> Column:
    """Derivative at z."""
    if kind == "tanh":
        return 1 - F.tanh(z) * F.tanh(z)
    if kind == "relu":
        return (z > 0).cast("double")
    if kind == "sigmoid":
        p = activate(z, "sigmoid")
        return p * (1 - p)
    if kind == "linear":
        return F.lit(1.0)
    raise ValueError(f"unknown activation {kind}")


def hidden_kind(regression: bool) -> str:
    return "relu" if regression else "tanh"


def output_kind(regression: bool, negative_labels: bool = False) -> str:
    if not regression:
        return "sigmoid"
    return "linear" if negative_labels else "relu"
