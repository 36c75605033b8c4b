"""Registered queries over the given tables, each with an independent SQL check where SQL can express it."""

from locusframe.plans import (  # noqa: F401
    alignment,
    associations,
    cohorts,
    files,
    interpretation,
    networks,
    preparation,
    quality,
    topologies,
)
from locusframe.plans.registry import CHECKS, QUERIES  # noqa: F401
