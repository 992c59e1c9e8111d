"""Imports every plan module so that their queries register themselves."""

from __future__ import annotations

from . import (  # noqa: F401
    applicant_matrix, boosting, children, cleaning, loading, models, neighbours, presets, profiling, reports, rows, store)
from .registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)


def flagship(spark, sf_dir):
    return REGISTRY["f_applicant_matrix"].fn(spark, sf_dir)
