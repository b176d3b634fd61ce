"""Bound queries: the operators over the driver's tables, with their SQL."""

from __future__ import annotations

from . import catalog, extra, images, kernels, masters, matches, readers, records, sequences, stores  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
