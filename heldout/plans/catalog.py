"""Loads every query family and exposes the two dictionaries of the driver contract."""

from __future__ import annotations

import importlib

from heldout.plans.registry import ORACLE, QUERIES

FAMILIES = (
    "split_queries", "source_queries", "event_queries", "prior_queries", "exposure_queries", "inference_queries",
    "evidence_queries",
    "readout_queries",
    "signal_queries",
)

for _family in FAMILIES:
    importlib.import_module(f"heldout.plans.{_family}")

__all__ = ["ORACLE", "QUERIES"]
