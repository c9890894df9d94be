"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("operators.access", "operators.mutations", "operators.bitmaps", "operators.graph", "functions.traces", "functions.statistics", "functions.evaluation", "plans.synthesis", "plans.adaptation", "plans.calibration", "operators.integrity")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tracewright.{name}")
