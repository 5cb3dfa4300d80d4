"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = ("projections", "joins", "aggregates", "windows", "scalars", "streams", "functions_and_files")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"lodeweave.plans.{name}")
