"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "equalize"

MODULES = (
    "operators.pointwise", "operators.neighbourhood", "operators.aggregates", "operators.compositing", "operators.scalars",
    "operators.arrangement", "operators.timeline", "operators.sequential", "operators.colors", "operators.drawing", "operators.palettes", "operators.layers", "operators.scenes", "sources.codecs", "sources.rasters", "sources.gif", "operators.effects", "operators.compositor", "operators.graphs", "operators.glyphs", "sources.metadata", "operators.smooth", "streaming.controls", "operators.conversions", "operators.palette_files", "operators.regions",
)


def _ops() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= import_module(f"rasterloom.{module}").OPS
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in _ops().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ops().items() if sql}
