"""Queries that apply the engine's operators to the driver's tables, with oracle SQL."""

from landgrid.registry import Registry

REGISTRY = Registry()

from landgrid.queries import basics, grid, space, tables  # noqa: E402, F401
