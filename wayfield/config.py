"""Hyper-parameters, all in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    neighbours: int = 6
    distance_scale: float = 0.35
    most_nodes: int = 3000
    propagation: float = 0.65
    rounds: int = 24
    shrink: float = 0.5
    core_quantile: float = 0.75
    trap_quantile: float = 0.25
    least_runs: int = 3
    laplace: float = 0.5
    basin_fail_rate: float = 0.7
    basin_expand_rate: float = 0.56
    most_escape: float = 0.3
    gate_uplift: float = 0.1


CONFIG = Config()
