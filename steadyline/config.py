"""Policy settings. Every value here is this library's own default and can be replaced."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    version: str = "v1"
    # personal baseline: trailing calendar days, today left out
    baseline_days: int = 14
    min_observed: int = 5
    # lagged baseline, so that a slow drift does not become its own normal
    lag_far: int = 21
    lag_near: int = 8
    # material change: against own spread and in units; it must also exceed the group's change
    min_z: float = 1.0
    min_abs: float = 1.0
    # persistence, recovery and repeat suppression, in observed days / calendar days
    persist_days: int = 2
    recover_days: int = 2
    retire_within: int = 2
    cooldown: int = 7
    capacity_per_day: int = 2
    # concern levels by z
    moderate_z: float = 2.0
    high_z: float = 3.0
    stale_after: int = 7
    # rule score
    rule_z: float = 1.5
    busy_run: int = 5
    # temporal score weights
    w_load: float = 0.5
    w_errors: float = 0.3
    w_slope: float = 0.2
    # evidence
    factor_z: float = 1.5
    drift_ratio: float = 1.25
    # labels and evaluation
    horizon: int = 7
    positive_reports: int = 4
    precision_floor: float = 0.5


DEFAULT_POLICY = Policy()
