"""Parameters of the jobs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    local_zone: str = "Europe/Helsinki"
    on_time_seconds: int = 60
    late_seconds: int = 300
    stop_speed_ms: float = 1.0
    history: int = 10
    state_ttl_ms: int = 300_000
    feature_ttl_ms: int = 300_000
    reconcile_pct: float = 20.0
    psi_limit: float = 0.2
    shadow_agree: float = 60.0
    shadow_diverge: float = 120.0
    retention_days: tuple = (("bronze", 7), ("silver", 30), ("gold", 365), ("warehouse", 35))
    open_end: str = "2099-12-31 23:59:59"


DEFAULT = Config()
