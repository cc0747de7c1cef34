"""Thresholds of the detectors, as frozen defaults."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SideRole:
    """A collector (inbound) or distributor (outbound) candidate."""

    fan: int = 95
    count: int = 95
    volume: float = 150_000.0
    ratio: float = 1.0


@dataclass(frozen=True)
class TerminalRole:
    sink_volume: float = 50_000.0
    sink_count: int = 2
    sink_out: int = 0
    drain_volume: float = 100_000.0
    drain_count: int = 2
    ip_ratio: float = 0.20
    ip_volume: float = 50_000.0
    ip_out: int = 0


@dataclass(frozen=True)
class Roles:
    collector: SideRole = field(default_factory=SideRole)
    distributor: SideRole = field(default_factory=SideRole)
    terminal: TerminalRole = field(default_factory=TerminalRole)


@dataclass(frozen=True)
class Velocity:
    """Pass-through: money that leaves between `low` and `high` seconds after it came."""

    low: int = 180
    high: int = 900
    horizon: int = 86_400
    ratio: float = 0.90
    outflows: int = 2


@dataclass(frozen=True)
class Trace:
    hops: int = 4
    branches: int = 50
    edges: int = 500
    horizon: int | None = None


@dataclass(frozen=True)
class Settings:
    roles: Roles = field(default_factory=Roles)
    velocity: Velocity = field(default_factory=Velocity)
    trace: Trace = field(default_factory=Trace)
    high_risk: float = 70.0
