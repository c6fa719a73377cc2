"""Parameters of an analysis: box, bins and options, with their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

SCHEMES = ("ngp", "cic", "tsc", "pcs")
ESTIMATORS = ("ideal", "RR", "LS")
AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    """A periodic box of side ``size`` in a flat cosmology; positions are kept in units of the box."""

    size: float = 1000.0
    a: float = 1.0
    omega_m: float = 0.3
    omega_l: float = 0.7

    def __post_init__(self):
        if self.size <= 0 or self.a <= 0:
            raise ValueError("the box size and the scale factor must be positive")


@dataclass(frozen=True)
class RadialBins:
    """``n`` half-open bins in [low, high), box units; logarithmic bins need a positive low."""

    low: float
    high: float
    n: int
    log: bool = False

    def __post_init__(self):
        if self.log and self.low <= 0:
            object.__setattr__(self, "low", 1e-8)
        if not (0 <= self.low < self.high) or self.n < 1:
            raise ValueError("bins need 0 <= low < high and n >= 1")

    @property
    def step(self) -> float:
        return math.log(self.high / self.low) / self.n if self.log else (self.high - self.low) / self.n

    def edge(self, i: float) -> float:
        return self.low * math.exp(i * self.step) if self.log else self.low + i * self.step


@dataclass(frozen=True)
class SmuBins:
    """Separation and cosine to the line of sight; ``half`` folds the cosine to [0, 1)."""

    r: RadialBins
    n_mu: int
    half: bool = True

    @property
    def mu_low(self) -> float:
        return 0.0 if self.half else -1.0

    @property
    def mu_step(self) -> float:
        return (1.0 - self.mu_low) / self.n_mu


@dataclass(frozen=True)
class SpspBins:
    """Separations across and along the line of sight; ``half`` folds the latter."""

    perp: RadialBins
    par_high: float
    n_par: int
    half: bool = True

    @property
    def par_low(self) -> float:
        return 0.0 if self.half else -self.par_high

    @property
    def par_step(self) -> float:
        return (self.par_high - self.par_low) / self.n_par

    @property
    def reach(self) -> float:
        return math.hypot(self.perp.high, self.par_high)


@dataclass(frozen=True)
class AnalysisConfig:
    """The options of the programs with their defaults (lengths in the box's unit)."""

    box: Box = field(default_factory=Box)
    nk: int = 100
    krange: tuple[float, float] = (1e-2, 50.0)
    nr: int = 100
    rrange: tuple[float, float] = (1.0, 150.0)
    mrange: tuple[float, float] = (1.0, 20.0)
    clevel: tuple[int, int] = (0, 100)
    mesh: int = 1024
    scheme: str = "tsc"
    estimator: str = "ideal"
    axis: str = "z"
    shot_noise: bool = True
    random_factor: float = 1.0
    log_bins: bool = False
    half_angle: bool = True
    jk_level: int = 1
    jk_type: str = "spatial"

    def __post_init__(self):
        for value, allowed, name in ((self.scheme, SCHEMES, "scheme"), (self.estimator, ESTIMATORS, "estimator"), (self.axis, AXES, "axis"), (self.jk_type, ("spatial", "shuffle"), "jk_type")):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
        if self.jk_type == "spatial" and self.jk_level > 1 and self.estimator == "ideal":
            raise ValueError("spatial jackknife blocks need the RR or LS estimator")
        if self.mesh < 1 or self.nr < 1 or self.nk < 1:
            raise ValueError("mesh, nr and nk must be positive")

    def radial_bins(self) -> RadialBins:
        """In box units, the upper end clamped to half a box before the bins are laid out."""
        low, high = self.rrange
        high = min(high, self.box.size / 2)
        return RadialBins(low / self.box.size, high / self.box.size, self.nr, self.log_bins)
