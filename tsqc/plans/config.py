"""Settings of the band detector and the known sensors. Results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pass:
    """One pass: window in rows, factor on the deviation, and what is added above and below."""

    window: int
    factor: float
    above: float
    below: float


@dataclass(frozen=True)
class Sensor:
    code: int
    unit: str
    passes: tuple[Pass, Pass, Pass, Pass, Pass]  # the third works with medians, the fifth with a triangular window
    percent: float | None = None  # uncertainty, as a share of the value
    constant: float | None = None  # or as an amount
    nitrate: bool = False
    exact: tuple[float, ...] = ()  # values that mean an error
    ceiling: float | None = None  # values from here on do too
    missing_is_error: bool = False


SENSORS = {
    157787: Sensor(157787, "NTU", (Pass(960, 3.5, 10, 1.5), Pass(960, 3.5, 10, 1.5), Pass(48, 1.7, 2.5, 2.5), Pass(5, 1.3, 0.5, 0.3), Pass(5, 1.3, 0.5, 0.3)), percent=0.05),
    2477034: Sensor(2477034, "mg/L", (Pass(960, 3.0, 1.5, 0.05), Pass(960, 2.6, 1.2, 0.05), Pass(48, 2.5, 0.35, 0.2), Pass(5, 0.3, 0.05, 0.025), Pass(5, 0.9, 0.05, 0.025)), percent=0.03, nitrate=True),
    2477787: Sensor(2477787, "mg/L", (Pass(960, 2.5, 0.4, 0.05), Pass(960, 1.5, 0.3, 0.05), Pass(48, 1.0, 0.35, 0.01), Pass(5, 0.2, 0.03, 0.01), Pass(5, 0.9, 0.05, 0.025)), percent=0.03, nitrate=True),
    400: Sensor(400, "mg/L", (Pass(960, 2.5, 0.4, 0.2), Pass(960, 2.5, 0.4, 0.2), Pass(48, 1.7, 0.35, 0.35), Pass(5, 1.3, 0.05, 0.05), Pass(5, 1.3, 0.05, 0.05)), percent=0.02, exact=(30.0, 25.0, 0.0), ceiling=40.0, missing_is_error=True),
    410: Sensor(410, "pH", (Pass(960, 2.0, 0.3, 0.2), Pass(960, 2.0, 0.3, 0.2), Pass(12, 1.6, 0.05, 0.05), Pass(5, 1.3, 0.05, 0.05), Pass(5, 1.3, 0.05, 0.05)), constant=0.1, exact=(0.0,), ceiling=13.0, missing_is_error=True),
}
ALIASES = {400100011: 400}
VARIABLES = {
    "SurfaceWaterConcentration_O2 [mg*L-1]": 400,
    "SurfaceWaterpH [pH]": 410,
    "SurfaceWaterTurbidity [NTU]": 157787,
    "SurfaceWaterConcentration_NO3_Trios [mg*L-1]": 2477034,
    "SurfaceWaterConcentration_NO3_YSI [mg*L-1]": 2477787,
}
RANGES: dict[str, tuple[float | None, float | None]] = {
    "SurfaceWaterConcentration_O2 [mg*L-1]": (0.0, 40.0),
    "SurfaceWaterpH [pH]": (0.0, 13.0),
    "SurfaceWaterTurbidity [NTU]": (0.0, 4000.0),
    "SurfaceWaterConcentration_NO3_Trios [mg*L-1]": (0.0, 35.0),
    "SurfaceWaterConcentration_NO3_YSI [mg*L-1]": (0.0, 35.0),
}


def sensor(code: int) -> Sensor:
    return SENSORS[ALIASES.get(code, code)]


@dataclass(frozen=True)
class Settings:
    """Settings of the whole pipeline."""

    gap_hours: float = 2.0
    flat_hours: float = 2.0
    flat_slope_win: int = 25
    flat_slope_abs: float = 0.0
    dec_bins: int = 10
    gaussian: bool = False  # trend and trend_residual in the result
    gauss_sigma_hours: float = 6.0
    rle: str = "compat"
    dedupe: str = "median"
    apply_checks: bool = True
    apply_bands: bool = True
    accept_uses_bands: bool = False
    regression: bool = False
    discharge: str | None = None
    persist: bool = True
