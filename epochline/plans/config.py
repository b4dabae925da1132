"""Settings of the whole flow."""

from __future__ import annotations

from dataclasses import dataclass, fields

from epochline.sources.files import read_document


@dataclass(frozen=True)
class FlowConfig:
    """Years are signed; the test window is inclusive; everything after `present` is a forecast."""

    present: int = 2025
    forecast_end: int = 200_000
    test_start: int = -500_000
    test_end: int = -300_000
    places: int = 5
    width: int = 2_000
    coarse: int = 50_000
    train_from: int = -740_000
    lags: tuple[int, ...] = (20, 50)
    lagged: tuple[str, ...] = ("perihelion", "eccentricity", "obliquity", "insolation")
    smoothed: tuple[str, ...] = ("solar_modulation",)
    unscaled: tuple[str, ...] = ("year_bin", "anomaly", "co2_ppm")
    dropped: tuple[str, ...] = ("co2", "be_ppm", "VADM", "delta_anomaly", "squared", "solar_modulation")
    pad_copies: int = 50

    @classmethod
    def from_document(cls, path: str) -> FlowConfig:
        """Settings from a JSON document; `anomaly_decimal_places` is accepted for `places`."""
        document = read_document(path)
        document.setdefault("places", document.get("anomaly_decimal_places", cls.places))
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in document.items() if k in known})
