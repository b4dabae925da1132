"""Physical quantities computed from other columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORCING_SCALE = 5.35
PREINDUSTRIAL_CO2_PPM = 228

# Constants of the beryllium-10 production formula Q = (c + M) / ((a + b*phi) * (d + e*M)).
PRODUCTION_A = 0.7476
PRODUCTION_B = 0.2458
PRODUCTION_C = 2.347
PRODUCTION_D = 1.077
PRODUCTION_E = 2.274


def radiative_forcing(co2_ppm: Column, base: float = PREINDUSTRIAL_CO2_PPM) -> Column:
    return F.lit(FORCING_SCALE) * F.ln(co2_ppm / F.lit(base))


def solar_modulation(production: Column, field: Column, form: str = "direct") -> Column:
    """Solar modulation from the production rate and the field strength; null if either is null.

    `direct` is the expression the published views were made with. `inverted` solves the production
    formula for the modulation instead.
    """
    response = (PRODUCTION_C + field) / (PRODUCTION_D + PRODUCTION_E * field)
    if form == "direct":
        return F.lit(1.0) / (PRODUCTION_A + PRODUCTION_B * response / production) - PRODUCTION_A
    if form == "inverted":
        return (response / production - PRODUCTION_A) / PRODUCTION_B
    raise ValueError(f"unknown form {form!r}")
