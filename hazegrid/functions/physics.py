"""Dispersion, street canyon, dose and traffic expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazegrid.functions import clean
from hazegrid.functions.geo import angle_difference_deg, angular_weight, is_downwind

#: Fixed values: (sigma_y, sigma_z) per metre by stability class, and roughness lengths in metres by land use.
DISPERSION = {"A": (0.27, 0.20), "B": (0.24, 0.12), "C": (0.22, 0.08), "D": (0.20, 0.06), "E": (0.14, 0.03), "F": (0.10, 0.016)}
ROUGHNESS = {"urban": 2.0, "urban_dense": 2.5, "suburban": 0.8, "park": 0.5, "grassland": 0.1, "water": 0.001, "forest": 1.0, "agricultural": 0.2, "industrial": 1.5}


def _between(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def stability_class(wind: Column, solar: Column, night: Column) -> Column:
    """Pasquill class from wind speed, solar radiation (null counts as weak) and night."""
    sun = F.coalesce(solar.cast("double"), F.lit(0.0))
    light = F.when(night, "F").when(sun < 200, "E").otherwise("A")
    gentle = F.when(night, "E").when(sun < 200, "D").when(sun < 400, "B").otherwise("A")
    moderate = F.when(night | (sun < 200), "D").when(sun < 400, "C").otherwise("B")
    fresh = F.when(~night & (sun >= 400), "C").otherwise("D")
    return F.when(wind < 2, light).when(wind < 3, gentle).when(wind < 5, moderate).when(wind < 6, fresh).otherwise("D")


def sigmas(distance: Column, stability: Column | str = "D") -> tuple[Column, Column]:
    """(sigma_y, sigma_z) in metres, at least 2 and 1; an unknown class is D."""
    d = F.greatest(F.lit(1.0), distance)
    if isinstance(stability, str):
        y, z = (F.lit(x) for x in DISPERSION.get(stability, DISPERSION["D"]))
    else:
        y, z = (clean.lookup(stability, {k: v[i] for k, v in DISPERSION.items()}, DISPERSION["D"][i]) for i in (0, 1))
    return F.greatest(F.lit(2.0), y * d), F.greatest(F.lit(1.0), z * d)


def street_wind(wind: Column, density: Column) -> Column:
    return F.greatest(F.lit(0.2), wind * (1 - 0.55 * _between(density, 0.0, 1.0)))


def plume(q: Column, crosswind: Column, wind: Column, sigma_y: Column, sigma_z: Column, height: float = 2.0) -> Column:
    """Gaussian plume concentration; 0 where wind or a sigma is not positive."""
    side = F.exp(-F.pow(crosswind, 2) / (2 * F.pow(sigma_y, 2)))
    up = F.exp(-F.lit(height * height) / (2 * F.pow(sigma_z, 2)))
    return F.when((wind > 0) & (sigma_y > 0) & (sigma_z > 0), q / (2 * math.pi * wind * sigma_y * sigma_z) * side * up).otherwise(0.0)


def canyon(concentration: Column, density: Column, wind: Column) -> Column:
    stagnation = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), wind / 3))
    return concentration * (1 + 0.6 * _between(density, 0.0, 1.0) + 0.15 * stagnation)


def diffusion_weight(bearing: Column, wind_dir: Column, density: Column | None = None, sigma: float = 35.0, cone: float = 75.0) -> Column:
    """Weight of a street for spread along it; dense streets turn the wind by 0.85 of its difference from the street."""
    wind = wind_dir
    if density is not None:
        delta = angle_difference_deg(wind_dir, bearing)
        turned = F.when(delta == 0, wind_dir).when(delta < 180, wind_dir + 0.85 * delta).otherwise(wind_dir - 0.85 * (360 - delta))
        wind = F.when(density > 0.7, F.pmod(turned, F.lit(360.0))).otherwise(wind_dir)
    return F.when(is_downwind(bearing, wind, cone), angular_weight(angle_difference_deg(bearing, wind), sigma)).otherwise(0.0)


def wind_factor(speed: Column, wind_dir: Column, bearing: Column) -> Column:
    return F.greatest(F.lit(0.2), (1 + 0.15 * speed) * F.exp(-F.pow(angle_difference_deg(bearing, wind_dir) / 45, 2)))


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """(u, v): compass direction to components."""
    return speed * F.sin(F.radians(direction)), speed * F.cos(F.radians(direction))


def wind_state(u: Column, v: Column) -> tuple[Column, Column]:
    """(speed of at least 0.2, direction with east 0); this is not the inverse of wind_components, whose directions are the compass's."""
    return F.greatest(F.lit(0.2), F.hypot(u, v)), F.pmod(F.degrees(F.atan2(v, u)), F.lit(360.0))


def roughness(landuse: Column) -> Column:
    return clean.lookup(F.lower(landuse), ROUGHNESS, 0.5)


def dose(concentration: Column, seconds: Column, mode: Column) -> Column:
    """Inhaled dose along an edge."""
    return concentration * clean.minute_volume(mode) * seconds / 3600


def excess(observed: Column, baseline: Column, alpha: float = 1.5) -> Column:
    """Traffic above the baseline, where it is more than alpha times it."""
    return F.when(observed > alpha * baseline, F.greatest(F.lit(0.0), observed - baseline)).otherwise(0.0)


def quota(toxicity: Column, scale: float = 10.0, least: int = 1, most: int | None = None) -> Column:
    """Capacity of a route from its toxicity, cut to a whole number."""
    raw = F.when(toxicity <= 0, F.lit(float(scale))).otherwise(F.lit(float(scale)) / toxicity).cast("int")
    q = F.greatest(F.lit(least), raw)
    return F.least(q, F.lit(most)) if most is not None else q


SCALARS = {  # for register_functions: SQL text of what is one expression
    "hg_haversine_m": "(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN 2 * 6371000.0D * asin(sqrt(least(1D, pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "hg_bearing_deg": "(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE RETURN pmod(degrees(atan2(y2 - y1, x2 - x1)), 360D)",
    "hg_angle_difference_deg": "(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN abs(pmod(a - b + 180D, 360D) - 180D)",
    "hg_street_wind": "(wind DOUBLE, density DOUBLE) RETURNS DOUBLE RETURN greatest(0.2D, wind * (1 - 0.55D * greatest(0D, least(1D, density))))",
}


def register_functions(spark) -> None:
    """Temporary SQL functions of the session."""
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
