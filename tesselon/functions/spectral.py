"""Band arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / (nir + red + F.lit(1e-6))


def canopy_height(surface: Column, terrain: Column) -> Column:
    return F.greatest(surface - terrain, F.lit(0.0))


def brightness(r: Column, g: Column, b: Column) -> Column:
    return r + g + b


def normalise(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + F.lit(1e-8))


def is_valid(*bands: Column) -> Column:
    """A pixel is no-data exactly if all its bands are zero."""
    out = bands[0] != 0
    for b in bands[1:]:
        out = out | (b != 0)
    return out


def stretch(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest((x - low) / F.greatest(high - low, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
