"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "focal_contrast"
MODULES = ("raster_queries", "temporal_queries", "spatial_queries", "label_queries", "score_queries", "text_queries", "model_queries", "grid_queries", "stream_queries")


def _gathered(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        for key, value in getattr(import_module(f"tesselon.plans.{module}"), name).items():
            if key in out:
                raise ValueError(f"two queries are named {key}")
            out[key] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("SQL")
