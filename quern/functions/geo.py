"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRES, KILOMETRES = 6_371_000.0, 6371.0088  # radii of the two distance functions


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = KILOMETRES) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))
