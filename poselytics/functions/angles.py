"""Angle columns: list to map, and NaN-safe access by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def angle_map(angles: Column) -> Column:
    """``[{name, value, ..}]`` to a ``name -> value`` map; the last duplicate wins.

    Reading the two fields off the array, not through a lambda, lets the scan
    leave out the points of every angle.
    """
    return F.map_from_arrays(angles["name"], angles["value"])


def nan_to_null(value: Column) -> Column:
    """Spark orders NaN above every number; as NULL it fails every comparison instead."""
    return F.nanvl(value, F.lit(None).cast("double"))
