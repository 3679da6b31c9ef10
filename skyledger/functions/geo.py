"""Place naming and unit-sphere geometry."""

from pyspark.sql import Column, functions as F


def qualified_name(name: Column | str, province: Column | str, country: Column | str) -> Column:
    """``"<name>, <province> <country>"``; a null part prints as ``null``
    (format_string follows the JVM formatter), unlike concat."""
    return F.format_string("%s, %s %s", name, province, country)


def unit_sphere_point(lat: Column | str, lon: Column | str, prefix: str = "") -> list[Column]:
    """x, y, z of a latitude/longitude on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return [
        (F.cos(la) * F.cos(lo)).alias(prefix + "x"),
        (F.cos(la) * F.sin(lo)).alias(prefix + "y"),
        F.sin(la).alias(prefix + "z"),
    ]


def chord_distance_sq(ax: Column, ay: Column, az: Column,
                      bx: Column, by: Column, bz: Column) -> Column:
    """Squared straight-line distance; ordered like great-circle distance."""
    dx, dy, dz = ax - bx, ay - by, az - bz
    return dx * dx + dy * dy + dz * dz
