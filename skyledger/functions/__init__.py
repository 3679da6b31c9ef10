"""Column-level functions (JVM-side expressions, no Python UDFs)."""

from skyledger.functions.hashing import java_string_hash
from skyledger.functions.orgs import assign_org
from skyledger.functions.geo import chord_distance_sq, qualified_name, unit_sphere_point

__all__ = ["java_string_hash", "assign_org", "qualified_name", "unit_sphere_point",
           "chord_distance_sq"]
