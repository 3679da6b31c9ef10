"""B2: deterministic owner organisation of a device id."""

from pyspark.sql import Column, functions as F

from skyledger.functions.hashing import java_string_hash

# Fixed values that must equal the reference: org names are "Org <i>",
# i in [0, n), and the default n is 20.
ORG_NAME_FORMAT = "Org %d"
DEFAULT_NUM_ORGS = 20


def assign_org(id_col: Column | str, num_orgs: int = DEFAULT_NUM_ORGS) -> Column:
    """``"Org " + abs(hash(id) % n)`` with a truncating remainder (Spark's
    ``%`` on integers truncates like the JVM); abs is taken after the mod."""
    h = java_string_hash(id_col)
    return F.format_string(ORG_NAME_FORMAT, F.abs(h % F.lit(num_orgs)).cast("int"))
