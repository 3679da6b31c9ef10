"""The JVM ``String.hashCode`` of a string column.

Spark's ``hash`` is Murmur3, so the 31-polynomial over UTF-16 code units is
spelled out with built-in expressions and folded with ``aggregate``, keeping
the unsigned low 32 bits; the result is then mapped to the signed 32-bit
range.  A string without supplementary characters has one code unit per
character, whose value ``ascii`` returns; otherwise the string is encoded
as UTF-16BE and read four hex digits (one code unit, surrogates included)
at a time.
"""

from pyspark.sql import Column, functions as F

_MASK = 0xFFFFFFFF


def _fold(n: Column, unit) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("bigint"),
                       lambda acc, i: (acc * 31 + unit(i)).bitwiseAND(F.lit(_MASK)))


def java_string_hash(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    utf16 = F.encode(c, "UTF-16BE")
    n_units = (F.octet_length(utf16) / 2).cast("int")
    bmp_only = n_units == F.length(c)
    by_char = _fold(F.length(c), lambda i: F.ascii(F.substring(c, i, 1)).cast("bigint"))
    hexed = F.hex(utf16)
    by_unit = _fold(n_units, lambda i: F.conv(F.substring(hexed, (i - 1) * 4 + 1, 4), 16, 10).cast("bigint"))
    # sequence(1, 0) counts down, so the empty string is handled apart.
    unsigned = (F.when(F.length(c) == 0, F.lit(0).cast("bigint"))
                .when(bmp_only, by_char).otherwise(by_unit))
    return F.when(unsigned >= 2 ** 31, unsigned - 2 ** 32).otherwise(unsigned)
