"""Checksums of identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.patterns import CHECKED_IDS, HOLDER_TYPES


def _dihedral(a: int, b: int) -> int:
    """The product in the symmetry group of the pentagon: 0-4 turn, 5-9 turn and reflect."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


#: The Verhoeff scheme's base permutation; the i-th digit from the right uses its i-th power.
_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
PRODUCT = [[_dihedral(a, b) for b in range(10)] for a in range(10)]
POWERS = [list(range(10))]
for _ in range(7):
    POWERS.append([_PERMUTATION[x] for x in POWERS[-1]])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def verhoeff_valid(number: Column) -> Column:
    """Whether a string of digits closes under Verhoeff; false if it is empty or has other characters."""
    table, powers = ("".join(str(x) for row in rows for x in row) for rows in (PRODUCT, POWERS))
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.substring(F.lit(powers), (i % 8) * 10 + d.cast("int") + 1, F.lit(1)).cast("int"))
    check = F.aggregate(places, F.lit(0), lambda c, p: F.substring(F.lit(table), c * 10 + p + 1, F.lit(1)).cast("int"))
    return F.when(number.rlike("^[0-9]+$"), check == 0).otherwise(False)


def luhn_valid(number: Column) -> Column:
    return F.when(number.rlike("^[0-9]+$"), F.call_function("luhn_check", number)).otherwise(False)


def id_holds(kind: str, value: Column) -> Column:
    """Whether more than a value's shape speaks for ``kind``."""
    holder = lambda at: F.lit(HOLDER_TYPES).contains(F.substring(F.upper(value), at, 1))
    if kind == "aadhaar":
        return (F.length(digits(value)) == 12) & verhoeff_valid(digits(value))
    if kind == "card":
        return (F.length(digits(value)) >= 13) & luhn_valid(digits(value))
    return {"pan": holder(4), "gstin": holder(6)}.get(kind, F.lit(False))


def id_verified(kind: Column, value: Column) -> Column:
    """``id_holds`` for a kind that differs by row."""
    out = F.when(F.lit(False), F.lit(False))
    for k in CHECKED_IDS:
        out = out.when(kind == k, id_holds(k, value))
    return out.otherwise(False)
