"""Checksum validators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.patterns import BASE36, VERHOEFF_PERMUTATION, VERHOEFF_PRODUCT


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _table(rows) -> Column:
    return F.array(*[F.lit(x) for row in rows for x in row])


def luhn(value: Column) -> Column:
    """13 to 19 digits, not all alike, with a Luhn checksum."""
    d = _digits(value)
    return F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1+$") & F.call_function("luhn_check", d)


def verhoeff(value: Column) -> Column:
    """12 digits, not all alike, no leading zero, with a Verhoeff checksum."""
    d = _digits(value)
    product, permutation = _table(VERHOEFF_PRODUCT), _table(VERHOEFF_PERMUTATION)
    digit = lambda i: F.substring(F.reverse(d), i + 1, F.lit(1)).cast("int")
    check = F.aggregate(
        F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda c, i: F.element_at(product, c * 10 + F.element_at(permutation, (i % 8) * 10 + digit(i) + 1) + 1)
    )
    # The fold looks only at texts of the right shape.
    return F.when((F.length(d) == 12) & ~d.rlike(r"^0|^(\d)\1+$"), check == 0).otherwise(F.lit(False))


def gstin(value: Column) -> Column:
    """15 characters of which the last is the base-36 check character of the others."""
    code = lambda i: F.instr(F.lit(BASE36), F.substring(value, i, F.lit(1))) - 1
    product = lambda i: F.when(i % 2 == 0, 2).otherwise(1) * code(i)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda s, i: s + (F.floor(product(i) / 36) + product(i) % 36).cast("int"))
    check = F.substring(F.lit(BASE36), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))
    return F.when(value.rlike(r"^[0-9A-Z]{15}$"), check == F.substring(value, 15, 1)).otherwise(F.lit(False))


VALIDATORS = {"luhn": luhn, "verhoeff": verhoeff, "gstin": gstin}
