"""Check-digit expressions over whole columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character values of the 7-3-1 scheme are the positions in this text.
ICAO_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Multiplication table of the dihedral group D5, one row of ten per digit.
VERHOEFF_D = (
    "0123456789"
    "1234067895"
    "2340178956"
    "3401289567"
    "4012395678"
    "5987604321"
    "6598710432"
    "7659821043"
    "8765932104"
    "9876543210"
)
# Position-dependent permutations, one row of ten per position modulo 8.
VERHOEFF_P = (
    "0123456789"
    "1576283094"
    "5803796142"
    "8916043527"
    "9453126870"
    "4286573901"
    "2793806415"
    "7046913258"
)


def icao_digit(value: Column) -> Column:
    """7-3-1 weighted check digit; characters outside the alphabet count zero."""
    positions = F.sequence(F.lit(1), F.length(value))

    def term(i: Column) -> Column:
        weight = F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), ((i - 1) % 3 + 1).cast("int"))
        return F.greatest(F.instr(F.lit(ICAO_ALPHABET), value.substr(i, F.lit(1))) - 1, F.lit(0)) * weight

    total = F.aggregate(F.transform(positions, term), F.lit(0), lambda acc, t: acc + t)
    return F.when(F.length(value) > 0, total % 10).otherwise(0)


def _table(table: str, position: Column) -> Column:
    return F.lit(table).substr(position + 1, F.lit(1)).cast("int")


def verhoeff_status(value: Column) -> Column:
    """PASS or FAIL for twelve digits, INCONCLUSIVE for anything else."""
    reversed_digits = F.split(F.reverse(value), "")

    def digit(i: Column) -> Column:
        return _table(VERHOEFF_P, (i % 8) * 10 + F.get(reversed_digits, i).cast("int"))

    permuted = F.transform(F.sequence(F.lit(0), F.lit(11)), digit)
    check = F.aggregate(permuted, F.lit(0), lambda acc, p: _table(VERHOEFF_D, acc * 10 + p))
    return F.when(value.rlike(r"^\d{12}$"), F.when(check == 0, "PASS").otherwise("FAIL")).otherwise("INCONCLUSIVE")
