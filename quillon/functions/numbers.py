"""Numbers as text and text as numbers, as column expressions.

A cell is a plain decimal if it is an optional minus, digits, and an optional point with
digits. Its mantissa at its own number of decimals is canonical if writing it back gives
the same text, and within reach if it lies below 2^62 in absolute value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of whole cells.
PLAIN = r"-?[0-9]+(\.[0-9]+)?"
CANONICAL = r"-?(0|[1-9][0-9]*)(\.[0-9]+)?"
NEGATIVE_ZERO = r"-0(\.0+)?"
TOKEN = r"(-?[0-9]+(?:\.[0-9]+)?)"
REACH = 1 << 62
MOST_DECIMALS = 18


def to_text(value: Column, kind: T.DataType) -> Column:
    """The text of a cell; null is the empty text. Doubles have no exponent from 1e-3 up to 1e15."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        short = value.cast("string")
        big = (F.abs(value) >= 1e7) & (F.abs(value) < 1e15)
        digits = F.regexp_replace(F.regexp_extract(short, r"^-?([0-9.]+)E", 1), r"\.", "")
        power = F.regexp_extract(short, r"E([0-9]+)$", 1).try_cast("int")
        head = F.rpad(digits, F.greatest(power + 1, F.length(digits)), "0")
        whole, rest = F.substring(head, F.lit(1), power + 1), F.expr("''")
        rest = F.substring(head, power + 2, F.length(head))
        rest = F.when(rest == "", F.lit("0")).otherwise(rest)
        long = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."), rest)
        text = F.when(big & short.contains("E"), long).otherwise(short)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def matches(cell: Column, pattern: str) -> Column:
    """Whether the pattern takes the whole cell; an end of line at its end is part of it."""
    return cell.rlike(f"^(?:{pattern})\\z")


def is_plain(cell: Column) -> Column:
    return matches(cell, PLAIN)


def decimals(cell: Column) -> Column:
    """Digits after the point, null where the cell is no plain decimal."""
    return F.when(is_plain(cell), places(cell))


def places(plain: Column) -> Column:
    """Digits after the point of a plain decimal."""
    point = F.instr(plain, ".")
    return F.when(point == 0, F.lit(0)).otherwise(F.length(plain) - point).cast("long")


def mantissa(cell: Column) -> Column:
    """The number without its point, null beyond 2^62 or 18 decimals or where the cell is no plain decimal."""
    digits = F.when(is_plain(cell) & (decimals(cell) <= MOST_DECIMALS), F.regexp_replace(cell, r"\.", "")).try_cast("decimal(38,0)")
    return F.when(F.abs(digits) < F.lit(REACH).cast("decimal(38,0)"), digits.cast("long"))


def is_canonical(cell: Column) -> Column:
    """Whether the cell is what its mantissa and its number of decimals are written as."""
    short = F.length(cell) <= MOST_DECIMALS  # whatever its digits, within the reach
    return F.coalesce(matches(cell, CANONICAL) & ~(cell.startswith("-0") & matches(cell, NEGATIVE_ZERO)) & (short | mantissa(cell).isNotNull()), F.lit(False))


def scaled(cell: Column, places: Column | int) -> Column:
    """The mantissa at `places` decimals; null where the cell is not the text of that mantissa."""
    return F.when(is_canonical(cell) & (decimals(cell) == places), mantissa(cell))


def unscaled(value: Column, places: int) -> Column:
    """The text of a mantissa with so many decimals."""
    if not places:
        return value.cast("string")
    digits = F.lpad(F.abs(value.cast("decimal(38,0)")).cast("string"), F.greatest(F.length(F.abs(value.cast("decimal(38,0)")).cast("string")), F.lit(places + 1)), "0")
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.substring(digits, F.lit(1), F.length(digits) - places), F.lit("."), F.right(digits, F.lit(places)))


def zigzag(value: Column) -> Column:
    """0, -1, 1, -2, ... as 0, 1, 2, 3, ..."""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-(value.bitwiseAND(F.lit(1).cast("long"))))


def bit_length(value: Column) -> Column:
    """Binary digits of a non-negative number, none for 0."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value)))


def packed_bytes(value: Column) -> Column:
    """Sum over a group: a width byte, a byte each, and 4 (or 8, if one needs it) more for each of 255 and above."""
    wide = F.when(F.max(value) >= F.lit(1 << 32), F.lit(8)).otherwise(F.lit(4))
    return F.lit(1) + F.count(value) + wide * F.count_if(value >= 255)


def bit_cost(value: Column) -> Column:
    """Sum over a group: the binary digits of the zigzag code, and one bit each."""
    return F.sum(bit_length(zigzag(value))) + F.count(value)


def round_half_even(cell: Column, places: int) -> Column:
    """The text of a plain decimal rounded to fewer decimals, ties to the even digit.

    The sign and leading zeros stay as they are ("-0.4" gives "-0"), a cell with no more than
    `places` decimals stays whole; any other text gives null, as does a number of more than 20
    digits before the point or 18 after it that would have to be rounded.
    """
    size = F.regexp_replace(cell, "^-", "")
    near = F.bround(size.try_cast(f"decimal(38,{MOST_DECIMALS})"), places).cast(f"decimal(38,{places})").cast("string")
    whole = F.length(F.substring_index(size, ".", 1))
    short = F.concat(F.when(cell.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.lpad(near, F.greatest(F.length(near), whole + (places + 1 if places else 0)), "0"))
    return F.when(is_plain(cell), F.when(F.length(size) - whole <= (places + 1 if places else 0), cell).otherwise(short))
