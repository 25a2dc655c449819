"""Cells as text: tokens, quoting, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.numbers import TOKEN

#: Delimiters that a header is searched for, in the order that settles equal counts.
DELIMITERS = (",", "\t", ";", "|")


def number_tokens(cell: Column) -> Column:
    """The plain decimals in a cell, left to right; a minus belongs to the digits right after it."""
    return F.regexp_extract_all(cell, F.lit(TOKEN), F.lit(1))


def delimited_field(cell: Column, delimiter: str = ",") -> Column:
    """A field of a delimited line: quoted, with quotes doubled, only if it holds the delimiter, a quote or an end of line."""
    special = cell.contains(delimiter) | cell.contains('"') | cell.contains("\n") | cell.contains("\r")
    return F.when(special, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def json_string(cell: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(cell, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    rare = out
    for code in range(32):
        c = chr(code)
        rare = F.replace(rare, F.lit(c), F.lit(short.get(c, f"\\u{code:04x}")))
    out = F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_line(names: list[str]) -> Column:
    """An object with every cell as a string."""
    parts: list[Column] = []
    for i, c in enumerate(names):
        parts += [F.lit(", " if i else ""), json_string(F.lit(c)), F.lit(": "), json_string(F.col(f"`{c}`"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def unquoted_count(line: Column, delimiter: str) -> Column:
    """How often the delimiter stands outside quotes in a line."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))).cast("int")


def sniffed_delimiter(line: Column) -> Column:
    """The commonest delimiter of a header outside quotes, the first of equals, a comma if there is none."""
    counts = F.array(*[F.struct(unquoted_count(line, d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    return F.array_max(counts).getField("d")


def human_size(n: Column) -> Column:
    """Bytes below 1,000, else a number of one decimal in KB, MB, GB or TB of 1,000 each."""
    out = F.concat(F.format_number(n, 0), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1000**power, F.concat(F.format_number(F.round(n / F.lit(1000.0) ** power, 1), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def legal_name(name: str, taken: set[str], most: int = 32, prefix: str = "v", reserved: frozenset[str] = frozenset()) -> str:
    """A name of ASCII letters, digits and underscores that starts with no digit, is no longer than
    `most`, not reserved, and differs from those taken whatever the case; it is added to them."""
    legal = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in name) or prefix
    if legal[0].isdigit():
        legal = prefix + legal
    legal = legal[:most]
    if legal.lower() in reserved:
        legal = legal[: most - 1] + "_"
    base, k = legal, 1
    while legal.lower() in taken:
        k += 1
        legal = f"{base[: most - len(f'_{k}')]}_{k}"
    taken.add(legal.lower())
    return legal
