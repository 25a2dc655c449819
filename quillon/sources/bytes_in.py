"""Bytes of files as text: what is refused, byte order marks, encodings, strict UTF-8."""

from __future__ import annotations

import codecs

#: The first bytes of files that are no text, and what they are.
MAGIC = {
    b"PAR1": "Parquet", b"ORC": "ORC", b"ARROW1": "Arrow", b"PK\x03\x04": "zip", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1": "OLE", b"\x1f\x8b": "gzip",
    b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd", b"SQLite format 3\x00": "SQLite", b"QLN1": "an archive of this library",
}
#: Endings of files that are refused whatever they hold.
ENDINGS = (".xlsx", ".xls", ".ods", ".zip", ".gz", ".bz2", ".xz", ".zst")
#: Byte order marks, the longest first.
MARKS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Formats by ending.
FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".psv": "psv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".pq": "parquet",
    ".dta": "dta", ".sav": "sav", ".zsav": "zsav", ".por": "por", ".sas7bdat": "sas7bdat", ".xpt": "xpt",
}


class Refused(ValueError):
    """An input that is not taken, with the reason."""


def format_of(path: str) -> str:
    """The format that a path's ending names, whatever its case; "text" for any other ending, "csv" for "-"."""
    if path == "-":
        return "csv"
    low = path.lower().rstrip("/")
    return next((f for e, f in FORMATS.items() if low.endswith(e)), "text")


def refusal(path: str, head: bytes) -> str | None:
    """Why a file is refused as text, by its ending and then by its first bytes; None if it is not."""
    low = path.lower()
    for ending in ENDINGS:
        if low.endswith(ending):
            return f"{ending} files are not tables of text"
    return next((f"this is {what}, not text" for magic, what in MAGIC.items() if head.startswith(magic)), None)


def codec_of(name: str) -> str:
    plain = name.lower().replace("_", "-")
    # without a mark, the two wide encodings are little-endian
    plain = {"utf-16": "utf-16-le", "utf-32": "utf-32-le"}.get(plain, plain)
    try:
        return codecs.lookup(plain).name
    except LookupError:
        raise Refused(f"{name} is no known encoding") from None


def decoded(raw: bytes, encoding: str | None = None) -> str:
    """The text of a file, its mark removed. Without an encoding the mark decides, else strict UTF-8."""
    marked = next(((m, c) for m, c in MARKS if raw.startswith(m)), None)
    if encoding is None:
        codec, skip = (marked[1], len(marked[0])) if marked else ("utf-8", 0)
    else:
        codec = codec_of(encoding)
        mark = next((m for m, c in MARKS if codecs.lookup(c).name == codec), b"")
        skip = 0
        if codec in ("utf-16-le", "utf-32-le") and encoding.lower().replace("_", "-") in ("utf-16", "utf-32") and marked and marked[1][:6] == codec[:6]:
            codec, skip = marked[1], len(marked[0])
        elif mark and raw.startswith(mark):
            skip = len(mark)
    try:
        return raw[skip:].decode(codec)
    except UnicodeDecodeError as e:
        at = skip + e.start
        raise Refused(f"byte 0x{raw[at]:02x} at {at} is not {codec}") from None


def strict_text(raw: bytes, encoding: str) -> str:
    """The text of a field, or a refusal that names the byte and its place in the field."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError as e:
        raise Refused(f"byte 0x{raw[e.start]:02x} at {e.start} of a field is not {encoding}") from None
    except LookupError:
        raise Refused(f"{encoding} is no known encoding") from None
