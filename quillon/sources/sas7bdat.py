"""SAS data files (sas7bdat): pages of rows and of descriptions, plain or compressed by row.

The layout is known from public descriptions of the format: a header of at least 1,024 bytes,
then pages; a page has a type, a number of blocks and pointers to pieces that describe the
table, or rows. Widths are 4 or 8 bytes by the header's word size.
"""

from __future__ import annotations

import struct

import numpy as np

from quillon.sources.bytes_in import Refused, strict_text
from quillon.sources.stats import Dataset, Variable

#: The first 32 bytes of every file.
MAGIC = bytes(12) + bytes.fromhex("c2ea8160b31411cfbd92080009c7318c181f1011")
#: What the pieces begin with, as the low 32 bits.
ROW_SIZE, COLUMN_SIZE = 0xF7F7F7F7, 0xF6F6F6F6
COLUMN_TEXT, COLUMN_NAME, COLUMN_ATTRIBUTES, COLUMN_FORMAT = 0xFFFFFFFD, 0xFFFFFFFF, 0xFFFFFFFC, 0xFFFFFBFE
#: Encodings by number; any other is taken for Windows-1252.
ENCODINGS = {0: "cp1252", 20: "utf-8", 28: "ascii", 29: "latin-1", 30: "latin-2", 40: "iso8859-9", 60: "cp437", 61: "cp850", 62: "cp1252", 118: "cp950", 125: "gb2312", 134: "euc-jp", 138: "shift-jis", 140: "euc-kr"}
#: Page types.
META, DATA, MIXED, AMENDED = 0x0000, 0x0100, 0x0200, 0x4000
COMPRESSED, TRUNCATED = 4, 1


def expand_runs(raw: bytes, size: int) -> bytes:
    """A row packed by runs: each command's high four bits say what, the low ones how much."""
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < size:
        command, low = raw[at] >> 4, raw[at] & 15
        at += 1
        wide = raw[at] if at < len(raw) else 0
        if command in (0, 4, 5, 6, 7):
            at += 1
        copy = {0: low * 256 + wide + 64, 1: low * 256 + wide + 64 + 4096, 8: low + 1, 9: low + 17, 10: low + 33, 11: low + 49}.get(command)
        if command == 1:
            at += 1
        if copy is not None:
            out += raw[at : at + copy]
            at += copy
        elif command == 4:
            out += bytes([raw[at]]) * (low * 256 + wide + 18)
            at += 1
        elif command == 5:
            out += b"@" * (low * 256 + wide + 17)
        elif command == 6:
            out += b" " * (low * 256 + wide + 17)
        elif command == 7:
            out += b"\0" * (low * 256 + wide + 17)
        elif command == 12:
            out += bytes([raw[at]]) * (low + 3)
            at += 1
        elif command in (13, 14, 15):
            out += {13: b"@", 14: b" ", 15: b"\0"}[command] * (low + 2)
        else:
            raise Refused("a packed row has an unknown command")
    if len(out) != size:
        raise Refused("a packed row has another length")
    return bytes(out)


def expand_copies(raw: bytes, size: int) -> bytes:
    """A row packed by copies: 16 flags, then for each a literal byte, or a run or a copy of what came before."""
    out, at, flags, left = bytearray(), 0, 0, 0
    while at < len(raw) and len(out) < size:
        if not left:
            flags, left = int.from_bytes(raw[at : at + 2], "big"), 16
            at += 2
            continue
        left -= 1
        if not flags >> left & 1:
            out.append(raw[at])
            at += 1
            continue
        command, low = raw[at] >> 4, raw[at] & 15
        if command == 0:
            out += bytes([raw[at + 1]]) * (low + 3)
            at += 2
        elif command == 1:
            out += bytes([raw[at + 2]]) * (low + (raw[at + 1] << 4) + 19)
            at += 3
        else:
            back = low + (raw[at + 1] << 4) + 3
            n = raw[at + 2] + 16 if command == 2 else command
            at += 3 if command == 2 else 2
            start = len(out) - back
            if start < 0:
                raise Refused("a packed row copies from before its start")
            for k in range(n):
                out.append(out[start + k])
    if len(out) != size:
        raise Refused("a packed row has another length")
    return bytes(out)


def parse(raw: bytes) -> Dataset:
    if raw[:32] != MAGIC:
        raise Refused("this is no SAS data file")
    try:
        return _parsed(raw)
    except (struct.error, IndexError, OverflowError) as e:
        raise Refused(f"the file does not add up: {e}") from None


def _parsed(raw: bytes) -> Dataset:
    wide = raw[32] == 0x33
    shift = 4 if raw[35] == 0x33 else 0
    e = "<" if raw[37] == 1 else ">"
    word, int_size = ("Q", 8) if wide else ("I", 4)
    encoding = ENCODINGS.get(raw[70], "cp1252")
    at = lambda kind, place, buffer=raw: struct.unpack_from(e + kind, buffer, place)[0]
    header, page_size = at("I", 196 + shift), at("I", 200 + shift)
    pages = at(word, 204 + shift)
    head, pointer = (40, 24) if wide else (24, 12)
    state: dict = {"rows": 0, "size": 0, "mixed": 0, "lcs": 0}
    texts: list[bytes] = []
    names: list[tuple[int, int, int]] = []
    attributes: list[tuple[int, int, int]] = []
    formats: list[tuple] = []
    rows: list[bytes] = []
    packing = ""

    def describe(piece: bytes) -> None:
        signature = at("I", 0, piece) if e == "<" or not wide else at("I", 4, piece) or at("I", 0, piece)
        w = int_size
        if signature == ROW_SIZE:
            state["size"], state["rows"] = at(word, 5 * w, piece), at(word, 6 * w, piece)
            state["mixed"] = at(word, 15 * w, piece)
        elif signature == COLUMN_TEXT:
            texts.append(piece[w:])
        elif signature == COLUMN_NAME:
            for k in range((at("H", w, piece) - 8) // 8):
                names.append(struct.unpack_from(e + "HHH", piece, w + 8 + 8 * k))
        elif signature == COLUMN_ATTRIBUTES:
            step = int_size + 8
            for k in range((at("H", w, piece) - 8) // step):
                place = w + 8 + step * k
                attributes.append((at(word, place, piece), at("I", place + int_size, piece), piece[place + int_size + 6]))
        elif signature == COLUMN_FORMAT:
            shown = struct.unpack_from(e + "HHH", piece, (46 if wide else 34))
            formats.append((shown, struct.unpack_from(e + "HHH", piece, (52 if wide else 40))))

    def text(reference: tuple[int, int, int]) -> str:
        index, start, length = reference
        if not length:
            return ""
        return strict_text(texts[min(index, len(texts) - 1)][start : start + length], encoding).rstrip(" \0")

    for p in range(pages):
        page = raw[header + p * page_size : header + (p + 1) * page_size]
        if len(page) < page_size or page_size < head:
            raise Refused("the file ends before its pages do")
        kind, blocks, pieces = struct.unpack_from(e + "HHH", page, head - 8)
        base = kind & 0x0F00
        if base in (META, MIXED) or kind & AMENDED:
            for k in range(pieces):
                place = head + pointer * k
                start, length = at(word, place, page), at(word, place + int_size, page)
                packed = page[place + 2 * int_size]
                if not length or packed == TRUNCATED:
                    continue
                piece = page[start : start + length]
                if packed == COMPRESSED or (packed == 0 and page[place + 2 * int_size + 1] == 1 and packing and length == state["size"]):
                    packing = packing or ("copies" if any(b"SASYZCR2" in t for t in texts) else "runs" if any(b"SASYZCRL" in t for t in texts) else "")
                    if packed == 0:
                        rows.append(piece)
                    else:
                        rows.append((expand_copies if packing == "copies" else expand_runs)(piece, state["size"]))
                else:
                    describe(piece)
            if not packing:
                packing = "copies" if any(b"SASYZCR2" in t for t in texts) else "runs" if any(b"SASYZCRL" in t for t in texts) else ""
        if base in (DATA, MIXED) and state["size"]:
            start = head
            count = blocks
            if base == MIXED:
                start += pieces * pointer
                start += start % 8 and 8 - start % 8
                count = min(state["mixed"], state["rows"] - len(rows))
            count = min(count, state["rows"] - len(rows))
            for k in range(count):
                rows.append(page[start + k * state["size"] : start + (k + 1) * state["size"]])
    rows = rows[: state["rows"]]
    n = len(rows)
    table = np.frombuffer(b"".join(rows), np.uint8).reshape(n, state["size"]) if n else np.zeros((0, state["size"]), np.uint8)
    variables, columns = [], []
    for k, (start, width, kind) in enumerate(attributes):
        shown, label = formats[k] if k < len(formats) else ((0, 0, 0), (0, 0, 0))
        v = Variable(text(names[k]), kind == 2, width, text(label), text(shown))
        variables.append(v)
        part = np.ascontiguousarray(table[:, start : start + width])
        if v.text:
            columns.append([strict_text(r.tobytes(), encoding).rstrip(" \0") for r in part])
            continue
        whole = np.zeros((n, 8), np.uint8)
        if e == "<":
            whole[:, 8 - width :] = part
        else:
            whole[:, :width] = part
        bits = whole.view(e + "u8").ravel().astype(np.uint64)
        x = bits.view(np.float64)
        tags: list = [None] * n
        for r in np.flatnonzero(np.isnan(x)).tolist():
            code = 255 - (int(bits[r]) >> 40 & 255)  # the complement of the letter's place
            letter = chr(code)
            tags[r] = letter.lower() if "A" <= letter <= "Z" else "" if letter != "_" else "_"
        columns.append((x, tags))
    return Dataset("sas", variables, columns)
