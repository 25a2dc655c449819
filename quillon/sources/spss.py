"""SPSS system files: plain, with bytecode compression and with zlib blocks; plain ones are written."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from quillon.sources.bytes_in import Refused, strict_text
from quillon.sources.stats import Dataset, Variable

#: The system-missing double, the lowest and the highest, and display formats by number.
SYSMIS = -1.7976931348623157e308
LOWEST, HIGHEST = -1.797693134862315e308, 1.7976931348623157e308
FORMATS = {1: "A", 3: "COMMA", 4: "DOLLAR", 5: "F", 17: "PCT", 20: "DATE", 21: "TIME", 22: "DATETIME", 23: "ADATE", 24: "JDATE", 25: "DTIME", 26: "WKDAY", 27: "MONTH", 28: "MOYR", 29: "QYR", 30: "WKYR", 38: "EDATE", 39: "SDATE"}
_NUMBER_OF = {v: k for k, v in FORMATS.items()}


def _unpacked(raw: bytes, cells: int | None, bias: float, e: str) -> bytes:
    """8-byte cells of bytecode: 1-251 a small number, 252 the end, 253 the next 8 bytes, 254 blanks, 255 system missing."""
    out, at = [], 0
    missing = struct.pack(e + "d", SYSMIS)
    while at + 8 <= len(raw) and (cells is None or len(out) < cells):
        codes = raw[at : at + 8]
        at += 8
        for c in codes:
            if c == 252:
                return b"".join(out)
            if c == 253:
                out.append(raw[at : at + 8])
                at += 8
            elif c == 254:
                out.append(b" " * 8)
            elif c == 255:
                out.append(missing)
            elif c:
                out.append(struct.pack(e + "d", c - bias))
    return b"".join(out if cells is None else out[:cells])


def parse(raw: bytes) -> Dataset:
    if raw[:4] not in (b"$FL2", b"$FL3"):
        raise Refused("this is no SPSS system file")
    e = "<" if struct.unpack("<i", raw[64:68])[0] in (2, 3) else ">"
    packing, n = struct.unpack(e + "i", raw[72:76])[0], struct.unpack(e + "i", raw[80:84])[0]
    bias = struct.unpack(e + "d", raw[84:92])[0]
    label, at = raw[109:173], 176
    parts: list[dict] = []  # one for each 8-byte cell of a row
    sets: list[tuple[dict, list[int]]] = []
    notes: list[bytes] = []
    more: dict[int, bytes] = {}
    pending: list[tuple[bytes, bytes]] = []
    i4 = lambda a: struct.unpack(e + "i", raw[a : a + 4])[0]
    while True:
        kind = i4(at)
        at += 4
        if kind == 2:
            width, has_label, missing, shown = i4(at), i4(at + 4), i4(at + 8), i4(at + 12)
            v = {"width": width, "name": raw[at + 20 : at + 28], "label": b"", "shown": shown, "missing": []}
            at += 28
            if has_label:
                size = i4(at)
                v["label"] = raw[at + 4 : at + 4 + size]
                at += 4 + -(-size // 4) * 4
            values = struct.unpack(f"{e}{abs(missing)}d", raw[at : at + 8 * abs(missing)])
            if missing < 0:
                v["missing"] = [(values[0], values[1]), *((x, x) for x in values[2:])]
            elif width == 0:
                v["missing"] = [(x, x) for x in values]
            at += 8 * abs(missing)
            parts.append(v)
        elif kind == 3:
            pending, count = [], i4(at)
            at += 4
            for _ in range(count):
                size = raw[at + 8]
                pending.append((raw[at : at + 8], raw[at + 9 : at + 9 + size]))
                at += 8 + -(-(size + 1) // 8) * 8
        elif kind == 4:
            count = i4(at)
            sets.append((dict(pending), [i4(at + 4 + 4 * k) - 1 for k in range(count)]))
            at += 4 + 4 * count
        elif kind == 6:
            count = i4(at)
            notes += [raw[at + 4 + 80 * k : at + 84 + 80 * k] for k in range(count)]
            at += 4 + 80 * count
        elif kind == 7:
            sub, size, count = i4(at), i4(at + 4), i4(at + 8)
            more[sub] = raw[at + 12 : at + 12 + size * count]
            at += 12 + size * count
        elif kind == 999:
            at += 4
            break
        else:
            raise Refused(f"a record of type {kind}")
    encoding = more.get(20, b"").decode("ascii", "replace").strip() or {65001: "utf-8", 1252: "cp1252", 28591: "latin-1"}.get(struct.unpack(e + "8i", more[3])[7] if len(more.get(3, b"")) == 32 else 1252, "cp1252")
    text = lambda b: strict_text(b, encoding).rstrip(" \0")
    pairs = lambda b: dict(x.split("=", 1) for x in text(b).split("\t") if "=" in x)
    long_names = pairs(more.get(13, b""))
    very_long = {k: int(w.rstrip("\0")) for k, w in (x.split("=", 1) for x in text(more.get(14, b"")).replace("\0", "").split("\t") if "=" in x)}
    cells = len(parts)
    body = raw[at:]
    if packing == 2:
        _, trailer, _ = struct.unpack(e + "qqq", body[:24])
        tail = raw[trailer:]
        blocks = struct.unpack(e + "i", tail[20:24])[0]
        body = b"".join(zlib.decompress(raw[o : o + s]) for _, o, _, s in (struct.unpack(e + "qqii", tail[24 + 24 * k : 48 + 24 * k]) for k in range(blocks)))
    if packing:
        body = _unpacked(body, None if n < 0 else n * cells, bias, e)
    n = len(body) // (8 * cells) if cells and n < 0 else n if cells else 0
    if len(body) < 8 * cells * n:
        raise Refused("the file ends before its rows do")
    table = np.frombuffer(body, np.uint8, 8 * cells * n).reshape(n, 8 * cells)
    variables, columns, first_of, i = [], [], {}, 0
    while i < cells:
        v = parts[i]
        if v["width"] < 0:
            i += 1
            continue
        short = text(v["name"])
        name = long_names.get(short, short)
        code, width, places = v["shown"] >> 16 & 255, v["shown"] >> 8 & 255, v["shown"] & 255
        shown = FORMATS.get(code, "F") + str(width) + (f".{places}" if places else "")
        first_of[i] = len(variables)
        if v["width"]:
            total, chunks, k = very_long.get(short, v["width"]), [], i
            while sum(map(len, ())) == 0 and k < cells:
                w = parts[k]["width"]
                span = -(-w // 8)
                chunks.append(table[:, 8 * k : 8 * k + (min(w, 252 if total > 255 else w))])
                k += span
                if total <= 255 or sum(c.shape[1] for c in chunks) >= total:
                    break
            whole = np.ascontiguousarray(np.concatenate(chunks, axis=1)[:, :total])
            columns.append([text(r.tobytes()) for r in whole])
            variables.append(Variable(name, True, total, text(v["label"]), shown))
            i = k
        else:
            x = np.ascontiguousarray(table[:, 8 * i : 8 * i + 8]).view(e + "f8").ravel().astype(np.float64)
            gone = (x == SYSMIS) | (x == LOWEST) | (x == HIGHEST) | np.isnan(x)
            columns.append((np.where(gone, np.nan, x), ["" if g else None for g in gone.tolist()]))
            variables.append(Variable(name, False, 8, text(v["label"]), shown, "", v["missing"]))
            i += 1
    named: dict[str, dict[float, str]] = {}
    for k, (s, where) in enumerate(sets):
        own = [first_of[w] for w in where if w in first_of]
        if own and not variables[own[0]].text:
            named[f"labels{k}"] = {struct.unpack(e + "d", x)[0]: text(t) for x, t in s.items()}
            for w in own:
                variables[w].labels = f"labels{k}"
    return Dataset("spss", variables, columns, text(label), named, [text(x) for x in notes])


def written(data: Dataset) -> bytes:
    """A plain little-endian file in UTF-8; strings of up to 255 bytes."""
    if any(v.text and v.width > 255 for v in data.variables):
        raise Refused("strings of more than 255 bytes are not written to SPSS files")
    pad = lambda s, w: s.encode()[:w].ljust(w)
    n = data.rows
    out = bytearray(b"$FL2" + pad("@(#) SPSS DATA FILE", 60))
    cells = sum(-(-max(1, v.width) // 8) if v.text else 1 for v in data.variables)
    out += struct.pack("<5id", 2, cells, 0, 0, n, 100.0) + b"01 Jan 70" + b"00:00:00" + pad(data.label, 64) + b"\0\0\0"
    longs, place, starts = [], 0, []
    for k, v in enumerate(data.variables):
        width = max(1, v.width) if v.text else 0
        name = "".join(c for c in v.shown if c.isalpha()).upper()
        digits = v.shown[len(name) :].partition(".")
        code = 1 if v.text else _NUMBER_OF.get(name, 5)
        shown = code << 16 | ((width if v.text else int(digits[0] or 8)) & 255) << 8 | (0 if v.text else int(digits[2] or (2 if not digits[0] else 0)))
        short = f"V{k + 1:07d}"
        longs.append(f"{short}={v.name}")
        ranges = [] if v.text else v.missing[:3]
        spans = [r for r in ranges if r[0] != r[1]][:1]
        points = [r[0] for r in ranges if r[0] == r[1]][: 1 if spans else 3]
        code_missing = -(2 + len(points)) if spans else len(points)
        out += struct.pack("<6i", 2, width, int(bool(v.label)), code_missing, shown, shown) + pad(short, 8)
        if v.label:
            raw = v.label.encode()[:255]
            out += struct.pack("<i", len(raw)) + raw.ljust(-(-len(raw) // 4) * 4)
        out += struct.pack(f"<{abs(code_missing)}d", *(x for r in spans for x in r), *points)
        starts.append(place + 1)
        place += -(-width // 8) if v.text else 1
        out += (struct.pack("<6i", 2, -1, 0, 0, 0, 0) + b" " * 8) * (max(0, -(-width // 8) - 1))
    for name, s in data.sets.items():
        where = [starts[k] for k, v in enumerate(data.variables) if v.labels == name and not v.text]
        if where:
            out += struct.pack("<2i", 3, len(s))
            for x, t in s.items():
                raw = t.encode()[:120]
                out += struct.pack("<d", x) + (bytes([len(raw)]) + raw).ljust(-(-(len(raw) + 1) // 8) * 8)
            out += struct.pack(f"<2i{len(where)}i", 4, len(where), *where)
    if data.notes:
        lines = [note[i : i + 80] for note in data.notes for i in range(0, max(1, len(note)), 80)]
        out += struct.pack("<2i", 6, len(lines)) + b"".join(pad(x, 80) for x in lines)
    out += struct.pack("<4i8i", 7, 3, 4, 8, 20, 0, 0, -1, 1, 0, 2, 65001)
    out += struct.pack("<4i3d", 7, 4, 8, 3, SYSMIS, HIGHEST, LOWEST)
    for sub, raw in ((13, "\t".join(longs).encode()), (20, b"UTF-8")):
        out += struct.pack("<4i", 7, sub, 1, len(raw)) + raw
    out += struct.pack("<2i", 999, 0)
    parts = []
    for v, c in zip(data.variables, data.columns):
        if v.text:
            width = -(-max(1, v.width) // 8) * 8
            parts.append(np.frombuffer(b"".join(pad(s, width) for s in c), np.uint8).reshape(n, width))
        else:
            parts.append(np.where([t is None for t in c[1]], c[0], SYSMIS).astype("<f8").view(np.uint8).reshape(n, 8))
    if parts and n:
        out += np.concatenate(parts, axis=1).tobytes()
    return bytes(out)
