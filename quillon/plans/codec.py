"""One block of a table as bytes, and back.

Columns are numbers (mantissas at one number of decimals), dictionaries or texts. Numbers are
stored as differences of the cheapest order; dictionaries' ids, numbers and texts can be stored
in the row order of a dictionary that they depend on, if that measures smaller; runs of like
numbers as differences of differences. Whatever a lenient number cannot hold is kept beside it.
Everything is checked on the way back; a block that does not add up is refused.
"""

from __future__ import annotations

import json
import lzma
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillon.functions.numbers import CANONICAL, MOST_DECIMALS, NEGATIVE_ZERO, REACH
from quillon.operators import compare, dependency, derive

MAGIC, VERSION = b"QLN1", 1
MOST_ORDER, EXCEPTION_PERCENT = 4, 5
#: Bytes that a stream of a block can hold.
MOST_BYTES = 1 << 30
_INTS = [{"id": lzma.FILTER_LZMA2, "preset": 6, "lc": 0, "lp": 2, "pb": 2}]
_TEXT = [{"id": lzma.FILTER_LZMA2, "preset": 6, "lc": 4, "lp": 0, "pb": 1}]
#: Texts of more bytes are searched for repeats half as deep: a quarter less time for 0.2 % more bytes; any reader of _TEXT reads them.
LONG_TEXT, _LONG = 1 << 21, [_TEXT[0] | {"depth": 24}]
_canonical, _minus_zero = re.compile(CANONICAL), re.compile(NEGATIVE_ZERO)


class Damaged(ValueError):
    """A block or archive that is not what it says."""


# -- numbers ---------------------------------------------------------------------------


def mantissa(cell: str, places: int) -> int | None:
    if not _canonical.fullmatch(cell) or _minus_zero.fullmatch(cell):
        return None
    whole, _, rest = cell.partition(".")
    if len(rest) != places:
        return None
    value = int(whole + rest)
    return value if abs(value) < REACH else None


def written(value: int, places: int) -> str:
    if not places:
        return str(value)
    digits = str(abs(value)).rjust(places + 1, "0")
    return ("-" if value < 0 else "") + digits[:-places] + "." + digits[-places:]


def all_written(values: np.ndarray, places: int) -> list[str]:
    """`written` of each."""
    if not places:
        return list(map(str, values.tolist()))
    one, digits = 10**places, f"0{places}d"
    return [f"{v // one}.{v % one:{digits}}" if v >= 0 else written(v, places) for v in values.tolist()]


def numbers(cells: list[str], lenient: bool) -> tuple[int, np.ndarray, dict[int, str]] | None:
    """(decimals, mantissas, exceptions) of a column; lenient: with at most EXCEPTION_PERCENT exceptions,
    whose mantissas repeat the one before them (the first one's, at the start)."""
    n = len(cells)
    most = n * EXCEPTION_PERCENT // 100 if lenient else 0
    if sum(not _canonical.fullmatch(c) for c in cells[:64]) > most:
        return None
    texts = pa.array(cells, pa.string())
    fits = pc.and_(pc.match_substring_regex(texts, rf"\A(?:{CANONICAL})\z"), pc.invert(pc.match_substring_regex(texts, rf"\A(?:{NEGATIVE_ZERO})\z"))).to_numpy(zero_copy_only=False)
    if not fits.any() or n - int(fits.sum()) > most:
        return None
    dot = pc.find_substring(texts, ".").to_numpy()
    size = pc.binary_length(texts).to_numpy()
    places = np.where(dot < 0, 0, size - dot - 1)
    met, counts = np.unique(places[fits], return_counts=True)
    if len(met) > 1 and not lenient:
        return None
    own = int(met[np.argmax(counts)])  # the smaller of equals
    if own > MOST_DECIMALS:
        return None
    fits &= places == own
    short = fits & (size <= 18)  # these cannot overflow
    values = np.zeros(n, np.int64)
    values[short] = pc.cast(pc.replace_substring(texts.filter(pa.array(short)), ".", ""), pa.int64()).to_numpy()
    for i in np.flatnonzero(fits & ~short).tolist():
        v = mantissa(cells[i], own)
        if v is None:
            fits[i] = False
        else:
            values[i] = v
    where = np.flatnonzero(fits)
    if n - len(where) > most or not len(where):
        return None
    last = np.maximum.accumulate(np.where(fits, np.arange(n), -1))
    values = values[np.where(last < 0, where[0], last)]
    return own, values, {i: cells[i] for i in np.flatnonzero(~fits).tolist()}


def zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    return ((u >> np.uint64(1)) ^ (np.uint64(0) - (u & np.uint64(1)))).view(np.int64)


def packed(v: np.ndarray) -> bytes:
    """Zigzag codes: a width (4 or 8), a byte for each, 255 for those that follow at that width."""
    u = zigzag(v)
    big = u >= 255
    width = 8 if big.any() and int(u.max()) >= 1 << 32 else 4
    return bytes([width]) + np.where(big, 255, u).astype(np.uint8).tobytes() + u[big].astype(f"<u{width}").tobytes()


def packed_size(v: np.ndarray) -> int:
    u = zigzag(v)
    big = u >= 255
    return 1 + len(u) + (8 if big.any() and int(u.max()) >= 1 << 32 else 4) * int(big.sum())


def unpacked(raw: memoryview, n: int) -> tuple[np.ndarray, int]:
    if len(raw) < n + 1 or raw[0] not in (4, 8):
        raise Damaged("a stream of numbers is cut or has no width")
    u = np.frombuffer(raw[1 : n + 1], np.uint8).astype(np.uint64)
    big = np.flatnonzero(u == 255)
    end = n + 1 + raw[0] * len(big)
    if len(raw) < end:
        raise Damaged("a stream of numbers is cut")
    u[big] = np.frombuffer(raw[n + 1 : end], f"<u{raw[0]}")
    return unzigzag(u), end


def differenced(v: np.ndarray) -> tuple[int, np.ndarray]:
    """(order, differences) of the order from 0 to MOST_ORDER that packs smallest; the first values stay."""
    best = (packed_size(v), 0, v)
    with np.errstate(over="ignore"):
        for k in range(1, MOST_ORDER + 1):
            v = np.diff(v, prepend=np.int64(0))
            size = packed_size(v)
            if size < best[0]:
                best = (size, k, v)
    return best[1], best[2]


def summed(v: np.ndarray, k: int) -> np.ndarray:
    for _ in range(k):
        v = np.cumsum(v, dtype=np.int64)
    return v


# -- texts ---------------------------------------------------------------------------------


def front_coded(words: list[str]) -> tuple[bytes, list[str]]:
    """How many leading characters each word shares with the one before it (255 at most), and the rest."""
    shared, rest, before = bytearray(), [], ""
    for w in words:
        n, most = 0, min(len(w), len(before), 255)
        while n < most and w[n] == before[n]:
            n += 1
        shared.append(n)
        rest.append(w[n:])
        before = w
    return bytes(shared), rest


def joined(cells: list[str]) -> tuple[bytes, list[int] | None]:
    """Cells with an end of line after each, or without one and their byte lengths where a cell holds one."""
    whole = "\n".join([*cells, ""])
    if whole.count("\n") != len(cells):
        raw = [c.encode() for c in cells]
        return b"".join(raw), [len(r) for r in raw]
    return whole.encode(), None


def size_estimate(raw: bytes) -> int:
    """Bytes that a greedy search for repeats would leave: three for each repeat of four bytes or more,
    found by the last place of their first four, and for the rest their entropy given the byte before."""
    last: dict[bytes, int] = {}
    pairs, singles, repeats, at = Counter(), Counter(), 0, 0
    while at < len(raw):
        key = raw[at : at + 4]
        was = last.get(key) if len(key) == 4 else None
        last[key] = at
        if was is not None:
            n = 4
            while at + n < len(raw) and raw[was + n] == raw[at + n]:
                n += 1
            repeats += 1
            at += n
            continue
        before = raw[at - 1] if at else -1
        pairs[before, raw[at]] += 1
        singles[before] += 1
        at += 1
    bits = sum(-n * np.log2(n / singles[b]) for (b, _), n in pairs.items())
    return 3 * repeats + int(np.ceil(bits / 8))


def probe(raw: bytes) -> int:
    """An estimate of a stream's compressed size: of four slices spread over a long one."""
    part = 65_536
    if len(raw) <= 4 * part:
        return len(zlib.compress(raw, 1))
    step = (len(raw) - part) // 3
    return sum(len(zlib.compress(raw[i * step : i * step + part], 1)) for i in range(4)) * len(raw) // (4 * part)


# -- a block ------------------------------------------------------------------------------------


def _entropies(ids: dict[int, np.ndarray]) -> tuple[dict, dict]:
    quantised = lambda x: int(np.floor(x * (1 << 20) + 0.5))
    single, h = {}, {}
    for c, v in ids.items():
        k = np.unique(v, return_counts=True)[1]
        h[c] = (np.log2(len(v)) - (k * np.log2(k)).sum() / len(v), len(k))
        single[c] = quantised(h[c][0])
    gains = {}
    order = sorted(ids)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            k = np.unique(ids[a].astype(np.int64) * h[b][1] + ids[b], return_counts=True)[1]
            joint = np.log2(len(ids[a])) - (k * np.log2(k)).sum() / len(ids[a])
            for p, c in ((a, b), (b, a)):
                given = joint - h[p][0] + (len(k) - h[p][1]) / (2 * len(ids[a]) * np.log(2.0))
                gains[p, c] = single[c] - quantised(given)
    return single, gains


def encode_block(names: list[str], columns: list[list[str]]) -> bytes:
    """A block's bytes: MAGIC, the sizes of three streams, and the streams (plan, numbers, texts)."""
    n = len(columns[0]) if columns else 0
    if any(len(c) != n for c in columns):
        raise ValueError("columns differ in length")
    columns = [list(c) for c in columns]
    plan: dict = {"v": VERSION, "names": names, "n": n, "columns": [None] * len(columns), "derived": {}}
    found = [numbers(c, False) for c in columns]
    for target, sources in _derivations(columns).items():
        plan["derived"][str(target)] = sources
        cells = [derive.rewrite_cell(cell, list(row)) for cell, *row in zip(columns[target], *(columns[s] for s in sources))]
        columns[target], found[target] = cells, None
    ints, texts = bytearray(), []
    dictionaries: dict[int, tuple[list[str], np.ndarray]] = {}
    for c, cells in enumerate(columns):
        if found[c] is None:
            values = sorted(set(cells))
            if n and len(values) <= min(65_536, max(n, 2) // 2):
                at = {v: i for i, v in enumerate(values)}
                dictionaries[c] = values, np.array([at[x] for x in cells], np.int64)
            loose = numbers(cells, True) if n else None
            if loose:
                plain = probe(dictionaries[c][1].astype("<u4").tobytes()) + sum(map(len, dictionaries[c][0])) if c in dictionaries else probe(joined(cells)[0])
                if probe(packed(differenced(loose[1])[1])) + 3 * len(loose[2]) < plain:
                    found[c] = loose
                    dictionaries.pop(c, None)
    orders = {c: np.argsort(ids, kind="stable") for c, (_, ids) in dictionaries.items()}
    tree: list[tuple[int, int | None]] = dependency.parent_tree(*_entropies({c: ids for c, (_, ids) in dictionaries.items()})) if dictionaries else []

    def strings(cells: list[str], coded: bool) -> dict:
        out: dict = {"n": len(cells)}
        if coded:
            shared, cells = front_coded(cells)
            ints.extend(shared)
            out["front"] = True
        raw, sizes = joined(cells)
        if sizes is not None:
            out["sizes"] = True
            ints.extend(packed(np.array(sizes, np.int64)))
        out["bytes"] = len(raw)
        texts.append(raw)
        return out

    for c, parent in tree:
        values, ids = dictionaries[c]
        width = 1 if len(values) <= 256 else 2 if len(values) <= 65_536 else 4
        raw = ids.astype(f"<u{width}")
        if parent is not None and probe(raw[orders[parent]].tobytes()) >= probe(raw.tobytes()):
            parent = None
        ints.extend((raw if parent is None else raw[orders[parent]]).tobytes())
        plan["columns"][c] = {"kind": "dict", "width": width, "parent": parent, "values": strings(values, True)}
    grouped = compare.groups([(str(c), "NUM" if f and not f[2] else "", f[0] if f else None, int(np.abs(f[1]).max(initial=0)) if f else None, f is None) for c, f in enumerate(found)]) if n >= 3 else []
    plan["groups"] = []
    for group in ([int(c) for c in g] for g in grouped):
        with np.errstate(over="ignore"):
            table = np.stack([found[c][1] for c in group], axis=1)
            down = np.diff(table, axis=0, prepend=np.zeros((1, len(group)), np.int64))
            across = down.copy()
            across[1:, 1:] = down[1:, 1:] - down[1:, :-1]
        coded = packed(across.T.ravel())
        if probe(coded) < sum(probe(packed(differenced(found[c][1])[1])) for c in group):
            plan["groups"].append(group)
            ints.extend(coded)
            for c in group:
                plan["columns"][c] = {"kind": "group", "places": found[c][0]}
    for c, f in enumerate(found):
        if plan["columns"][c] is not None:
            continue
        if f is not None:
            places, values, odd = f
            k, own = differenced(values)
            best = (probe(packed(own)), -1, k, own)
            for p, order in orders.items():
                k, own = differenced(values[order])
                if packed_size(own) < packed_size(best[3]):
                    best = min(best, (probe(packed(own)), p, k, own), key=lambda b: b[:2])
            ints.extend(packed(best[3]))
            plan["columns"][c] = {"kind": "num", "places": places, "parent": best[1] if best[1] >= 0 else None, "k": best[2]}
            if odd:
                at = sorted(odd)
                ints.extend(packed(np.diff(np.array(at, np.int64), prepend=np.int64(0))))
                plan["columns"][c]["odd"] = strings([odd[i] for i in at], False)
        else:
            cells = columns[c]
            best = (probe(joined(cells)[0]), -1, cells)
            for p, order in orders.items():
                moved = [cells[i] for i in order]
                size = probe(joined(moved)[0])
                if size < best[0]:
                    best = (size, p, moved)
            plan["columns"][c] = {"kind": "text", "parent": best[1] if best[1] >= 0 else None, "cells": strings(best[2], False)}
    plan["order"] = [c for c, _ in tree]
    raw = b"".join(texts)
    streams = [lzma.compress(json.dumps(plan, separators=(",", ":")).encode(), lzma.FORMAT_RAW, filters=_TEXT), lzma.compress(bytes(ints), lzma.FORMAT_RAW, filters=_INTS), lzma.compress(raw, lzma.FORMAT_RAW, filters=_LONG if len(raw) > LONG_TEXT else _TEXT)]
    return MAGIC + struct.pack(">QQQ", *map(len, streams)) + b"".join(streams)


def _derivations(columns: list[list[str]]) -> dict[int, list[int]]:
    """target: sources, by the rule of operators.derive on a systematic sample of the block."""
    n = len(columns[0]) if columns else 0
    if n < 2:
        return {}
    sample = range(0, n, max(1, n // derive.SAMPLE_ROWS))
    token, plain = re.compile(derive.N.TOKEN), re.compile(derive.N.PLAIN)
    clean = [not (derive.OPEN in whole or derive.CLOSE in whole) for whole in map("".join, columns)]
    hits, seen = Counter(), Counter()
    for r in sample:
        offers: dict[str, set[int]] = {}
        for c, cells in enumerate(columns):
            if plain.fullmatch(cells[r]):
                most = min(derive.MOST_ROUNDING + 1, len(cells[r].partition(".")[2]))  # places that there are are not rounded away
                for text in {cells[r], *(derive._round(cells[r], d) for d in range(most))}:
                    offers.setdefault(text, set()).add(c)
        for c, cells in enumerate(columns):
            tokens = set(token.findall(cells[r])) if clean[c] else ()
            seen[c] += bool(tokens)
            for s in set().union(*(offers.get(t, ()) for t in tokens)) - {c}:
                hits[c, s] += 1
    out: dict[int, list[int]] = {}
    used: set[int] = set()
    for c in range(len(columns)):
        sources = [s for s in range(len(columns)) if hits[c, s] and 2 * hits[c, s] >= seen[c] and s not in out]
        if sources and c not in used and not all(plain.fullmatch(x) for x in columns[c]):
            out[c] = sources[: derive.MOST_SOURCES]
            used.update(out[c])
    return out


def plan_of(block: bytes) -> dict:
    """The plan alone, without the numbers and texts."""
    if block[:4] != MAGIC or len(block) < 28:
        raise Damaged("this is no block")
    sizes = struct.unpack(">QQQ", block[4:28])
    if 28 + sum(sizes) != len(block):
        raise Damaged("the streams' sizes are not the block's")
    plan = json.loads(_plain(block[28 : 28 + sizes[0]], _TEXT))
    if not isinstance(plan, dict) or plan.get("v") != VERSION:
        raise Damaged("the block is of another version")
    return plan


def _plain(raw: bytes, filters: list, most: int = MOST_BYTES) -> bytes:
    """What a stream holds; one that would become longer than `most`, or ends early, is refused before it fills the worker."""
    stream = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters)
    try:
        out = stream.decompress(raw, most + 1)
    except lzma.LZMAError as e:
        raise Damaged(str(e)) from None
    if len(out) > most:
        raise Damaged(f"a stream holds more than {most} bytes")
    if not stream.eof or stream.unused_data:
        raise Damaged("a stream does not end where it should")
    return out


def decode_block(block: bytes) -> tuple[list[str], list[list[str]]]:
    """(names, columns) of a block; the inverse of encode_block."""
    try:
        return _decoded(block)
    except Damaged:
        raise
    except (KeyError, IndexError, TypeError, ValueError, OverflowError, RecursionError) as e:
        raise Damaged(f"the block does not add up: {type(e).__name__}") from None


def _decoded(block: bytes) -> tuple[list[str], list[list[str]]]:
    plan = plan_of(block)
    sizes = struct.unpack(">QQQ", block[4:28])
    ints = memoryview(_plain(block[28 + sizes[0] : 28 + sizes[0] + sizes[1]], _INTS))
    text = _plain(block[28 + sizes[0] + sizes[1] :], _TEXT)
    n, kinds = plan["n"], plan["columns"]
    at = there = 0

    def take(size: int) -> memoryview:
        nonlocal at
        if size < 0 or at + size > len(ints):
            raise Damaged("the numbers end early")
        at += size
        return ints[at - size : at]

    def values(count: int) -> np.ndarray:
        nonlocal at
        v, used = unpacked(ints[at:], count)
        at += used
        return v

    def strings(s: dict) -> list[str]:
        nonlocal there
        shared = bytes(take(s["n"])) if s.get("front") else None
        lengths = values(s["n"]).tolist() if s.get("sizes") else None
        raw = text[there : there + s["bytes"]]
        there += s["bytes"]
        if len(raw) != s["bytes"]:
            raise Damaged("the texts end early")
        if lengths is None:
            cells = raw.decode().split("\n")
            if cells.pop() != "" or len(cells) != s["n"]:
                raise Damaged("a text is missing")
        else:
            if sum(lengths) != len(raw) or min(lengths, default=0) < 0:
                raise Damaged("the texts' lengths do not add up")
            ends = np.cumsum([0, *lengths]).tolist()
            cells = [raw[a:b].decode() for a, b in zip(ends, ends[1:])]
        if shared is not None:
            before = ""
            for i, k in enumerate(shared):
                if k > len(before):
                    raise Damaged("a word shares more than the one before it has")
                cells[i] = before = before[:k] + cells[i]
        return cells

    columns: list[list[str] | None] = [None] * len(kinds)
    orders: dict[int, np.ndarray] = {}

    def restored(v: np.ndarray, parent: int | None) -> np.ndarray:
        if parent is None:
            return v
        out = np.empty_like(v)
        out[orders[parent]] = v
        return out

    for c in plan["order"]:
        k = kinds[c]
        raw = np.frombuffer(take(n * k["width"]), f"<u{k['width']}").astype(np.int64)
        ids = restored(raw, k["parent"])
        words = strings(k["values"])
        if n and ids.max() >= len(words):
            raise Damaged("an id is not in its dictionary")
        orders[c] = np.argsort(ids, kind="stable")
        columns[c] = [words[i] for i in ids.tolist()]
    for group in plan["groups"]:
        table = values(n * len(group)).reshape(len(group), n).T.copy()
        table[1:] = np.cumsum(table[1:], axis=1)
        table = np.cumsum(table, axis=0)
        for i, c in enumerate(group):
            columns[c] = all_written(table[:, i], kinds[c]["places"])
    for c, k in enumerate(kinds):
        if columns[c] is not None:
            continue
        if k["kind"] == "num":
            if not 0 <= k["k"] <= MOST_ORDER or not 0 <= k["places"] <= MOST_DECIMALS:
                raise Damaged("an order or a number of decimals is out of range")
            v = restored(summed(values(n), k["k"]), k["parent"])
            columns[c] = all_written(v, k["places"])
            if "odd" in k:
                where = np.cumsum(values(k["odd"]["n"])).tolist()
                for i, x in zip(where, strings(k["odd"])):
                    columns[c][i] = x
        elif k["kind"] == "text":
            cells = strings(k["cells"])
            if k["parent"] is not None:
                moved = [""] * n
                for i, x in zip(orders[k["parent"]].tolist(), cells):
                    moved[i] = x
                cells = moved
            columns[c] = cells
        else:
            raise Damaged(f"a column of kind {k['kind']!r}")
    if at != len(ints) or there != len(text) or any(len(c) != n for c in columns):
        raise Damaged("something is left over or missing")
    for target, sources in plan["derived"].items():
        columns[int(target)] = [derive.expand_cell(cell, list(row)) for cell, *row in zip(columns[int(target)], *(columns[s] for s in sources))]
    return plan["names"], columns
