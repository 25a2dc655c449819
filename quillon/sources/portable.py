"""SPSS portable files: text in lines of 80 characters, numbers in base 30."""

from __future__ import annotations

import math

import numpy as np

from quillon.sources.bytes_in import Refused
from quillon.sources.spss import FORMATS, _NUMBER_OF
from quillon.sources.stats import Dataset, Variable

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRST"
#: The characters of a portable file's table from place 64 on, in order.
TABLE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz .<(+|&[]!$*);^-/|,%_>?`:#@'=\"      ~-   0123456789   -() {}\\"


class _Text:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def take(self, n: int) -> str:
        if self.at + n > len(self.text):
            raise Refused("the file ends early")
        self.at += n
        return self.text[self.at - n : self.at]

    def number(self) -> float | None:
        """A number in base 30 up to its slash; None for system missing, an asterisk and a full stop."""
        while self.text[self.at : self.at + 1] == " ":
            self.at += 1
        if self.text[self.at : self.at + 1] == "*":
            self.take(2)
            return None
        end = self.text.find("/", self.at)
        if end < 0:
            raise Refused("a number has no end")
        body = self.take(end - self.at + 1)[:-1]
        sign, body = (-1.0, body[1:]) if body[:1] == "-" else (1.0, body)
        cut = max(body.rfind("+"), body.rfind("-"))
        power = int(body[cut:], 30) if cut > 0 else 0
        whole, _, rest = (body[:cut] if cut > 0 else body).partition(".")
        digits = (whole + rest).lstrip("0") or "0"
        try:
            value = int(digits, 30)
        except ValueError:
            raise Refused(f"{body!r} is no number") from None
        power -= len(rest)
        return sign * (float(value * 30**power) if power >= 0 else value / 30**-power)

    def whole(self) -> int:
        return int(self.number() or 0)

    def string(self) -> str:
        return self.take(self.whole())


def parse(raw: bytes) -> Dataset:
    lines = raw.decode("latin-1").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    text = "".join(x.ljust(80)[:80] for x in lines if x or x == "")
    if text[456:464] != "SPSSPORT":
        raise Refused("this is no portable file")
    f = _Text(text[464:])
    f.take(1)  # the format's version
    f.string(), f.string()  # day and time
    variables: list[Variable] = []
    sets: dict[str, dict[float, str]] = {}
    notes: list[str] = []
    while True:
        tag = f.take(1)
        if tag in "123":
            f.string()
        elif tag == "4":
            f.whole()
        elif tag == "5":
            f.whole()
        elif tag == "6":
            f.string()
        elif tag == "7":
            width = f.whole()
            name = f.string()
            kind, size, places = f.whole(), f.whole(), f.whole()
            f.whole(), f.whole(), f.whole()
            shown = FORMATS.get(kind, "F") + str(size) + (f".{places}" if places else "")
            variables.append(Variable(name, width > 0, width or 8, "", shown))
        elif tag == "8":
            value = f.string() if variables[-1].text else f.number()
            if value is not None and not variables[-1].text:
                variables[-1].missing.append((value, value))
        elif tag in "9A":
            value = f.number()
            variables[-1].missing.append((-math.inf, value) if tag == "9" else (value, math.inf))
        elif tag == "B":
            variables[-1].missing.append((f.number(), f.number()))
        elif tag == "C":
            variables[-1].label = f.string()
        elif tag == "D":
            names = [f.string() for _ in range(f.whole())]
            own = [v for v in variables if v.name in names]
            pairs = [(f.string() if own and own[0].text else f.number(), f.string()) for _ in range(f.whole())]
            if own and not own[0].text:
                key = f"labels{len(sets)}"
                sets[key] = {k: t for k, t in pairs if k is not None}
                for v in own:
                    v.labels = key
        elif tag == "E":
            notes += [f.string() for _ in range(f.whole())]
        elif tag == "F":
            break
        else:
            raise Refused(f"a record of kind {tag!r}")
    columns: list = [[] for _ in variables]
    while variables and f.text[f.at : f.at + 1] not in ("Z", ""):
        for v, c in zip(variables, columns):
            c.append(f.string().rstrip(" ") if v.text else f.number())
    typed = [c if v.text else (np.array([math.nan if x is None else x for x in c]), ["" if x is None else None for x in c]) for v, c in zip(variables, columns)]
    return Dataset("spss", variables, typed, "", sets, notes)


def base30(x: float) -> str:
    """The exact number in base 30, up to its slash: a whole number, times a power of 30 where that is shorter."""
    if x == 0:
        return "0/"
    sign, (top, bottom) = ("-" if x < 0 else ""), abs(x).as_integer_ratio()
    power = 0
    while bottom > 1 and power < 1100:  # a power of two below divides a power of thirty
        top, power = top * 30, power + 1
        while bottom > 1 and top % 2 == 0:
            top, bottom = top // 2, bottom // 2
    top = round(top / bottom) if bottom > 1 else top
    while top % 30 == 0 and top:
        top, power = top // 30, power - 1
    digits = ""
    n = top
    while n:
        n, d = divmod(n, 30)
        digits = DIGITS[d] + digits
    if not power:
        return f"{sign}{digits}/"
    places, n = "", abs(power)
    while n:
        n, d = divmod(n, 30)
        places = DIGITS[d] + places
    return f"{sign}{digits}{'-' if power > 0 else '+'}{places}/"


def written(data: Dataset) -> bytes:
    """A portable file; texts must be in Latin-1."""
    out: list[str] = []
    string = lambda s: out.append(base30(float(len(s))) + s)
    number = lambda x: out.append(base30(float(x)))
    out.append("A")
    string("19700101")
    string("000000")
    out.append("4")
    number(len(data.variables))
    out.append("5")
    number(17)
    for v in data.variables:
        name = "".join(c for c in v.shown if c.isalpha()).upper()
        size, _, places = v.shown[len(name) :].partition(".")
        kind = 1 if v.text else _NUMBER_OF.get(name, 5)
        shape = (kind, min(255, v.width) if v.text else int(size or 8), 0 if v.text else int(places or (0 if size else 2)))
        out.append("7")
        number(v.width if v.text else 0)
        string(v.name)
        for x in (*shape, *shape):
            number(x)
        for low, high in [] if v.text else v.missing:
            out.append("8" if low == high else "B")
            number(low)
            if low != high:
                number(high)
        if v.label:
            out.append("C")
            string(v.label)
    for name, s in data.sets.items():
        own = [v for v in data.variables if v.labels == name and not v.text]
        if own:
            out.append("D")
            number(len(own))
            for v in own:
                string(v.name)
            number(len(s))
            for x, t in s.items():
                number(x)
                string(t)
    if data.notes:
        out.append("E")
        number(len(data.notes))
        for note in data.notes:
            string(note)
    out.append("F")
    for r in range(data.rows):
        for v, c in zip(data.variables, data.columns):
            if v.text:
                string(c[r] or " ")
            else:
                out.append("*." if c[1][r] is not None else base30(float(c[0][r])))
    body = "".join(out) + "Z"
    try:
        raw = body.encode("latin-1")
    except UnicodeEncodeError:
        raise Refused("a text has characters that a portable file cannot hold") from None
    head = b"".join(x.ljust(40) for x in (b"ASCII SPSS PORT FILE",) * 5) + (b"0" * 64 + TABLE.encode("ascii"))[:256].ljust(256, b"0") + b"SPSSPORT"
    whole = head + raw
    whole = whole.ljust(-(-len(whole) // 80) * 80, b"Z")
    return b"".join(whole[i : i + 80] + b"\r\n" for i in range(0, len(whole), 80))
