"""Texts that differ in numbers only are read once.

The SQL reader copies digits and compares them, but never looks at their value: no rule of it takes 12 for anything else than 34. So
two texts that are equal but for their runs of digits, where the same places hold equal runs, give the same rows but for these runs.
Rows of the first such text, read with a mark for each distinct run, are a template that gives those of all others by filling in.

Exceptions are read as they are: runs that stand in words the reader knows (nvl2) count as letters, and a text in which strings are
joined digit to digit (dynamic SQL) has no template, as two joined strings can be equal where their parts are not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from operator import itemgetter

from codeloom.sources.plsql import WORDS

_NUMBER = re.compile(r"([0-9]+)")
#: Runs of digits that are a part of words which the reader knows.
_KNOWN = sorted({x.encode() for w in WORDS for x in _NUMBER.findall(w)})
#: Digits of UTF-8 with a blank for all else, and all else with \xff, which UTF-8 does not have, for digits; texts are parted by \xfe.
_DIGITS = bytes(i if 48 <= i < 58 else 32 for i in range(256))
_OTHERS = bytes(255 if 48 <= i < 58 else i for i in range(256))
#: A mark is this and five digits more; it begins like no other part of itself, so digits before it hide none.
_MARK = "830415926162712"
_SLOT = re.compile(rf"({_MARK}[0-9]{{5}}|\x02)")
#: What stands for the path and between strings in a template; texts that hold either are read as they are.
_OWN = re.compile("[\x02\x03]")
#: Templates that a worker keeps, all characters of their shapes, those of one text at most, and shapes that were met once.
MOST_SHAPES, MOST_HELD, LONGEST, MOST_MET = 2_000, 16 << 20, 100_000, 200_000

Reads = Callable[[str, str, dict], tuple[list[tuple], bool]]


class _Template:
    """Rows, as columns, of texts of one shape."""

    def __init__(self, rows: list[tuple]):
        # No row holds a bool beside an int, so a value names itself.
        values = dict.fromkeys(v for row in rows for v in row)
        varied = [v for v in values if isinstance(v, str) and _SLOT.search(v)]
        self.fixed = [v for v in values if not (isinstance(v, str) and _SLOT.search(v))]
        place = {v: i for i, v in enumerate([*self.fixed, *varied])}
        self.columns = [tuple(place[v] for v in c) for c in zip(*rows)]
        self.pick = [itemgetter(*c) if len(c) > 1 else None for c in self.columns]
        parts = _SLOT.split("\x03".join(varied))
        self.text = "%s".join(x.replace("%", "%%") for x in parts[::2])
        self.slots = [0 if x == "\x02" else 1 + int(x[len(_MARK) :]) for x in parts[1::2]]
        self.any = bool(varied)

    def fill(self, held: list[list], path: str, numbers: Iterable[bytes]) -> None:
        values = (path, *[x.decode() for x in numbers])
        pool = self.fixed + (self.text % tuple([values[i] for i in self.slots])).split("\x03") if self.any else self.fixed
        for out, column, pick in zip(held, self.columns, self.pick):
            out += pick(pool) if pick else (pool[column[0]],)


class Shapes:
    """Rows of texts by their shapes. read gives the rows of a text, its file's path and specifications, and whether strings were joined digit to digit."""

    def __init__(self, read: Reads):
        self.read, self.made, self.met, self.held = read, {}, set(), 0

    def add(self, held: list[list], path: str, text: str, specs: dict[str, str]) -> bool:
        """Appends the rows of a text to the columns held; False if it must be read as it is."""
        if len(text) > LONGEST or "\x03" in path:
            return False
        data = b"\xfe".join([x.encode() for x in (text, *(x for kv in specs.items() for x in kv))])
        seen: dict[bytes, int] = {}
        number = seen.setdefault
        places = tuple([number(x, len(seen)) for x in data.translate(_DIGITS).split()])
        # What stands between runs, whatever their lengths.
        between = b"\xff".join([x for x in (b"\xfe" + data + b"\xfe").translate(_OTHERS).split(b"\xff") if x])
        key = (between, places, tuple([seen.get(x) for x in _KNOWN]))
        template = self.made.get(key)
        if template is None:
            if key in self.made:
                return False
            name = hash(key)
            if name not in self.met:
                # A shape that does not come again is not worth a template.
                if len(self.met) >= MOST_MET:
                    self.met.clear()
                self.met.add(name)
                return False
            template = self._make(path, text, specs, seen)
            if len(self.made) >= MOST_SHAPES or self.held > MOST_HELD:
                self.made.clear()
                self.held = 0
            self.made[key] = template
            self.held += len(data)
            if template is None:
                return False
        template.fill(held, path, seen)
        return True

    def _make(self, path: str, text: str, specs: dict[str, str], seen: dict[bytes, int]) -> _Template | None:
        whole = [text, *(x for kv in specs.items() for x in kv)]
        if len(seen) >= 100_000 or any(_OWN.search(x) or _MARK in x for x in whole):
            return None
        number = lambda m: m[0] if m[0].encode() in _KNOWN else f"{_MARK}{seen[m[0].encode()]:05}"
        marked = lambda x: _NUMBER.sub(number, x)
        rows, joined = self.read("\x02", marked(text), {marked(k): marked(v) for k, v in specs.items()})
        if joined or not rows:
            return None
        made, held = _Template(rows), [[] for _ in rows[0]]
        # The rows of the text that it was made for must come out, whatever else holds.
        made.fill(held, path, seen)
        return made if list(zip(*held)) == self.read(path, text, specs)[0] else None
