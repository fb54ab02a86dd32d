"""Many literal replacements in a text, in time that grows with the text and not with text times values.

Two meanings. One after another: each value in its turn is replaced wherever it stands, also in what earlier ones have put there. All at
once: one pass from the left, the longest value where several fit, and what has been put there is not looked at again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A stretch that no place parts is looked up place by place up to this length, and by one search per value beyond it.
SHORT = 400


class Replacer:
    """Replacements of one list of values, for any number of texts. Of equal values the first counts; empty ones are skipped."""

    def __init__(self, pairs: Iterable[tuple[str, str]], longest: bool = True) -> None:
        to = {}
        for value, new in pairs:
            if value:
                to.setdefault(value, new)
        self.values = sorted(to, key=len, reverse=True) if longest else list(to)
        self.to = [to[v] for v in self.values]
        self.turn = {v: i for i, v in enumerate(self.values)}
        sizes: dict[str, set[int]] = {}
        for v in self.values:
            sizes.setdefault(v[0], set()).add(len(v))
        self.sizes = {c: sorted(n, reverse=True) for c, n in sizes.items()}
        self.first = re.compile(f"[{re.escape(''.join(self.sizes))}]") if self.sizes else None
        self._known: dict[str, str] = {}
        self._parts = None
        self._apart: bool | None = None
        self._touching: set[int] | None = None

    def once(self, text: str) -> str:
        out, at = [], 0
        hit = self.first.search(text) if self.first else None
        while hit:
            p = hit.start()
            for n in self.sizes[text[p]]:
                turn = self.turn.get(text[p : p + n])
                if turn is not None:
                    out += text[at:p], self.to[turn]
                    at = p = p + n
                    break
            else:
                p += 1
            hit = self.first.search(text, p)
        return "".join((*out, text[at:])) if at else text

    def in_turn(self, text: str) -> str:
        if not self.values:
            return text
        out, at, known = [], 0, self._known
        for p in self._cuts(text):
            part = text[at:p]
            if part:
                new = known.get(part)
                if new is None:
                    new = known[part] = self._settled(part)
                out.append(new)
            out.append(text[p])
            at = p + 1
        out.append(self._settled(text[at:]))
        return "".join(out)

    def _cuts(self, text: str) -> Iterator[int]:
        """Places whose character no match can hold, whatever has been replaced before: what lies between is worked on for itself.

        That is a character of no value, or one whose neighbours, as they are or as any replacement would leave them, stand beside it
        in no value.
        """
        if self._parts is None:
            signs = set("".join(self.values))
            ends, starts = {v[-2:] for v in self.values}, {v[:2] for v in self.values}
            inner = {v[i - 1 : i + 2] for v in self.values for i in range(1, len(v) - 1) if not v[i].isalnum()}
            left, right = {t[-1:] for t in self.to}, {t[:1] for t in self.to}
            word = "".join(re.escape(c) for c in signs if c.isalnum())
            self._parts = signs, ends, starts, inner, left, right, re.compile(f"[^{word}]" if word else "(?s).")
        signs, ends, starts, inner, left, right, maybe = self._parts
        seen: dict[str, bool] = {}
        for hit in maybe.finditer(text):
            p, c = hit.start(), hit.group()
            if c not in signs:
                yield p
                continue
            a, b = text[p - 1 : p] if p else "", text[p + 1 : p + 2]
            free = seen.get(a + c + b) if a and b else None
            if free is None:
                befores, afters = left | {a}, right | {b}
                # A replacement that is empty leaves any neighbour at all.
                free = c not in self.turn and "" not in left and not any(x + c in ends for x in befores) and not any(c + y in starts for y in afters) and not any(x + c + y in inner for x in befores for y in afters)
                if a and b:
                    seen[a + c + b] = free
            if free:
                yield p

    def _places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Start, end and turn of every value that stands in a text."""
        turn = self.turn
        for p, c in enumerate(text):
            for n in self.sizes.get(c, ()):
                part = text[p : p + n]
                k = turn.get(part)
                # At the text's end what is left may be a shorter value, which has its own size.
                if k is not None and len(part) == n:
                    yield p, p + n, k

    def _settled(self, part: str) -> str:
        if len(part) > SHORT:
            return self._settled_long(part)
        k = -1
        while True:
            k = min((i for _, _, i in self._places(part) if i > k), default=None)
            if k is None:
                return part
            part = part.replace(self.values[k], self.to[k])

    def _settled_long(self, part: str) -> str:
        """Where no value holds the first or last sign of a replacement, no match can reach from one into what stands beside it, so every
        place that no value covers parts the text. Else the values that stand in the part, and those that may come to stand where something
        has been replaced, each in its turn."""
        places = list(self._places(part))
        if self._apart is None:
            edges = {t[:1] for t in self.to} | {t[-1:] for t in self.to}
            self._apart = "" not in edges and not any(c in edges for v in self.values for c in v)
        if self._apart:
            out, at, end = [], 0, 0
            for start, stop, _ in [*places, (len(part), len(part), 0)]:
                if start >= end:
                    out += self._covered(part[at:end]), part[end:start]
                    at = start
                end = max(end, stop)
            return "".join(out)
        return self._each(part, {k for _, _, k in places})

    def _covered(self, part: str) -> str:
        if len(part) > SHORT:
            return self._each(part, {k for _, _, k in self._places(part)})
        new = self._known.get(part)
        if new is None:
            new = self._known[part] = self._settled(part)
        return new

    def _each(self, part: str, turns: set[int]) -> str:
        if self._touching is None:
            heads, tails, inner = ({t[:i] for t in self.to for i in range(len(t) + 1)}, {t[i:] for t in self.to for i in range(len(t) + 1)}, set(self.to))
            parts = {t[i:j] for t in inner for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
            touch = lambda v: v in parts or any(v[i:] in heads or v[:i] in tails for i in range(1, len(v))) or any(v[i:j] in inner for i in range(len(v)) for j in range(i, len(v) + 1))
            self._touching = {i for i, v in enumerate(self.values) if touch(v)}
        for k in sorted(turns | self._touching):
            part = part.replace(self.values[k], self.to[k])
        return part


def _lists(column: pa.Array) -> Iterator[list | None]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for x in column:
        yield x.as_py() if x.is_valid else None


def _replaced(way: str):
    def run(texts: pa.Array, values: pa.Array, to: pa.Array) -> pa.Array:
        out = []
        for own, v, t in zip(_lists(texts), _lists(values), _lists(to), strict=True):
            if own is None:
                out.append(None)
                continue
            each = Replacer(zip(v or [], t or [], strict=True), longest=way != "as given")
            work = each.once if way == "once" else each.in_turn
            out.append([None if x is None else work(x) for x in own])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def replaced(texts: Column, entries: Column, way: str = "longest") -> Column:
    """An array of texts with the same entries (value, to) replaced in each. way: `longest` first or `as given`, one after another; or all at `once`."""
    return _replaced(way)(texts, F.transform(entries, lambda e: e["value"]), F.transform(entries, lambda e: e["to"]))
