"""Brace-balanced scanning of markup: the one thing that regular expressions can't do."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa

#: A group without brackets of its kind or escapes in it, and the places that count in others.
_FLAT = {"{": re.compile(r"\{([^{}\\]*)\}"), "[": re.compile(r"\[([^\[\]\\]*)\]")}
_MARKS = {"{": re.compile(r"(?s)([{}])|\\."), "[": re.compile(r"(?s)([\[\]])|\\.")}


def balanced(text: str, at: int) -> int | None:
    """Place after the bracket that closes the one at place at; None if nothing does. Escaped brackets don't count."""
    opening = text[at]
    if m := _FLAT[opening].match(text, at):
        return m.end()
    depth = 0
    for m in _MARKS[opening].finditer(text, at):
        if m[1]:
            depth += 1 if m[1] == opening else -1
            if not depth:
                return m.end()
    return None


@cache
def _commands(names: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"\\({'|'.join(map(re.escape, names))})(?![^\W\d_])")


def macros(text: str, names: tuple[str, ...]) -> Iterator[tuple[str, list[str], list[str], int, int]]:
    r"""(name, options, arguments, begin, end) of every \name[option]...{argument}... whose arguments are closed."""
    size = len(text)
    for m in _commands(names).finditer(text):
        at, i = m.start(), m.end()
        before = at
        while before and text[before - 1] == "\\":
            before -= 1
        if (at - before) % 2:  # the backslash is escaped
            continue
        options, arguments = [], []
        while i < size and (c := text[i]) in "[{":
            to = balanced(text, i)
            if to is None:
                break
            (options if c == "[" else arguments).append(text[i + 1 : to - 1])
            i = to
        if arguments:
            yield m[1], options, arguments, at, i


def _lists(found: list[list[str]]) -> pa.Array:
    ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array([x for f in found for x in f], pa.string()))


MACRO_FIELDS = "name string, options array<string>, args array<string>, off int, end_off int, ord int"


def scan_macros(names: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the last column holds texts; the others, and MACRO_FIELDS of each of macros(text, names)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *m) for i, text in enumerate(batch.columns[-1].to_pylist()) if text for k, m in enumerate(macros(text, names))]
            if not rows:
                continue
            at, ord_, name, options, args, off, end = zip(*rows)
            kept = batch.select(batch.schema.names[:-1]).take(pa.array(at, pa.int32()))
            made = [pa.array(name, pa.string()), _lists(options), _lists(args), pa.array(off, pa.int32()), pa.array(end, pa.int32()), pa.array(ord_, pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*kept.schema.names, "name", "options", "args", "off", "end_off", "ord"])

    return scan


def open_depths(text: str, environments: tuple[str, ...]) -> list[tuple[int, int]]:
    """(place, depth) of every item at the least depth of lists; the depth counts open environments."""
    depth, items = 0, []
    for m in re.finditer(r"\\(begin|end)\{([a-z*]+)\}|\\item\b", text):
        if m[1] and m[2] in environments:
            depth += 1 if m[1] == "begin" else -1
        elif not m[1]:
            items.append((m.start(), depth))
    least = min((d for _, d in items), default=0)
    return [(at, d) for at, d in items if d == least]
