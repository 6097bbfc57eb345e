"""Operator 11: licence notices and licence expressions.

A text is reduced to its words (A-Z lower-cased, one blank between two), and one Aho-Corasick
automaton finds all phrases in it. Base: four fixed names of licences. Method: longer notices, whose
labels are added, and identifier tags. What follows a tag is read as a licence expression: a
shunting-yard parser puts its ids, `and`, `or`, `with` (binding in that order from loosest: or, and,
with) and brackets into postfix order, and evaluating that gives the ids' labels and whether the
expression can be met by permissive licences alone.

After an SPDX tag every id counts, an unknown one as label `other`; after `license:` or `licensed
under` only known ones do, and an expression that doesn't begin with one is none. An expression ends
at its line's end, or at the first token that can't go on. A faulty one (brackets that don't match,
an operator without operand, `with` before something that isn't a known exception) gives the
labels of the ids read, and no expression.

Null or empty text: no words, no labels, score 0. Phrases may overlap; each place counts. Repeated
rows are scanned each. Texts are read whole, in time that grows with their length. Extra columns are
ignored except those named in keep.

score: 1 less the product of what each kind of evidence leaves open (WEIGHTS), each counted once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Base phrases and labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Words of common notices, and labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the mit licence": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "apache software license": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "boost software license": "bsl",
    "python software foundation license": "psf",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "sil open font license": "ofl",
}

#: Words before an expression, and whether a colon or equals sign has to follow.
TAGS = {"spdx license identifier": True, "license": True, "licence": True, "license expression": True, "licensed under": False, "released under": False, "distributed under": False}
SPDX = "spdx license identifier"

#: Families of identifiers, and those that ask for no more than a notice.
FAMILIES = "0bsd afl agpl apache artistic bsd bsl cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cc0 cddl cecill cpl ecl epl eupl gfdl gpl isc lgpl mit mpl ms-pl ncsa ofl openssl osl postgresql psf python unlicense upl wtfpl x11 zlib zpl".split()
PERMISSIVE = frozenset("0bsd afl apache bsd bsl cc-by cc0 isc mit ms-pl ncsa postgresql psf python unlicense upl wtfpl x11 zlib zpl".split())
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|llvm-exception|classpath(?:-[a-z0-9.-]+)?|gcc-[a-z0-9.-]+|font-[a-z0-9.-]+|linux-syscall-note")
#: What an identifier may have behind its family's name.
SUFFIX = re.compile(r"(?:-[0-9]+-clause[a-z-]*|-?v?[0-9][0-9.]*)?(?:-only|-or-later|\+)?")

WEIGHTS = {"base": 0.7, "notice": 0.8, "spdx": 0.95, "expression": 0.6, "faulty": 0.4}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: An operand with what may stand around its name, an operator or a bracket; blanks and quotes before it.
TOKEN = re.compile(rb"""[\x20\t"'`*\[]{0,8}(?:(\()|(\))|(?:the\x20|either\x20(?:of\x20)?)?([a-z0-9][a-z0-9.+-]{0,80})(?:\x20(by(?:-(?:nc|nd|sa))*))?(?:\x20(?:public\x20)?licen[sc]e\b)?(?:,?\x20(?:version\x20|v)?[0-9][0-9.]{0,10})?)""")

#: What stands between a tag and its expression.
NAMED = re.compile(rb"""["']?\x20{0,4}[:=]""")
UNDER = re.compile(rb"""(?:\x20the\x20terms\x20of)?""")

_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def label_of(name: str) -> str | None:
    """The family of an identifier."""
    name = name.rstrip(".-")
    for family in sorted(FAMILIES, key=len, reverse=True):
        if name.startswith(family) and SUFFIX.fullmatch(name, len(family)):
            return family
    return None


class Expression:
    """Shunting-yard: operands go to the output, operators wait until one that binds no tighter comes."""

    def __init__(self, strict: bool):
        self.strict = strict
        self.output: list[tuple[str, str]] = []
        self.operators: list[str] = []
        self.labels: list[str] = []
        self.sound = True

    def push(self, operator: str) -> None:
        while self.operators and self.operators[-1] != "(" and PRECEDENCE[self.operators[-1]] >= PRECEDENCE[operator]:
            self.output.append(("operator", self.operators.pop()))
        self.operators.append(operator)

    def read(self, text: bytes, at: int, end: int) -> int:
        """Reads an expression that begins at a place; gives where it ends, and sets what it holds."""
        operand = True  # an operand comes next
        while at < end:
            m = TOKEN.match(text, at, end)
            if not m:
                break
            word = (b"cc-" + m[4] if m[3] == b"cc" and m[4] else m[3].rstrip(b".-")).decode() if m[3] else ""
            if m[1]:
                if not operand:
                    break
                self.operators.append("(")
            elif m[2]:
                if operand or "(" not in self.operators:
                    self.sound = self.sound and not operand
                    break
                while self.operators[-1] != "(":
                    self.output.append(("operator", self.operators.pop()))
                self.operators.pop()
            elif operand and self.operators and self.operators[-1] == "with":
                if not EXCEPTION.fullmatch(word):
                    break
                self.output.append(("exception", word))
                operand = False
            elif operand:
                label = label_of(word)
                if label is None and (self.strict or word in PRECEDENCE):
                    break
                self.labels.append(label or "other")
                self.output.append(("id", word))
                operand = False
            elif word in PRECEDENCE:
                if word == "with" and self.output[-1][0] != "id":
                    break
                self.push(word)
                operand = True
                # an operand's optional words belong to operands only
                at = m.start(3) + len(word)
                continue
            else:
                break
            at = m.end()
        self.sound = self.sound and not operand and "(" not in self.operators
        while self.operators:
            operator = self.operators.pop()
            if operator != "(":
                self.output.append(("operator", operator))
        return at

    def value(self) -> tuple[str, bool] | None:
        """The postfix form evaluated: written out with brackets only where needed, and whether permissive licences meet it."""
        if not self.sound or not self.output:
            return None
        stack: list[tuple[str | tuple, bool]] = []
        for kind, word in self.output:
            if kind != "operator":
                stack.append((word, kind == "exception" or label_of(word) in PERMISSIVE))
                continue
            right, left = stack.pop(), stack.pop()
            met = (left[1] or right[1]) if word == "or" else (left[1] and right[1])
            stack.append(((word, left[0], right[0]), met))
        return written(stack[0][0]), stack[0][1]


def written(tree: str | tuple) -> str:
    """An operator's tree as text. No recursion: brackets may be nested deeply."""
    out, pending = [], [tree]
    while pending:
        one = pending.pop()
        if isinstance(one, str):
            out.append(one)
            continue
        operator, *sides = one
        left, right = (["(", side, ")"] if isinstance(side, tuple) and PRECEDENCE[side[0]] < PRECEDENCE[operator] else [side] for side in sides)
        pending += [*reversed(right), f" {operator} ", *reversed(left)]
    return "".join(out)


class Scanner:
    """All phrases in one automaton."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
            for phrase, label in table.items():
                kinds.setdefault(phrase, []).append((kind, label))
        for phrase, found in kinds.items():
            self.automaton.add_word(f" {phrase} ", (phrase, found))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        """One row of SCHEMA."""
        data = np.frombuffer(text.encode(), np.uint8)
        lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        word = _WORD[lower]
        edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
        n_words = int((edge == 1).sum())
        empty = (n_words, 0, None, None, "", "", [], False, 0.0)
        if not n_words:
            return empty
        # one blank before each word and one behind the last
        starts = np.flatnonzero(edge == 1)
        kept = word.copy()
        kept[starts[1:] - 1] = True
        clean = np.where(word, lower, np.uint8(32))[kept].tobytes().decode()
        hits = list(self.automaton.iter(f" {clean} "))
        if not hits:
            return empty
        # words before each hit; the blanks up to an end are counted once
        base, labels, evidence, tags, at, words = [], set(), set(), [], 0, 0
        padded = f" {clean} "
        for end, (phrase, found) in hits:
            words += padded.count(" ", at, end + 1)
            at = end + 1
            last = words - 2  # the phrase's last word
            first = last - phrase.count(" ")
            for kind, label in found:
                if kind == "base":
                    base.append((first, label))
                elif kind == "notice":
                    labels.add(label)
                    evidence.add(kind)
                else:
                    tags.append((phrase, last))
        expressions, permissive = [], False
        if tags:
            raw = lower.tobytes()
            ends = np.flatnonzero(edge == -1)
            done, stop = 0, -1
            for phrase, last in tags:
                begin = int(ends[last])
                if begin < done:
                    continue
                opening = (NAMED if TAGS[phrase] else UNDER).match(raw, begin)
                if not opening:
                    continue
                if stop < begin:
                    stop = raw.find(b"\n", begin)
                    stop = stop if stop >= 0 else len(raw)
                one = Expression(phrase != SPDX)
                done = one.read(raw, opening.end(), stop)
                if not one.labels:
                    continue
                labels.update(one.labels)
                result = one.value()
                evidence.add("faulty" if result is None else "spdx" if phrase == SPDX else "expression")
                if result is not None:
                    expressions.append(result[0])
                    permissive = permissive or result[1]
        named = {label for _, label in base}
        open_ = 1.0
        for kind in evidence | ({"base"} if base else set()):
            open_ *= 1 - WEIGHTS[kind]
        first = min((f for f, _ in base), default=None)
        final = max((f for f, _ in base), default=None)
        return n_words, len(base), first, final, ",".join(sorted(named)), ",".join(sorted(named | labels)), expressions, permissive, 1 - open_


SCHEMA = (
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("expressions", T.ArrayType(T.StringType())),
    T.StructField("permissive", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
)
_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.float64())


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep and, per row, counts, places, labels, expressions in their written-out form, whether any can be met by
    permissive licences alone, and the score."""
    kept = [f for f in df.schema if f.name in keep]
    names = [f.name for f in (*kept, *SCHEMA)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = common.kept("licences", Scanner)
        for whole in batches:
            _, at = common.buffers(whole.column(text))
            for lo, hi in common.passes(at, 8 << 20):
                batch = whole.slice(lo, hi - lo)
                rows = [scanner.scan(value or "") for value in batch.column(text).to_pylist()]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, names=names)

    return df.select(*dict.fromkeys((*keep, text))).mapInArrow(run, T.StructType([*kept, *SCHEMA]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.withColumn("expressions", F.array_join("expressions", "; "))
