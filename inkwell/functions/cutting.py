r"""Cutting a text at a sentence without opening mathematics: native expressions.

A cut inside \[..\], $$..$$, \(..\) or $..$ is moved behind the closing delimiter if that is near, else back
to before the opening one. Delimiters are told apart in this order, by counts over what is kept, and
places come from the lengths of the pieces between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions import text as tx
from inkwell.functions.text import let


def last_place(c: Column, piece: str) -> Column:
    """Where the last occurrence of piece begins, from 0; -1 without one."""
    return let(F.instr(F.reverse(c), piece[::-1]), lambda back: F.when(back > 0, F.length(c) - back - len(piece) + 1).otherwise(-1))


def _before(parts: Column, n: Column, width: int) -> Column:
    """Characters before the delimiter number n (from 0), each of width characters."""
    return F.length(F.array_join(F.slice(parts, F.lit(1), n + 1), "x" * width))


def open_math(c: Column) -> Column:
    """kind and place of the delimiter that c leaves open; null if none is."""
    squares, rounds = F.split(c, r"(?<!\\)\\\["), F.split(c, r"\\\(")
    n_squares, n_rounds = tx.count(c, r"(?<!\\)\\\]"), tx.count(c, r"\\\)")
    doubles = F.split(c, r"\$\$")
    singles = F.split(c, r"(?<!\\)\$(?!\$)")
    left = F.replace(F.replace(c, F.lit("$$"), F.lit("")), F.lit("\\$"), F.lit(""))
    last = lambda parts, width: F.length(c) - F.length(F.element_at(parts, -1)) - width
    state = lambda kind, place: F.struct(F.lit(kind).alias("kind"), place.alias("place"))
    return (
        F.when(F.size(squares) - 1 > n_squares, state("square", _before(squares, n_squares, 2)))
        .when(F.size(doubles) % 2 == 0, state("double", last(doubles, 2)))
        .when(F.size(rounds) - 1 > n_rounds, state("round", _before(rounds, n_rounds, 2)))
        .when((tx.count(left, r"\$") % 2 == 1) & (F.size(singles) > 1), state("single", last(singles, 1)))
    )


def moved(c: Column, at: Column, reach: int = fixed.MATH_REACH) -> Column:
    """The cut at, moved so that no mathematics stays open in front of it."""
    def behind(width: int) -> Callable[[Column], Column]:
        return lambda parts: F.when((F.size(parts) > 1) & (F.length(parts[0]) <= reach), at + F.length(parts[0]) + width)

    def by(state: Column, rest: Column) -> Column:
        out = F.when(state.isNull(), at)
        for kind, closer, width in (("square", r"\\\]", 2), ("double", r"\$\$", 2), ("round", r"\\\)", 2), ("single", r"(?<!\\)\$", 1)):
            found = let(F.split(rest, closer, 2), behind(width))
            out = out.when(state["kind"] == kind, F.coalesce(found, state["place"]))
        return out

    return let(let(F.substr(c, F.lit(1), at), open_math), lambda state: let(F.substr(c, at + 1), lambda rest: by(state, rest)))


def _tail(c: Column, kept: Column, header: str) -> Column:
    """The section under a header that c has and kept hasn't, at most 300 characters; null otherwise."""
    found = F.regexp_extract(c, rf"(?is)({header}.*?)(?:\n\s*+(?:{'|'.join(fixed.SOLUTION_HEADERS)})|\z)", 1)

    def shortened(section: Column) -> Column:
        head = F.substring(section, 1, 300)
        return F.when(F.length(section) <= 300, section).otherwise(let(last_place(head, ". "), lambda stop: F.when(stop > 100, F.substr(head, F.lit(1), stop + 1)).otherwise(F.concat(tx.rstrip(head), F.lit("...")))))

    return F.when(~kept.rlike(f"(?i){header}"), let(tx.strip(F.nullif(found, F.lit(""))), shortened))


def cut(c: Column | str, most: int) -> Column:
    """c in about most characters: to the last end of a sentence, of a word, or hard; never inside mathematics.

    Of the kinds of sentence ends the first that lies beyond 40 % counts. A text with embedded images may have
    15,000 characters. Sections of answers and key insights that the cut drops are put behind it.
    c is worked out once, however long its expression is.
    """
    return let(tx.col(c), lambda whole: _cut(whole, most))


def _cut(c: Column, most: int) -> Column:
    limit = F.when(F.contains(c, F.lit("data:image")) & F.contains(c, F.lit("base64")), F.lit(max(most, fixed.IMAGE_LENGTH))).otherwise(F.lit(most))

    def image_safe(head: Column) -> Column:
        image = F.contains(head, F.lit("<img ")) & ~F.contains(head, F.lit("</img>")) & ~F.contains(F.substr(head, last_place(head, "<img") + 1), F.lit(">"))
        return F.when(image, let(last_place(head, ">"), lambda p: F.when(p > limit * 0.5, F.substr(head, F.lit(1), p + 1)).otherwise(head))).otherwise(head)

    def at_sentence(head: Column) -> Column:
        return F.coalesce(*(let(last_place(head, p), lambda e: F.when(e > limit * 0.4, e + 1)) for p in fixed.SENTENCE_ENDS))

    def at_word(head: Column) -> Column:
        return let(last_place(head, " "), lambda e: F.when(e > limit * 0.8, e).otherwise(limit))

    def whole(sentence: Column, at: Column, safe: Column) -> Column:
        body = tx.strip(F.substr(c, F.lit(1), safe))
        dotted = let(body, lambda b: F.when(sentence.isNull() & (safe == at) & ~F.endswith(b, F.lit("...")), F.concat(b, F.lit("..."))).otherwise(b))
        return let(dotted, lambda d: F.concat_ws("\n\n", d, *(_tail(c, d, h) for h in fixed.SOLUTION_HEADERS[:2])))

    def from_head(head: Column) -> Column:
        return let(at_sentence(head), lambda s: let(F.coalesce(s, at_word(head)), lambda at: let(moved(c, at), lambda safe: whole(s, at, safe))))

    return F.when(F.length(c) <= limit, c).otherwise(let(let(F.substr(c, F.lit(1), limit), image_safe), from_head))
