r"""Scans that keep places: masking that changes no offset, balanced removal, reference entries, vetting of commands.

All but the vetting are native expressions. Nesting is followed to NESTED levels of braces.
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.window import Window

from inkwell.functions import fixed
from inkwell.functions import text as tx

NESTED = 8


def blanked(c: Column | str, pattern: str) -> Column:
    """c with every match of pattern made as many blanks; c is worked out once, so that blankings may be nested."""
    def of(text: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
        pairs = F.arrays_zip(F.split(text, pattern).alias("part"), hits.alias("hit"))
        return F.array_join(F.transform(pairs, lambda z: F.concat(z["part"], F.coalesce(z["hit"], F.lit("")))), "")

    return tx.let(tx.col(c), of)


def masked(c: Column | str) -> Column:
    """c with code and mathematics made blanks, so that what stands elsewhere keeps its place."""
    out = tx.col(c)
    for pattern in fixed.PROTECTED:
        out = blanked(out, pattern)
    return out


def stray_angles(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, place (from 1) and mark of every angle bracket outside code, mathematics and tags."""
    bare = blanked(masked(text), r"</?[A-Za-z][^<>]*>|<!--.*?-->")
    d = docs.where(F.col(text).rlike("[<>]")).select(*keep, bare.alias("bare_"))
    parts = F.split("bare_", r"(?=[<>])")
    d = d.select(*keep, F.posexplode(parts).alias("k_", "part"))
    before = Window.partitionBy(*keep).orderBy("k_").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("place", (F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)) + 1).cast("long"))
    return d.where(F.col("part").rlike("^[<>]")).select(*keep, "place", F.substring("part", 1, 1).alias("mark"))


def _braced(escapes: bool) -> str:
    plain = r"\\(?s:.)|[^{}\\]" if escapes else r"[^{}]"
    inner = rf"(?:{plain})*+"
    for _ in range(NESTED):
        inner = rf"(?:{plain}|\{{{inner}\}})*+"
    return inner


def without_margins(c: Column | str) -> Column:
    r"""c without margin notes, braces balanced and escaped ones not counted; of one that isn't closed only the macro's name goes."""
    closed = F.regexp_replace(tx.col(c), fixed.MARGIN_OPENING + _braced(True) + r"\}", "")
    return F.regexp_replace(closed, fixed.MARGIN_OPENING, "")


def reference_entries(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    r"""keep, no (from 1), kind, key and entry of every entry of a reference list.

    An entry ends with its brace, and one that isn't closed where the next begins, so that a fault costs
    one entry. An entry behind a comment mark on its line is none.
    """
    from inkwell.operators.structure import tokens

    d = tokens(docs, fixed.ENTRY_OPENING, *keep, text=text)
    doc = Window.partitionBy(*keep).orderBy("k")
    # the part of its line before an entry may lie in several pieces
    d = d.withColumn("prior", F.lag("piece").over(doc)).withColumn("line", F.sum(F.coalesce(F.contains("prior", F.lit("\n")), F.lit(True)).cast("int")).over(doc))
    tail = F.regexp_replace("prior", r"(?s)^.*\n", "")
    d = d.withColumn("hidden", F.max(F.coalesce(tail.rlike(r"(?<!\\)%"), F.lit(False))).over(Window.partitionBy(*keep, "line").orderBy("k")))
    d = d.where(~F.col("hidden") & F.col("piece").rlike("^" + fixed.ENTRY_OPENING))
    whole = F.regexp_extract("piece", r"^@\w+\{" + _braced(False) + r"\}", 0)
    entry = tx.rstrip(F.when(whole != "", whole).otherwise(F.col("piece")))
    d = d.select(*keep, "k", F.lower(F.regexp_extract("piece", r"^@(\w+)", 1)).alias("kind"), tx.strip(F.regexp_extract("piece", r"^@\w+\{([^,\n]+),", 1)).alias("key"), entry.alias("entry"), (whole != "").alias("closed"))
    return d.withColumn("no", F.row_number().over(doc)).drop("k")


#: One lexical element of a command: quoted text, an escaped character, a cut between commands, a harmless redirection, a mark.
ELEMENT = re.compile(
    r"""(?P<single>'[^']*')|(?P<double>"(?:\\.|[^"\\])*")|(?P<escaped>\\.)|(?P<cut>[|;])|(?P<quiet>2?>/dev/null(?=[\s|;]|$))|(?P<open>['"].*|\\$)|(?P<mark>2?>|[$&<()~\#\n\r])|(?P<word>.)""", re.S
)


def refusal(command: str | None) -> str | None:
    """Why a command isn't to be run; null if nothing speaks against it."""
    if not command or not command.strip():
        return "empty command"
    if "`" in command:
        return "backtick"
    cuts = [0]
    for m in ELEMENT.finditer(command):
        kind, piece = m.lastgroup, m[0]
        if (kind in ("double", "mark") or (kind == "open" and piece[0] == '"')) and "$" in piece:
            return "'$' outside single quotes (shell would expand it)"
        if kind == "open":
            return "trailing backslash" if piece == "\\" or (piece[0] == '"' and re.search(r"(?<!\\)(?:\\\\)*\\$", piece)) else "unterminated quote"
        if kind == "mark":
            return "redirect other than [2]>/dev/null" if piece.endswith(">") else f"forbidden shell character {piece!r}"
        if kind == "cut":
            cuts += [m.start(), m.end()]
    cuts.append(len(command))
    segments = [s for s in (command[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if s.strip()]
    return next((r for r in map(_head_refusal, segments) if r), None) if segments else "no command found"


def _head_refusal(segment: str) -> str | None:
    """Why the program that a segment starts may not be run."""
    try:
        words = shlex.split(segment)
    except ValueError as error:
        return f"unparseable segment: {error}"
    for word in words:
        name = re.match(r"[A-Za-z_][A-Za-z0-9_]*(?==)", word)
        if not name:
            return None if word in fixed.PROGRAMS else f"executable {word!r} not in the check-command allowlist"
        if name[0] not in fixed.ASSIGNABLE:
            return f"env assignment {name[0]!r} not allowed (could subvert the allowlist)"
    return "segment has no executable"


def command_refusal(c: Column | str) -> Column:
    """refusal() of a column, on Arrow batches: quoting needs state over characters."""

    def batches(commands: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in commands:
            yield batch.map(lambda x: refusal(None if pd.isna(x) else x)).astype(object)

    return F.pandas_udf(batches, "string", PandasUDFType.SCALAR_ITER)(c)
