"""Deterministic text rewriting: fixes that leave a text alone once they have been made."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.window import Window

from inkwell.functions import snippets
from inkwell.functions import text as tx
from inkwell.operators.structure import tokens

LINE = 200
FRAGMENT = 20


def break_run_ons(c: Column | str) -> Column:
    """Numbered, lettered and dashed items on one line put on lines of their own; code fences are left alone."""
    s = tx.col(c)
    fixed = F.regexp_replace(s, r"(?<=\S)[ \t]+([1-9]\.)\s+(?=[A-Z])", "\n$1 ")
    fixed = F.regexp_replace(fixed, r"(?<=\S)[ \t]+(\([a-z]\))[ \t]+", "\n$1 ")
    fixed = F.regexp_replace(fixed, r"(?<=[^\s\-\d\])}|]) - (?=[A-Z])", "\n- ")
    return F.when(F.contains(s, F.lit("```")), s).otherwise(fixed)


def drop_repeated_labels(c: Column | str) -> Column:
    """A line that repeats the one before it with a label in front goes."""
    return F.regexp_replace(tx.col(c), r"(?m)^([^\n]+)\n\*\*[A-Za-z ]+:\*\*[ \t]*\1$", "$1")


def best_break(line: str, most: int) -> int | None:
    """Place to break a line: after the last sentence, else clause, comma or blank within most characters; never inside mathematics."""
    for pattern in (r"[.!?](?=\s)", r"[;:](?=\s)", r",(?=\s)", r"\s"):
        places = [m.end() for m in re.finditer(pattern, line[: most + 1]) if FRAGMENT <= m.end() <= most and len(line) - m.end() >= FRAGMENT]
        places = [p for p in places if line[:p].count("$") % 2 == 0 and line[:p].count("\\(") == line[:p].count("\\)")]
        if places:
            return places[-1]
    return None


def wrapped(text: str | None, most: int = LINE) -> str | None:
    """Lines longer than most broken at their best places. Tables, code and what can't be broken stay."""
    if text is None:
        return None
    out, fenced = [], False
    for line in text.split("\n"):
        fenced ^= line.startswith("```")
        while not fenced and len(line) > most and not line.lstrip().startswith("|"):
            at = best_break(line, most)
            if at is None:
                break
            out.append(line[:at].rstrip())
            line = line[at:].lstrip()
        out.append(line)
    return "\n".join(out)


def _wrap_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(wrapped, na_action="ignore")


def wrap(c: Column | str) -> Column:
    """wrapped() on Arrow batches: breaking is iterative, so it isn't an expression."""
    return F.pandas_udf(_wrap_batches, "string", PandasUDFType.SCALAR_ITER)(c)


def truncated(text: str | None, most: int) -> str | None:
    """At most most characters: to the last sentence end in the later 60 %, else to a word in the last 20 %, else cut hard."""
    if text is None or len(text) <= most:
        return text
    head = text[:most]
    for end in (". ", "! ", "? ", ".\n"):
        at = head.rfind(end)
        if at > 0.4 * most:
            return head[: at + 1]
    at = head.rfind(" ")
    return head[:at] + "..." if at > 0.8 * most else head[: most - 3] + "..."


def typed_listings(docs: DataFrame, *keep: str) -> DataFrame:
    r"""keep, text, converted and untyped: documents whose verbatim blocks of a known language are listings of that language.

    The text is cut at the blocks' beginnings and ends, a block's own pieces get their new opening and closing, and
    the pieces are put together again, so that all edits of a document are one pass. A block reaches from the first
    opening to the next closing; one without closing stays. A second run changes nothing. Null stays null.
    """
    d = tokens(docs, r"\\begin\{verbatim\}|\\end\{verbatim\}", *keep)
    opens, ends = (F.startswith("piece", F.lit(f"\\{w}{{verbatim}}")) for w in ("begin", "end"))
    doc = Window.partitionBy(*keep).orderBy("k")
    d = d.withColumn("opens", opens).withColumn("ends", ends)
    d = d.withColumn("round", F.coalesce(F.sum(F.col("ends").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    block = Window.partitionBy(*keep, "round")
    d = d.withColumn("first", F.min(F.when(F.col("opens"), F.col("k"))).over(block)).withColumn("closed", F.bool_or("ends").over(block) & F.col("first").isNotNull())
    inside = F.col("closed") & (F.col("k") >= F.col("first")) & ~F.col("ends")
    pieces = F.sort_array(F.collect_list(F.when(inside, F.struct("k", "piece"))).over(block))
    body = F.substring(F.array_join(F.transform(pieces, lambda p: p["piece"]), ""), len("\\begin{verbatim}") + 1, 1 << 30)
    d = d.withColumn("language", F.when(F.col("closed"), snippets.code_language(body)))
    at_first, at_end = F.col("closed") & (F.col("k") == F.col("first")), F.col("closed") & F.col("ends")
    known = F.col("language").isNotNull()
    opening = F.concat(F.lit("\\begin{minted}{"), "language", F.lit("}"), F.substring("piece", len("\\begin{verbatim}") + 1, 1 << 30))
    closing = F.concat(F.lit("\\end{minted}"), F.substring("piece", len("\\end{verbatim}") + 1, 1 << 30))
    d = d.withColumn("piece", F.when(known & at_first, opening).when(known & at_end, closing).otherwise(F.col("piece")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"]), "")
    made = d.groupBy(*keep).agg(whole.alias("text"), F.count_if(known & at_first).alias("converted"), F.count_if(~known & at_first).alias("untyped"))
    rest = docs.where("text is null or text = ''").select(*keep, "text", F.lit(0).cast("long").alias("converted"), F.lit(0).cast("long").alias("untyped"))
    return made.unionByName(rest)


@dataclass(frozen=True)
class Setting:
    """A line of a settings file that is to read anew: key, four blanks in, of a section, there of an entry or with a certain word.

    {log} in value stands for the log that the line names, or main.log.
    """

    section: str
    key: str
    value: str
    entry: str | None = None
    word: str | None = None


def rewritten_settings(files: DataFrame, settings: tuple[Setting, ...], *keep: str) -> DataFrame:
    """keep, text and changed: settings files (text) whose lines of these settings have their values, in double quotes.

    The section and entry that a line belongs to are carried over the lines before it. Other lines stay
    to the letter, and a second run changes nothing. Null and empty texts stay.
    """
    d = files.where("text is not null").select(*keep, F.posexplode(F.split("text", "\n")).alias("k", "line"))
    doc = Window.partitionBy(*keep).orderBy("k")
    top = F.nullif(F.regexp_extract("line", r"^([A-Za-z][\w-]*):", 1), F.lit(""))
    d = d.withColumn("section", F.last(top, ignorenulls=True).over(doc)).withColumn("part", F.count(top).over(doc))
    entry = F.nullif(F.regexp_extract("line", r"^  ([A-Za-z_]+):\s*$", 1), F.lit(""))
    d = d.withColumn("entry", F.last(entry, ignorenulls=True).over(Window.partitionBy(*keep, "part").orderBy("k")))
    log = F.concat(F.lit("guide/"), F.coalesce(F.nullif(F.regexp_extract("line", r"main(?:_digital)?\.log", 0), F.lit("")), F.lit("main.log")))
    new = F.col("line")
    for s in reversed(settings):
        mine = (F.col("section") == s.section) & F.startswith("line", F.lit(f"    {s.key}:"))
        if s.entry is not None:
            mine = mine & (F.col("entry") == s.entry)
        if s.word is not None:
            mine = mine & F.contains("line", F.lit(s.word))
        quoted = s.value.replace("\\", "\\\\").replace('"', '\\"')
        new = F.when(mine, F.concat(F.lit(f'    {s.key}: "'), F.replace(F.lit(quoted), F.lit("{log}"), log), F.lit('"'))).otherwise(new)
    d = d.withColumn("new", new)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "new"))), lambda p: p["new"]), "\n")
    made = d.groupBy(*keep).agg(whole.alias("text"), F.bool_or(F.col("new") != F.col("line")).alias("changed"))
    return made.unionByName(files.where("text is null").select(*keep, "text", F.lit(False).alias("changed")))


def setting_values(files: DataFrame, *keep: str) -> DataFrame:
    """keep, section, entry, key and value of every quoted setting, read back: what a rewriting is verified by."""
    d = files.select(*keep, F.posexplode(F.split("text", "\n")).alias("k", "line"))
    doc = Window.partitionBy(*keep).orderBy("k")
    top = F.nullif(F.regexp_extract("line", r"^([A-Za-z][\w-]*):", 1), F.lit(""))
    d = d.withColumn("section", F.last(top, ignorenulls=True).over(doc)).withColumn("part", F.count(top).over(doc))
    entry = F.nullif(F.regexp_extract("line", r"^  ([A-Za-z_]+):\s*$", 1), F.lit(""))
    d = d.withColumn("entry", F.last(entry, ignorenulls=True).over(Window.partitionBy(*keep, "part").orderBy("k")))
    pattern = r'^    (\w+): "((?:\\.|[^"\\])*+)"\s*$'
    value = F.regexp_replace(F.regexp_extract("line", pattern, 2), r"\\(.)", "$1")
    return d.where(F.col("line").rlike(pattern)).select(*keep, "k", "section", "entry", F.regexp_extract("line", pattern, 1).alias("key"), value.alias("value"))
