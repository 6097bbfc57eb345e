"""Text normalisation as native column expressions.

Patterns that repeat a group over long texts are possessive: the regular expression engine recurses
per character otherwise and overflows its stack on long documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(c), rf"^{BLANK}+|{BLANK}+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"{BLANK}+$", "")


def collapse(c: Column | str) -> Column:
    """Lower case, trimmed, white space made single blanks."""
    return F.regexp_replace(F.lower(strip(c)), rf"{BLANK}+", " ")


def alnum(c: Column | str) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}]", "")


def without_code(c: Column | str) -> Column:
    """Fenced blocks and inline code removed."""
    fenced = F.regexp_replace(col(c), r"(?s)```[a-zA-Z]*\n.*?\n```", "")
    return F.regexp_replace(fenced, r"`[^`]+`", "")


def strip_comments(c: Column | str) -> Column:
    """Markup comments removed to the end of the line; the number of lines stays.

    A percent sign behind an odd number of backslashes is literal, as is one in the first argument
    of a link macro.
    """
    return F.regexp_replace(col(c), r"(?m)^((?:\\(?:url|nolinkurl|path|href)\{[^{}]*+\}|\\.|[^%\\\n])*+)%.*$", "$1")


def strip_comments_simple(c: Column | str) -> Column:
    """Variant: from the first percent sign that no backslash precedes."""
    return F.regexp_replace(col(c), r"(?m)(?<!\\)%.*$", "")


def words(c: Column | str) -> Column:
    """Lower-case words of two or more letters or digits; macro names, their options and braces don't count.

    A right-aligned echo of an outcome's id at the end is dropped first.
    """
    s = F.regexp_replace(col(c), r"\\hfill\s*\\textit\s*\{\s*\([^)]*\)\s*\}\s*\.?\s*(?:%[^\n]*)?$", "")
    s = F.regexp_replace(s, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?", " ")
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]{2,}"), F.lit(0))


def suffix(words_: Column, n: int = 10) -> Column:
    """The last n words joined by blanks; null if there are fewer."""
    return let(words_, lambda w: F.when(F.size(w) >= n, F.array_join(F.slice(w, -n, n), " ")))


def contains_run(haystack: Column, needle: Column) -> Column:
    """Whether the words of needle stand in haystack one after the other."""
    whole, part = (F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")) for w in (haystack, needle))
    return (F.size(needle) > 0) & F.contains(whole, part)


def term_name(c: Column | str) -> Column:
    """A term's name for comparison: macros, mathematics and braces gone, lower case, no leading article."""
    s = F.regexp_replace(col(c), r"\\[a-zA-Z]+\*?", " ")
    s = F.regexp_replace(s, r"\$[^$]*\$|[{}\\]", " ")
    s = F.regexp_replace(F.lower(strip(s)), r"\s+", " ")
    return F.regexp_replace(s, r"^(?:the|a|an) ", "")


def bigrams(c: Column | str) -> Column:
    """Distinct pairs of neighbouring characters; linear in the length."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit("(?s)(?=(..))."), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def jaccard_of_distinct(a: Column, b: Column) -> Column:
    """The same of arrays without repeats, which only have to be intersected."""
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(F.lit(0.0))


def bigram_similarity(a: Column | str, b: Column | str) -> Column:
    """1 for equal texts, 0 if either is empty, else the similarity of their character pairs."""
    a, b = col(a), col(b)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(let(F.struct(bigrams(a).alias("a"), bigrams(b).alias("b")), lambda p: jaccard_of_distinct(p["a"], p["b"])))


def slug(c: Column | str, size: int = 50) -> Column:
    """Upper-case identifier part: macros gone, letters, digits and blanks kept, blanks made underscores, cut."""
    s = F.regexp_replace(col(c), r"\\[a-zA-Z]+\{([^}]*)\}", "$1")
    s = F.regexp_replace(s, r"[^a-zA-Z0-9\s]", "")
    return F.substring(F.upper(F.regexp_replace(strip(s), r"\s+", "_")), 1, size)


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def substantive_words(c: Column | str) -> Column:
    """Words that begin with a letter."""
    return count(c, r"\b[A-Za-z][A-Za-z0-9-]+\b")


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def paragraphs(c: Column | str) -> Column:
    return F.split(col(c), r"\n\s*\n")


def multi_id(c: Column | str) -> Column:
    """Ids of a list parted by commas or semicolons, trimmed, empty ones gone."""
    return F.filter(F.transform(F.split(col(c), r"[,;]\s*"), strip), lambda x: x != "")


def month_iso(c: Column | str) -> Column:
    """April 2026 as 2026-04; null for anything that isn't an English month and a year."""
    # Months in order.
    names = "January February March April May June July August September October November December".split()
    name, year = F.regexp_extract(col(c), r"^\s*([A-Za-z]+) (\d{4})", 1), F.regexp_extract(col(c), r"^\s*([A-Za-z]+) (\d{4})", 2)
    at = F.array_position(F.array(*(F.lit(n) for n in names)), name)
    return F.when(at > 0, F.concat(year, F.lit("-"), F.lpad(at.cast("string"), 2, "0")))


def first_sentence(c: Column | str, least: int = 30, most: int = 280) -> Column:
    """Up to the first full stop after least characters that no digit precedes, at most most characters."""
    found = F.regexp_extract(col(c), rf"(?s)^(.{{{least},{most}}}?[^0-9][.!?])(?:\s|$)", 1)
    return F.when(found != "", found).otherwise(F.substring(col(c), 1, most))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
