"""Small fields taken from texts, names and lists, as native expressions. Null in, null or empty out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.text import col

MARK = "\x01"


def code_language(c: Column | str) -> Column:
    """Language of a listing by the first rule that holds; null for prose, drawings and empty texts."""
    text = F.trim(col(c))
    out = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(None).cast("string"))
    for language, patterns in fixed.LANGUAGE_RULES:
        holds = F.lit(True)
        for p in patterns:
            holds = holds & (text.rlike(p) if isinstance(p, str) else in_one_line(text, *p))
        out = out.when(holds, language)
    keys = F.regexp_count(text, F.lit(r"(?m)^[a-zA-Z_][\w-]*\s*:\s*\S"))
    out = out.when((keys >= 3) & ~text.rlike(r"\bdef\s+\w+\("), "yaml")
    for language, pattern in fixed.SHELL_RULES:
        out = out.when(text.rlike(pattern), language)
    return out


def in_one_line(text: Column, head: str, rest: str) -> Column:
    """Whether some line has a match of head with one of rest behind it; white space in head may span lines. Linear time."""
    joined = F.regexp_replace(text, head, MARK)
    lines = F.split(joined, "[\n\r\u0085\u2028\u2029]")
    return F.contains(joined, F.lit(MARK)) & F.exists(lines, lambda x: F.regexp_extract(x, f"{MARK}(.*)$", 1).rlike(rest))


def section_headers(c: Column | str) -> Column:
    """Distinct second-level headings, in order."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"(?m)^##\s+(.+?)\s*$"), F.lit(1)))


def front_matter(c: Column | str) -> tuple[Column, Column, Column]:
    """The block between the first two --- lines, the body after it, and why there is none: no_front_matter or not_closed."""
    text = col(c)
    opened = F.startswith(text, F.lit("---\n"))
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n(.*)$", 1)
    body = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n(.*)$", 2)
    closed = text.rlike(r"(?s)^---\n(.*?)\n---\n")
    return F.when(closed, head), F.when(closed, body), F.when(~opened, "no_front_matter").when(~closed, "not_closed")


def field_of(block: Column | str, name: str) -> Column:
    """A plain value of a block of key: value lines; null if it isn't there."""
    found = F.regexp_extract(col(block), rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit(""))


def company_tags(c: Column | str) -> Column:
    r"""The names of every \companytags{a, b}."""
    inner = F.regexp_extract_all(col(c), F.lit(r"\\companytags\{([^}]*)\}"), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(inner, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: x != "")


def image_names(c: Column | str) -> Column:
    """Distinct sources of images, in order."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"""<img[^>]*?\bsrc=["']([^"']+)["']"""), F.lit(1)))


def unexpected_tags(c: Column | str, allowed: tuple[str, ...]) -> Column:
    """Names of tags that aren't allowed, in lower case, each once."""
    names = F.transform(F.regexp_extract_all(col(c), F.lit(r"</?([A-Za-z][A-Za-z0-9]*)\b[^>]*>"), F.lit(1)), lambda x: F.lower(x))
    return F.array_except(F.array_distinct(names), F.array(*(F.lit(a) for a in allowed)))


def clean_tags(c: Column | str) -> Column:
    """Tags with white space made underscores and other than word characters, : and - left out; empty ones go, each once."""
    one = lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), r"\s+", "_"), r"[^\w:\-]", "")
    return F.array_distinct(F.filter(F.transform(col(c), one), lambda t: t != ""))


def volume_chapter(path: Column | str) -> tuple[Column, Column]:
    """volN and chNN of a path, vol0 and ch00 if it names none."""
    v = F.regexp_extract(col(path), r"(?:^|/)vol(\d+)", 1)
    n = F.regexp_extract(col(path), r"(?:^|/)(?:ch)?0*(\d+)_[^/]*$", 1)
    return F.concat(F.lit("vol"), F.when(v == "", "0").otherwise(v)), F.concat(F.lit("ch"), F.when(n == "", "00").otherwise(F.lpad(n, F.greatest(F.lit(2), F.length(n)), F.lit("0"))))


def citation(key: Column | str) -> Column:
    """Surname (Year) of a key of letters and a year; the key itself otherwise."""
    name, year = (F.regexp_extract(col(key), r"^([A-Za-z]+)[^0-9]*(\d{4})", k) for k in (1, 2))
    return F.when(name != "", F.concat(F.initcap(name), F.lit(" ("), year, F.lit(")"))).otherwise(col(key))


def outcome_fault(los_id: Column | str, level: Column | str) -> Column:
    """format, level or null: whether an outcome's id and level are as they should be."""
    return F.when(~F.coalesce(col(los_id).rlike(r"^([A-Z0-9]+(?:-[A-Z0-9]+)?)-(\d+)\.(\d+)$"), F.lit(False)), "format").when(~F.coalesce(F.lower(col(level)).isin(*fixed.OUTCOME_LEVELS), F.lit(False)), "level")


def velocity(override: Column, shelf: Column, default: str = "medium") -> Column:
    """Pace of a collection: its own if known, else its shelf's."""
    own = F.lower(F.trim(override))
    return F.when(own.isin(*fixed.MAX_AGE_MONTHS), own).when(shelf.isin(*fixed.FAST_SHELVES), "fast").when(shelf.isin(*fixed.SLOW_SHELVES), "slow").otherwise(default)
