"""Checks of whole documents that gates are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as tx

# Fixed values.
QUESTIONS = (r"(?m)^\s*\\item\s+\\textbf\{", r"(?i)\\subsection\*?\{Q\d+", r"(?i)\\textbf\{Q\d+[\s:.]", r"(?i)\\textbf\{Question\s+\d+", r"\\begin\{interviewcontext\}")
LEVELS = (r"\bIC[3-6]\b", r"\bL[4-7]/", r"\bStaff\+?", r"(?i)\bSenior\b", r"(?i)\bMid-?level\b", r"(?i)\bJunior\b")
LEVEL_HEADERS = r"(?i)\\(?:section|subsection)\*?\{[^}]*Role\s*/\s*Level\s*Mapping|(?im)^###?\s+Role\s*/\s*Level\s*Mapping"
AGE_MONTHS = {"fast": 6, "medium": 12, "slow": 18}


def question_count(c: Column | str) -> Column:
    """Question marks of all conventions; one question may count twice."""
    return sum((tx.count(c, p) for p in QUESTIONS[1:]), tx.count(c, QUESTIONS[0]))


def level_tokens(c: Column | str) -> Column:
    return sum((tx.col(c).rlike(p).cast("int") for p in LEVELS[1:]), tx.col(c).rlike(LEVELS[0]).cast("int"))


def role_delta(c: Column | str) -> Column:
    """Two different level names, or a section that maps them."""
    return (level_tokens(c) >= 2) | tx.col(c).rlike(LEVEL_HEADERS)


def interview_gate(docs: DataFrame, least: Column, *keep: str) -> DataFrame:
    """passed and reasons of interview documents (text): questions, role levels, references."""
    n = question_count("text")
    reasons = F.array_compact(F.array(
        F.when(n < least, F.concat(F.lit("question_count<"), least.cast("string"), F.lit(" ("), n.cast("string"), F.lit(")"))),
        F.when(~role_delta("text"), F.lit("no_role_delta")),
        F.when(~F.col("text").rlike(r"\\c?ref\{ch:|\b[A-Z]{2,}-\d+\.\d+\b"), F.lit("no_los_refs")),
    ))
    return docs.withColumn("reasons_", reasons).select(*keep, (F.size("reasons_") == 0).alias("passed"), F.array_join("reasons_", ";").alias("reason"))


def todo_density(c: Column | str) -> tuple[Column, Column]:
    """Open marks and fields that could hold one: list labels and table cells."""
    todo = tx.count(c, r"\bTODO\b")
    labels = tx.count(c, r"(?m)^\s*[-*]\s+\*\*[^*]+\*\*")
    rows = F.filter(tx.lines(c), lambda x: F.startswith(F.ltrim(x), F.lit("|")) & ~x.rlike(r"^\s*\|[\s\-:|]+\|\s*$"))
    cells = F.aggregate(rows, F.lit(0), lambda a, x: a + F.greatest(F.regexp_count(x, F.lit(r"\|")) - 1, F.lit(0)))
    return todo, labels + cells


def section_words(c: Column | str, names: list[str]) -> Column:
    """Least words of the sections that are there; null if none is."""
    sections = F.split(tx.col(c), r"(?m)^##\s+")
    own = F.filter(F.slice(sections, F.lit(2), F.greatest(F.size(sections) - 1, F.lit(0))), lambda s: tx.any_of(*(F.startswith(F.lower(s), F.lit(n.lower())) for n in names)))
    return F.array_min(F.transform(own, lambda s: tx.substantive_words(F.regexp_replace(F.regexp_replace(s, r"^[^\n]*", ""), r"(?m)^\s*[-*+]\s*", ""))))


def status_marks(c: Column | str) -> list[Column]:
    """Red, yellow and green marks."""
    return [tx.count(c, rf"\[\s*{m}\s*\]") for m in "RYG"]


def include_body(c: Column | str) -> Column:
    """empty without any line but comments and structure, stub if all that is left is an open mark, else null."""
    lines = F.filter(F.transform(tx.lines(tx.strip_comments(c)), tx.strip), lambda x: (x != "") & ~x.rlike(r"^\\(?:chapter|section|subsection|label|begin|end|addcontentsline|markboth)\b[^A-Za-z]*\{?[^{}]*\}?(?:\{[^{}]*\})*$"))
    text = F.array_join(lines, "\n")
    return F.when(F.size(lines) == 0, "empty").when(text.rlike(r"(?i)^(?:TODO|TBD|stub|placeholder)\b[^\n]{0,80}$"), "stub")


def months(date: Column) -> Column:
    """Months since year 0 of a text that begins with year and month; null for an impossible month."""
    year, month = F.regexp_extract(date, r"(\d{4})-(\d{1,2})", 1), F.regexp_extract(date, r"(\d{4})-(\d{1,2})", 2)
    m = F.nullif(month, F.lit("")).cast("int")
    return F.when((m >= 1) & (m <= 12), F.nullif(year, F.lit("")).cast("int") * 12 + m)


def currency(docs: DataFrame, now: str, *keep: str) -> DataFrame:
    """Whether currency notes (text, velocity) are dated, not in the future, young enough, and have three cited items.

    An item is a subsection before the heading of what still holds, or a list item where there are none.
    """
    date = F.coalesce(F.nullif(F.regexp_extract("text", r"Current as of (\d{4}-\d{1,2})", 1), F.lit("")), tx.month_iso(F.regexp_extract("text", r"Current as of ([A-Z][a-z]+ \d{4})", 1)))
    live = F.split("text", r"(?i)\\(?:sub)?section\*?\{[^}]*still holds", 2)[0]
    subsections = F.split(live, r"\\subsection\*?\{")
    items = F.split(live, r"\\item\b")
    spans = F.when(F.size(subsections) > 1, F.slice(subsections, F.lit(2), F.size(subsections) - 1)).otherwise(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))))
    d = docs.withColumn("age_", months(F.lit(now)) - months(date)).withColumn("items_", spans)
    uncited = F.size(F.filter("items_", lambda s: ~s.rlike(r"\\(?:text)?cite|\\url\{|\\href\{|\[\d+\]")))
    most = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in AGE_MONTHS.items() for x in p)), F.col("velocity")), F.lit(AGE_MONTHS["medium"]))
    reason = (
        F.when(F.col("age_").isNull(), "undated").when(F.col("age_") < 0, "future").when(F.col("age_") > most, "old")
        .when(F.size("items_") < 3, "few items").when(uncited > 0, F.concat(uncited.cast("string"), F.lit("/"), F.size("items_").cast("string"), F.lit(" items uncited")))
    )
    return d.select(*keep, reason.isNull().alias("passed"), F.coalesce(reason, F.lit("")).alias("reason"))


def run_on_paragraphs(c: Column | str) -> Column:
    """Paragraphs, outside environments and mathematics, with three or more numbered items in one line of text."""
    bare = F.regexp_replace(F.regexp_replace(tx.col(c), r"(?s)\\begin\{(\w+\*?)\}.*?\\end\{\1\}", ""), r"\$[^$]*\$", "")
    return F.size(F.filter(tx.paragraphs(bare), lambda p: F.regexp_count(p, F.lit(r"(?:^|\s)\(?[1-9][.)]\s")) >= 3))


def outcome_id(c: Column, prefixes: list[str]) -> Column:
    """Whether an outcome's id has the form PREFIX-module.number with a known prefix."""
    return c.rlike(r"^[A-Z]{2,5}-\d+\.\d+$") & F.regexp_extract(c, r"^([A-Z]+)-", 1).isin(*prefixes)


def render_faults(cards: DataFrame, *keep: str) -> DataFrame:
    """Faults that keep a card's back from being shown: unbalanced delimiters, environments, stray angle brackets, entities."""
    b = F.col("back")
    begins, ends = (F.array_sort(F.regexp_extract_all("back", F.lit(rf"\\{w}\{{([a-z*]+)\}}"), F.lit(1))) for w in ("begin", "end"))
    faults = F.array_compact(F.array(
        F.when(tx.count(b, r"\\\(") != tx.count(b, r"\\\)"), F.lit("inline delimiters")),
        F.when(tx.count(b, r"\\\[") != tx.count(b, r"\\\]"), F.lit("display delimiters")),
        F.when(begins != ends, F.lit("environments")),
        F.when(F.regexp_replace(b, r"<[^<>]*>", "").rlike("[<>]"), F.lit("angle bracket")),
        F.when(b.rlike(r"&(?:amp;)?(?:lt|gt|amp|quot|nbsp);"), F.lit("entity")),
    ))
    return cards.select(*keep, F.explode(faults).alias("fault"))


def manifest_reasons(manifests: DataFrame, required: list[str], most_todo: int, *keep: str) -> DataFrame:
    """Reasons against manifests (fields map, text): missing fields alone if any, else open marks and missing sections."""
    missing = F.array_except(F.array(*(F.lit(r) for r in required)), F.map_keys("fields"))
    todo, fields = todo_density("text")
    rest = F.array_compact(F.array(F.when(todo * 100 > fields * most_todo, F.lit("todo")), F.when(~F.col("text").rlike(r"(?m)^## Sources"), F.lit("no sources"))))
    return manifests.select(*keep, F.when(F.size(missing) > 0, F.transform(missing, lambda m: F.concat(F.lit("missing "), m))).otherwise(rest).alias("reasons"))
