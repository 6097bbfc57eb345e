"""Rule packs: rules are data, a row's findings are the rules whose condition holds, in the rules' order.

Every rule is evaluated on every row and none hides another. A null condition doesn't hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions import text as tx


@dataclass(frozen=True)
class Rule:
    """A named condition on the columns that the pack prepares."""

    name: str
    severity: str
    condition: Column


def findings(rows: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """Columns keep, rule, severity and the rule's place for every rule that holds for a row."""
    made = [F.when(r.condition, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(k).alias("rule_ord"))) for k, r in enumerate(rules)]
    # outer: else a filter on the number of findings is inferred, for which every rule runs once more
    found = rows.select(*keep, F.explode_outer(F.array_compact(F.array(*made))).alias("f"))
    return found.where(F.col("f").isNotNull()).select(*keep, "f.rule", "f.severity", "f.rule_ord")


def header(name: str) -> str:
    """Pattern of a section header: bold in either markup, or plain at a line's start with a colon."""
    name = name.replace(" ", r"\s+")
    return rf"(?:\*\*\s*{name}\s*[:.]?\s*\*\*|<b>\s*{name}\s*[:.]?\s*</b>|<strong>\s*{name}\s*[:.]?\s*</strong>|(?:^|\n)\s*{name}\s*:)"


def has(c: str, *names: str) -> Column:
    return F.col(c).rlike("(?i)" + "|".join(header(n) for n in names))


ANY_HEADER = r"(?:\*\*\s*[A-Z][^*\n]{1,40}\s*[:.]\s*\*\*|<b>\s*[A-Z][^<\n]{1,40}\s*[:.]\s*</b>|<strong>\s*[A-Z][^<\n]{1,40}\s*[:.]\s*</strong>|(?:^|\n)\s*[A-Z][A-Za-z][A-Za-z\s/()'-]{1,40}\s*:\s+\S)"
NEXT_HEADER = r"\*\*\s*[A-Z][^*\n]{1,40}\s*[:.]?\s*\*\*|<b>\s*[A-Z][^<\n]{1,40}\s*[:.]?\s*</b>|\\end\{solution\}"
TODO = r"(?i)\b(?:TODO|TBD|FIXME|PLACEHOLDER|XXX)\b"
EVASIVE = r"(?i)(?:see\s+(?:Chapter|Module|§)|refer\s+to)\b"


def by_type(values: dict[str, int], default: int | None) -> Column:
    """The value of the card's type."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col("type")), F.lit(default))


def back_columns(cards: DataFrame) -> DataFrame:
    """What several rules look at, worked out once per row. front, back and type may be null."""
    d = cards.withColumn("back", F.coalesce("back", F.lit(""))).withColumn("front", F.coalesce("front", F.lit(""))).withColumn("type", F.coalesce("type", F.lit("")))
    d = d.withColumns({"bare": tx.strip("back"), "prose": tx.strip(tx.without_code("back")), "ending": tx.rstrip("back")})
    answer = F.split(F.col("back"), "(?i)" + header("Answer"), 2)
    answer = F.when(F.size(answer) > 1, tx.strip(F.split(answer[1], NEXT_HEADER, 2)[0]))
    evasive = F.split(F.col("back"), EVASIVE, 2)
    return d.withColumns({
        "core": tx.alnum("prose"),
        "least": by_type(fixed.LEAST_BACK, fixed.DEFAULT_LEAST),
        "answer": answer,
        "before": F.when(F.size(evasive) > 1, tx.strip(tx.without_code(evasive[0]))),
        "after": F.when(F.size(evasive) > 1, F.regexp_replace(tx.strip(evasive[1]), r"^[\s\d.,;:§\-–—]+", "")),
        "norm_front": tx.collapse("front"),
        "norm_back": tx.collapse("back"),
    })


def back_rules() -> list[Rule]:
    """Rules on a card's back, over back_columns()."""
    back, bare, prose, type_ = (F.col(c) for c in ("back", "bare", "prose", "type"))
    full = F.length(bare) > 0
    cloze = type_.isin(*fixed.CLOZE_TYPES)
    length = F.length(bare)
    substantial = (F.length("norm_front") >= 20) & (F.length("norm_back") >= 20)
    headers = F.size(F.array_distinct(F.transform(F.regexp_extract_all(back, F.lit(ANY_HEADER), F.lit(0)), lambda h: F.lower(tx.strip(h)))))
    structured = has("back", "Core Insight") & has("back", "Why It Matters", "Decision Rule", "When It Breaks")
    maths = back.rlike(r"(?s)\\\(.*?\\\)|\\\[.*?\\\]|\$\$.*?\$\$") | back.rlike(r"\$[^$\n]+\$")
    options = back.rlike(r"(?:^|\n)\s*[A-D]\.\s+\S") & back.rlike(r"(?i)\*\*[A-D]\.\s+[^*]+\*\*|<b>\s*[A-D]\.\s+[^<]+</b>")
    short_answer = F.lower(F.regexp_replace(F.col("answer"), r"^[ .,;:]+|[ .,;:]+$", ""))
    stub = (F.length("answer") <= 80) & tx.any_of(*(F.contains(short_answer, F.lit(s)) for s in fixed.ANSWER_STUBS))
    empty_core = F.length("core") == 0
    conditions = {
        "C4": ~type_.isin(*fixed.OVERLAP_TYPES) & substantial & (F.when(substantial & ~type_.isin(*fixed.OVERLAP_TYPES), tx.bigram_similarity("norm_front", "norm_back")) >= 0.85),
        "C1": ~cloze & ~full,
        "C2": ~cloze & full & (F.length(tx.alnum(back)) == 0),
        "C3": full & F.when(empty_core, back.rlike(TODO)).otherwise(prose.rlike(TODO) & (F.length("core") < 40)),
        "C5": back.rlike(r"\.\.\.\s*$") & (F.length("ending") < F.col("least")),
        "H1": ~cloze & full & (length < F.col("least")),
        "H2": (type_ == "keyconcept") & (F.length(back) > 0) & ~structured & (headers < 2),
        "H3": (type_ == "formula") & (F.length(back) > 0) & ~(maths & has("back", "Variables?", "When to Use", "Intuition")),
        "H4": (type_ == "drill") & (F.length(back) > 0) & ~options & ~has("back", "Answer"),
        "H5": type_.isin("comparison", "comparison3") & (F.length(back) > 0) & ~back.rlike(r"(?m)^\s*\|[\s\-:|]+\|\s*$"),
        "H6": type_.isin("problem", "vignette", "drill") & stub,
        "M1": full & (F.length(prose) == 0) & back.rlike(r"(?s)```[a-zA-Z]*\n.*?\n```"),
        "M2": F.endswith("ending", F.lit("?")),
        "M3": (F.length("before") < 80) & (tx.count("before", r"[A-Za-z0-9_]+") < 12) & (F.length("after") <= 20),
        "M4": back.rlike(r"(?i)\\textcolor\{|<font\b|<span\s+style|<i>|<b>"),
        "M5": bare.rlike(r"^\s*Self-check from:[^\n]*\n\s*\(Answer from memory, then verify against the chapter text\.\)\s*$|^\s*\(Answer from memory, then read the section to check\.\)\s*$"),
        "I1": length > by_type(fixed.SPLIT_BACK, None),
    }
    return [Rule(k, fixed.BACK_SEVERITY[k], v) for k, v in conditions.items()]


def back_findings(cards: DataFrame, *keep: str) -> DataFrame:
    """Findings on the backs of cards (type, front, back)."""
    return findings(back_columns(cards), back_rules(), *keep)


def _run_on_bullets(c: str) -> Column:
    """A line with ' - Capital' after other text, unless the first dash follows a digit or closing bracket: that is a minus."""

    def real(line: Column) -> Column:
        body = F.regexp_replace(line, r"^[\s\-]+", "")
        at = F.instr(F.substring(body, 2, 1_000_000_000), " - ")
        before = F.substr(body, at, F.lit(1))
        return body.rlike(r"^.[^\n]* - [A-Z]") & ~before.rlike(r"[\])|0-9}]")

    return F.exists(tx.lines(c), real)


def _inline_sections(c: str) -> Column:
    """Two section labels on one line, unless one is part of a sentence: preceded by lower case or a blank."""
    label = "(?:" + "|".join([*fixed.SECTION_LABELS, r"Step \d+", r"Phase \d+"]) + "):"
    prose = "|".join(rf"[^*\n|\s]\s*(?<=[\p{{Ll}} ])(?i:{k}):(?!(?s:.)*(?i:{k}):)" for k in fixed.SECTION_LABELS)
    return F.exists(F.regexp_extract_all(F.col(c), F.lit(rf"(?i){label}[^\n]*{label}"), F.lit(0)), lambda m: ~m.rlike(prose))


def presentation_rules(side: str) -> list[Rule]:
    """Rules on how a side of a card is laid out."""
    c = F.col(side)
    return [
        # anchored at a line's first character, so that a line without a match is read once
        Rule("run_on_numbered", "P1", c.rlike(r"(?md)^[^\S\n]*+\S[^\n]*?[ \t][1-9]\.\s+[A-Z]")),
        Rule("run_on_lettered", "P1", c.rlike(r"(?md)^[^\S\n]*+\S[^\n]*?[ \t]\([a-z]\)[ \t]+")),
        Rule("run_on_bullets", "P1", _run_on_bullets(side)),
        Rule("inline_sections", "P1", _inline_sections(side)),
        Rule("wall_of_text", "P2", F.exists(tx.paragraphs(side), lambda p: F.length(tx.strip(p)) > 500)),
        Rule("very_long_line", "P2", F.exists(tx.lines(side), lambda p: F.length(tx.strip(p)) > 200)),
        Rule("comma_list", "P2", c.rlike(r"(?:[^,\n]{1,30},){5}")),
        Rule("semicolon_list", "P3", c.rlike(r"[^;];[^;]+;")),
    ]


def presentation_excluded(*sides: str) -> Column:
    listed = [F.col(s).rlike(p) for s in sides for p in fixed.PRESENTATION_EXCLUDED[:-1]]
    # a match of the last pattern exists just if what is behind the first verb has the second word
    statements = [F.regexp_extract(s, fixed.STATEMENT[0], 1).rlike(fixed.STATEMENT[1]) for s in sides]
    return tx.any_of(*(F.coalesce(c, F.lit(False)) for c in listed + statements))


def presentation_findings(cards: DataFrame, *keep: str) -> DataFrame:
    """Findings with their side; cards with code, mathematics or tables on either side are left out."""
    rows = cards.where(~presentation_excluded("front", "back"))
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("content")) for s in ("front", "back"))))
    return findings(rows.select(*keep, sides.alias("s")).select(*keep, "s.side", "s.content"), presentation_rules("content"), *keep, "side")


def solution_classes(cards: DataFrame, *keep: str) -> DataFrame:
    """Problems and vignettes with errors, warnings, notes and their class: deficient, partial or complete."""

    def section(*names: str) -> str:
        name = "|".join(names)
        return rf"(?im)(?:\*\*(?:{name})\s*:?\s*\*\*|^\s*[-\u2022]\s*(?:{name})\s*:|(?:{name})\s*:)"

    rows = cards.where(F.col("type").isin("problem", "vignette")).withColumn("back", F.coalesce("back", F.lit("")))
    n = F.length(tx.strip("back"))
    problem, long = F.col("type") == "problem", n > fixed.SOLUTION_LONG
    lacks = {
        "insight": problem & ~F.col("back").rlike(section(r"Key\s+Insight[s]?")),
        "answer": problem & ~F.col("back").rlike(section("Answer")),
        "rubric": ~problem & ~F.col("back").rlike(r"(?i)\*\*(?:Answer\s*Rubric|Answer|Rubric|Solution|Response)\s*:?\s*\*\*|(?:^|\n)\s*(?:Answer\s*Rubric|Answer|Rubric)\s*:"),
    }
    errors = (n < fixed.SOLUTION_LEAST).cast("int")
    warnings = sum(((v & long).cast("int") for v in lacks.values()), (problem & (n >= fixed.SOLUTION_LEAST) & (n < fixed.SOLUTION_SHORT)).cast("int"))
    notes = sum(((v & ~long).cast("int") for v in lacks.values()), (problem & ~F.col("back").rlike(section("Approach"))).cast("int") + (n > fixed.SOLUTION_MOST).cast("int"))
    out = rows.select(*keep, errors.alias("errors"), warnings.alias("warnings"), notes.alias("notes"))
    kind = F.when((F.col("errors") > 0) | (F.col("warnings") >= 3), "deficient").when((F.col("warnings") > 0) | (F.col("notes") > 0), "partial").otherwise("complete")
    return out.withColumn("class", kind)


def atomicity(cards: DataFrame, *keep: str) -> DataFrame:
    """Reasons against a card's being one fact, and its class: atomic, borderline or compound."""
    rows = cards.withColumn("back", F.coalesce("back", F.lit("")))
    t = F.col("type")
    parts = (
        F.when(t == "problem", tx.count("back", r"\*\*Step\s+\d+"))
        .when(t == "vignette", tx.count("back", r"(?:\*\*Q\d+|\*\*Question\s+\d+|\bQuestion\s+\d+:)"))
        .when(t == "keyconcept", tx.count("back", r"\*\*[A-Z][^*]+:\*\*"))
    )
    looked = t.isin(*fixed.ATOMIC_TYPES)
    many = looked & F.coalesce(parts > by_type(fixed.ATOMIC_PARTS, None), F.lit(False))
    long = looked & (F.length("back") > by_type(fixed.ATOMIC_BACK, fixed.ATOMIC_BACK_DEFAULT))
    out = rows.select(*keep, many.alias("many_parts"), long.alias("too_long"))
    n = F.col("many_parts").cast("int") + F.col("too_long").cast("int")
    return out.withColumn("class", F.when(n == 0, "atomic").when(n == 1, "borderline").otherwise("compound"))


def stale_mentions(lines: DataFrame, *keep: str) -> DataFrame:
    """Findings on lines (line); comments, warning notes and accepted mentions are left alone."""
    line = F.col("line")
    live = ~F.startswith(F.ltrim(line), F.lit("%")) & ~F.contains(line, F.lit(r"\warningmargin{")) & ~F.contains(line, F.lit("% freshness-ok"))
    rules = [Rule(f"S{k + 1:02d}", severity, live & line.rlike(f"(?i){p}")) for k, (p, _, severity) in enumerate(fixed.STALE)]
    return findings(lines, rules, *keep)


def margin_findings(notes: DataFrame, *keep: str) -> DataFrame:
    """Findings on margin notes (category, note)."""
    note = F.col("note")
    n_words = F.size(F.filter(F.split(note, r"\s+"), lambda w: w != ""))
    after = F.split(note, r"\?", 2)[1]
    rules = [Rule(f"generic_{k + 1}", "generic", F.lower(note).rlike(p)) for k, p in enumerate(fixed.MARGIN_GENERIC)]
    rules += [
        Rule("over_length", "length", n_words > fixed.MARGIN_WORDS),
        Rule("non_standard", "category", ~F.col("category").isin(*fixed.MARGIN_MACROS.values())),
        Rule("answer_in_margin", "split", F.contains(note, F.lit("?")) & (n_words > fixed.MARGIN_WORDS) & (F.size(F.filter(F.split(after, r"\s+"), lambda w: w != "")) > 12)),
        Rule("bare_formula", "split", (F.col("category") == "Formula") & F.startswith(tx.strip(note), F.lit("$")) & (n_words < 15)),
        Rule("template", "template", ~note.rlike(fixed.MARGIN_VERBS) & tx.any_of(*(note.rlike(p) for p in fixed.MARGIN_TEMPLATES))),
    ]
    return findings(notes, rules, *keep)


def leading_repeats(items: DataFrame, *keep: str) -> DataFrame:
    """Items whose first two words are the same but for case: a level's name left before its own verb."""
    one, two = (F.regexp_extract("text", r"^\s*([A-Za-z]+)\s+([A-Za-z]+)(?:[^A-Za-z-]|$)", k) for k in (1, 2))
    return items.where((one != "") & (F.lower(one) == F.lower(two))).select(*keep)


def severity_counts(found: DataFrame, *by: str) -> DataFrame:
    """Findings per group, severity and rule, with totals of each level: null stands for all."""
    return found.rollup(*by).agg(F.count("*").alias("n"))
