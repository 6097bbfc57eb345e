r"""Cards of exercises: interview questions, drills, tables of levels and comparisons, predictions, orderings and matchings.

Every card comes from a block: an environment from its first opening to the next closing, whatever stands
in between; an opening without closing makes none. Texts are cut behind each closing and looked through once, so
openings that are never closed cost no rescans. Backs are the markup itself. The columns in
keep have to name a document and mustn't be called block, off, k, piece, body or cut_. Null and empty texts, and texts without blocks, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import cutting, fixed
from inkwell.functions import text as tx
from inkwell.operators.identity import once
from inkwell.operators.structure import MARK, nested

BRACED, BRACKET = r"\{([^}]+)\}", r"(?:\[([^\]]*)\])?"


def blocks(docs: DataFrame, name: str, *keep: str) -> DataFrame:
    """keep, block (from 1, in order), off and body (what stands between opening and closing, options included)."""
    begin, end = f"\\begin{{{name}}}", f"\\end{{{name}}}"
    # what stands in front of each closing; behind the last one nothing is closed
    closed = tx.let(F.split(F.replace(F.col("text"), F.lit(MARK), F.lit(" ")), rf"\\end\{{{name}\}}"), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))
    # outer: else a filter on the array's size is inferred, which makes the texts again
    d = docs.select(*keep, F.posexplode_outer(closed).alias("k", "piece")).where("k is not null")
    doc = Window.partitionBy(*keep).orderBy("k")
    at = F.instr("piece", begin)
    before = F.coalesce(F.sum(F.length("piece") + len(end)).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.select(*keep, "k", (before + at - 1).cast("long").alias("off"), F.when(at > 0, F.substr(F.col("piece"), at + len(begin))).alias("body"))
    block = F.count("body").over(doc.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return d.select(*keep, block.alias("block"), "off", "body").where("body is not null")


def _parts(d: DataFrame, lead: str, *names: str) -> DataFrame:
    """The groups of lead, at a body's beginning, as columns names, and the stripped rest as body; bodies that don't begin so go."""
    n = len(names) + 1
    cut = F.split(F.regexp_replace("body", rf"(?s)^{lead}(.*)$", MARK.join(f"${i + 1}" for i in range(n))), MARK)
    d = once(d, "cut_", cut).where(F.size("cut_") == n)
    groups = [F.col("cut_")[i].alias(c) for i, c in enumerate(names)]
    return once(d.select(*(c for c in d.columns if c not in ("body", "cut_")), *groups, F.col("cut_")[n - 1].alias("rest_")), "body", tx.strip("rest_")).drop("rest_")


def _given(c: Column | str) -> Column:
    return F.nullif(tx.strip(c), F.lit(""))


def _macro(name: str, levels: int) -> Column:
    """The stripped argument of the first closed macro of this name in the body; null without one."""
    pattern = rf"\\{name}\{{({nested(levels)})\}}"
    return F.when(F.col("body").rlike(pattern), tx.strip(F.regexp_extract("body", pattern, 1)))


def _shortened(c: Column, most: int) -> Column:
    """At most most characters and dots, cut at a blank if there is one."""
    head = F.substr(c, F.lit(1), F.lit(most))
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit("..."))).otherwise(c)


def _first_of(patterns: tuple[str, ...], c: Column) -> Column:
    return F.coalesce(*(F.when(c.rlike(p), tx.strip(F.regexp_extract(c, p, 1))) for p in patterns))


def interview_questions(docs: DataFrame, *keep: str) -> DataFrame:
    r"""keep, block, off, title, los_id, los_ids, companies, front and back of interviewcontext blocks.

    The front asks what the body says an interviewer asks, by the first kind of wording that occurs; without one it
    follows from the title. Without a title the body's topic or first sentence is one. Roles belong to their
    own block only and aren't part of the back.
    """
    d = _parts(blocks(docs, "interviewcontext", *keep), BRACKET + BRACKET, "t_", "los_")
    split = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: tx.strip(x)), lambda x: x != "")
    roles = F.flatten(F.transform(F.regexp_extract_all("body", F.lit(r"\\companytags\{([^}]*)\}"), F.lit(1)), split))
    d = d.withColumn("companies", roles).withColumn("los_ids", split("los_")).withColumn("body", tx.strip(F.regexp_replace("body", r"\\companytags\{[^}]*\}", "")))
    body = F.col("body")
    sentence = F.substring(F.substring_index(body, ".", 1), 1, 80)
    topic = F.when(F.length(sentence) > 20, F.concat(F.regexp_replace(sentence, r"(?s) [^ ]*$", ""), F.lit("..."))).otherwise(F.concat(F.lit("Strategy "), F.col("block").cast("string")))
    own = F.when(F.col("t_") != "", tx.strip(F.regexp_replace("t_", "``|''|\"", "")))
    d = d.withColumn("title", F.coalesce(own, F.substring(_first_of(fixed.INTERVIEW_TOPICS, body), 1, 60), topic)).withColumn("asked", _first_of(fixed.INTERVIEW_QUESTIONS, body))
    title, low = F.col("title"), F.lower("title")
    has = lambda *words: F.lit(True) if not words else F.contains(low, F.lit(words[0])) & has(*words[1:])
    line = tx.strip(F.substring_index(body, "\n", 1))
    by_title = (
        F.when(has("why", "matter"), F.lit("Why does this matter? What business context should you lead with?"))
        .when(has("example"), F.concat(F.lit("Tell a STAR story about "), tx.strip(F.regexp_replace(title, "[Ee]xample", "")), F.lit(". What was the situation and outcome?")))
        .when(has("practice", "question"), F.when(F.length(line) > 10, F.substring(line, 1, 150)).otherwise(F.lit("Practice answering this question out loud.")))
        .when(has("template") | has("structure"), F.concat(F.lit("What is the "), title, F.lit("? Walk through each step.")))
        .when(has("recovery") | has("phrase"), F.lit("What are key recovery phrases when stuck? When do you use each?"))
        .when(has("best practice"), F.concat(F.lit("What are the "), title, F.lit("?")))
        .otherwise(title)
    )
    front = F.coalesce(F.concat(F.lit("Interview Q: "), _shortened(F.col("asked"), 100)), F.concat(F.lit("Interview: "), by_title))
    return d.select(*keep, "block", "off", "title", F.get("los_ids", F.lit(0)).alias("los_id"), "los_ids", "companies", front.alias("front"), cutting.cut(body, 3000).alias("back"))


def drills(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, block, off, los_id, front and back of drill blocks; one without a prompt makes no card. Without answer and technique the back is empty."""
    d = _parts(blocks(docs, "drill", *keep), BRACKET, "los_").withColumn("front", _macro("drillprompt", 1)).where("front is not null")
    part = lambda head, name: F.concat(F.lit(head), F.nullif(_macro(name, 2), F.lit("")))
    back = F.concat_ws("\n\n", part("**Answer:**\n", "drillanswer"), part("---\n\n**Technique:**\n", "technique"))
    return d.select(*keep, "block", "off", _given("los_").alias("los_id"), "front", cutting.cut(back, 800).alias("back"))


def _table(macro: str, heads: list[Column], order: list[int]) -> Column:
    """The rows of a body as a table with these heads, its value columns (from 1) in this order; null without rows."""
    rule = "|-----------|" + ("-----|" if macro == "levelrow" else "--------|") * len(heads)
    row = rf"\\{macro}" + r"\{([^}]*)\}" * (len(heads) + 1)
    cells = lambda m: [tx.strip(F.regexp_extract(m, row, i + 1)) for i in (0, *order)]
    line = lambda cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    rows = F.regexp_extract_all("body", F.lit(row), F.lit(0))
    return F.when(F.size(rows) > 0, F.concat_ws("\n", line([F.lit("Dimension"), *heads]), F.lit(rule), F.array_join(F.transform(rows, lambda m: line(cells(m))), "\n")))


def level_cards(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, block, off, title, los_id, front and back of levelcard blocks: what two levels are expected to do, as a table; without rows the body."""
    d = _parts(blocks(docs, "levelcard", *keep), BRACED + BRACKET, "t_", "los_").withColumn("title", tx.strip("t_"))
    back = F.coalesce(_table("levelrow", [F.lit("IC4"), F.lit("IC5")], [1, 2]), F.col("body"))
    return d.select(*keep, "block", "off", "title", _given("los_").alias("los_id"), F.concat(F.lit("IC4 vs IC5: "), "title").alias("front"), back.alias("back"))


def comparisons(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, type, block, off, reverse, title, los_id, front and back of comparisoncard (two columns) and comparisoncard3 blocks.

    A table of two columns makes a second card with its columns the other way round; a body without rows makes one card of itself.
    """
    two = _parts(blocks(docs, "comparisoncard", *keep), BRACED * 3 + BRACKET, "t_", "x_", "y_", "los_")
    three = _parts(blocks(docs, "comparisoncard3", *keep), BRACED * 4 + BRACKET, "t_", "x_", "y_", "z_", "los_")
    name = lambda c: tx.strip(c)
    title, x, y, z = name("t_"), name("x_"), name("y_"), name("z_")
    common = [*keep, "block", "off", title.alias("title"), _given("los_").alias("los_id")]
    card = lambda reverse, front, back: F.struct(F.lit(reverse).alias("reverse"), front.alias("front"), back.alias("back"))
    fore = card(False, F.concat(F.lit("Compare: "), title), F.coalesce(_table("comprow", [x, y], [1, 2]), F.col("body")))
    back = _table("comprow", [y, x], [2, 1])
    aft = F.when(back.isNotNull(), card(True, F.concat(F.lit("Compare: "), y, F.lit(" vs "), x, F.lit(" ("), title, F.lit(")")), back))
    pair = two.select(*common, F.explode(F.array_compact(F.array(fore, aft))).alias("c"), F.lit("comparison").alias("type"))
    wide = card(False, F.concat(F.lit("Compare: "), title), F.coalesce(_table("comprowiii", [x, y, z], [1, 2, 3]), F.col("body")))
    both = pair.unionByName(three.select(*common, wide.alias("c"), F.lit("comparison3").alias("type")))
    return both.select(*keep, "type", "block", "off", "c.reverse", "title", "los_id", "c.front", "c.back")


def predictions(docs: DataFrame, *keep: str, levels: int = 8) -> DataFrame:
    """keep, block, off, title, front and back of generatefirst blocks: a prompt of at least 15 characters, answered before reading.

    The back is the argument of the first answer macro, braces nested to levels, else a placeholder; if that macro isn't
    closed it belongs to the prompt.
    """
    d = _parts(blocks(docs, "generatefirst", *keep), BRACKET, "t_")
    opening = r"\\generateanswer\s*\{"
    before, after = (F.regexp_extract("body", p, 1) for p in (rf"(?s)^(.*?){opening}", rf"(?s)^.*?{opening}(.*)$"))
    argument = rf"^({nested(levels)})\}}"
    closed = F.col("body").rlike(opening) & after.rlike(argument)
    prompt = F.when(closed, tx.strip(before)).otherwise(F.col("body"))
    back = F.when(closed, tx.strip(F.regexp_extract(after, argument, 1))).otherwise(F.lit(fixed.GENERATE_PLACEHOLDER))
    title = F.when(F.col("t_") != "", tx.strip("t_")).otherwise(F.lit("Predict Before Reading"))
    d = d.select(*keep, "block", "off", title.alias("title"), prompt.alias("prompt"), back.alias("back")).where(F.length("prompt") >= 15)
    return d.select(*keep, "block", "off", "title", F.concat(F.lit("Before reading: "), "prompt").alias("front"), "back")


def arrangements(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, type, block, off, los_id, front and back of ordering and matching blocks that hold a solution and steps or pairs before it."""
    solved = r"(?s)^(.*?)\\begin\{solution\}(.*?)\\end\{solution\}"
    found = []
    for kind, macro, n, ask in (("ordering", "orderstep", 1, fixed.ORDERING_PROMPT), ("matching", "matchpair", 2, fixed.MATCHING_PROMPT)):
        d = _parts(blocks(docs, kind, *keep), BRACKET, "los_").where(F.col("body").rlike(solved))
        d = d.withColumn("answer", tx.strip(F.regexp_extract("body", solved, 2))).withColumn("body", tx.strip(F.regexp_extract("body", solved, 1)))
        row = rf"\\{macro}" + BRACED * n
        # up to the last closing brace, else each open step is followed to the end
        shut = F.substr(F.col("body"), F.lit(1), F.length("body") - F.length(F.substring_index("body", "}", -1)))
        items, goals = (F.transform(F.regexp_extract_all(shut, F.lit(row), F.lit(g)), lambda x: tx.strip(x)) for g in (1, n))
        prompt = F.coalesce(_given(F.regexp_extract("body", rf"(?s)^(.*?)\\{macro}\{{", 1)), F.lit(ask))
        tail = "" if n == 1 else " -> ???"
        lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit(tail))), "\n")
        front = F.concat(prompt, F.lit("\n\n"), lines) if n == 1 else F.concat(prompt, F.lit("\n\n"), lines, F.lit("\n\n**Categories:** "), F.array_join(goals, " | "))
        d = d.where(F.size(items) > 0)
        found.append(d.select(*keep, F.lit(kind).alias("type"), "block", "off", _given("los_").alias("los_id"), cutting.cut(front, 800).alias("front"), cutting.cut("answer", 1000).alias("back")))
    return found[0].unionByName(found[1])
