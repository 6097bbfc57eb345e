"""Elements of marked-up documents: one text, many typed rows in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from inkwell.functions import text as tx
from inkwell.functions.markup import MACRO_FIELDS, scan_macros

#: A braced argument with at most one braced group inside; possessive, so that long arguments don't recurse.
ARG = r"\{((?:[^{}]++|\{[^{}]*+\})*+)\}"


def matches(docs: DataFrame, pattern: str, fields: dict[str, int], *keep: str, text: str = "text") -> DataFrame:
    """keep, ord (from 0) and a column per group of every match of pattern."""
    whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    found = docs.select(*keep, F.posexplode(whole).alias("ord", "m"))
    return found.select(*keep, "ord", *(F.regexp_extract("m", pattern, g).alias(c) for c, g in fields.items()))


def outcomes(docs: DataFrame, *keep: str, raw: bool = False) -> DataFrame:
    """Learning outcomes: los_id, level and statement, white space collapsed; comments don't count unless raw."""
    source = docs if raw else docs.withColumn("text", tx.strip_comments("text"))
    found = matches(source, rf"\\los\{{([^}}]*)\}}\s*\{{([^}}]*)\}}\s*{ARG}", {"los_id": 1, "level": 2, "statement": 3}, *keep)
    return found.select(*keep, "ord", *(tx.strip(F.regexp_replace(c, r"\s+", " ")).alias(c) for c in ("los_id", "level", "statement")))


def macro_rows(docs: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    """Every macro of names with its options and arguments, braces balanced to any depth: one pass over Arrow batches."""
    d = docs.select(*keep, F.col("text").alias("text_"))
    return d.mapInArrow(scan_macros(names), StructType([*d.schema.fields[:-1], *StructType.fromDDL(MACRO_FIELDS).fields]))


def terms(docs: DataFrame, *keep: str) -> DataFrame:
    r"""\term[outcome]{name}{definition}: los_id, name, definition, and the front of its card."""
    d = macro_rows(docs, ("term",), *keep).where(F.size("args") >= 2)
    return d.select(*keep, "ord", "off", F.try_element_at("options", F.lit(1)).alias("los_id"), tx.strip(F.col("args")[0]).alias("name"), tx.strip(F.col("args")[1]).alias("definition"), F.concat(F.lit("Define: "), tx.strip(F.col("args")[0])).alias("front"))


def margins(docs: DataFrame, *keep: str) -> DataFrame:
    """Margin notes of all macros: category and note."""
    from inkwell.functions import fixed

    names = F.create_map(*(F.lit(x) for p in fixed.MARGIN_MACROS.items() for x in p))
    d = macro_rows(docs, (*fixed.MARGIN_MACROS, "marginnote"), *keep)
    category = F.when(F.col("name") == "marginnote", F.try_element_at("options", F.lit(1))).otherwise(F.try_element_at(names, F.col("name")))
    return d.select(*keep, "ord", "off", category.alias("category"), tx.strip(F.col("args")[0]).alias("note"))


def environments(docs: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    """Environments with their options and body, off and end_off; bodies end at the first closing of the same name.

    One pass over the texts: a text is taken once for each name that it has. Environments of
    different names may lie in one another.
    """
    there = F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(F.col("text"), F.concat(F.lit("\\begin{"), n, F.lit("}"))))
    d = docs.select(*keep, "text", F.explode(there).alias("name"))
    begin, end = (F.concat(F.lit(rf"\\{w}\{{"), F.col("name"), F.lit(r"\}")) for w in ("begin", "end"))
    pieces = F.split("text", F.concat(F.lit("(?="), begin, F.lit(")")))
    d = d.select(*keep, "name", F.concat(F.lit("(?s)"), begin, F.lit("(.*?)"), end).alias("p_"), pieces.alias("pieces"))
    ends = F.aggregate(F.transform("pieces", lambda s: F.length(s)), F.array(F.lit(0)), lambda all_, n: F.concat(all_, F.array(F.element_at(all_, -1) + n)))
    # a row has its own piece and place, not the whole document
    d = d.select(*keep, "name", "p_", F.explode_outer(F.arrays_zip(F.col("pieces").alias("piece"), F.slice(ends, F.lit(1), F.size("pieces")).alias("off"))).alias("e"))
    d = d.select(*keep, "name", "p_", "e.piece", "e.off")
    d = d.withColumn("m", F.call_function("regexp_extract", "piece", "p_", F.lit(0))).where("m <> ''").withColumn("inner", F.call_function("regexp_extract", "piece", "p_", F.lit(1)))
    out = d.select(*keep, "name", "off", "m", "inner").withColumn("end_off", F.col("off") + F.length("m"))
    lead = F.regexp_extract("inner", r"^((?:\s*\[[^\]]*+\])*+)", 1)
    options = F.regexp_extract_all(lead, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    return out.select(*keep, "name", "off", "end_off", options.alias("options"), tx.strip(F.substr(F.col("inner"), F.length(lead) + 1)).alias("body"))


def problems(docs: DataFrame, *keep: str, reach: int = 15_000) -> DataFrame:
    """Problems with the nearest solution that begins after them and ends within reach characters; without one they are no cards."""
    envs = environments(docs, ("problem", "solution"), *keep)
    w = Window.partitionBy(*keep).orderBy("off").rowsBetween(1, Window.unboundedFollowing)
    solution = F.first(F.when(F.col("name") == "solution", F.struct("off", "end_off", "body")), ignorenulls=True).over(w)
    d = envs.withColumn("s", solution).where((F.col("name") == "problem") & F.col("s").isNotNull() & (F.col("s.end_off") <= F.col("end_off") + reach))
    return d.select(*keep, "off", F.try_element_at("options", F.lit(1)).alias("title"), F.try_element_at("options", F.lit(2)).alias("los_id"), F.col("body").alias("front"), F.col("s.body").alias("back"))


def labels(docs: DataFrame, *keep: str) -> DataFrame:
    r"""\label names outside comments, with their line."""
    return _by_line(docs, r"\\label\{([^}]*)\}", "label", *keep)


def references(docs: DataFrame, *keep: str) -> DataFrame:
    """Labels that the six reference commands name, with the command and line."""
    d = _by_line(docs, r"\\(?:ref|cref|Cref|autoref|pageref|eqref)\{([^}]*)\}", "label", *keep)
    return d


def _by_line(docs: DataFrame, pattern: str, name: str, *keep: str) -> DataFrame:
    d = docs.select(*keep, F.posexplode(tx.lines(tx.strip_comments("text"))).alias("p", "line"))
    return d.select(*keep, (F.col("p") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias(name))


def numbered_lines(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    d = docs.select(*keep, F.posexplode(tx.lines(text)).alias("p", "line"))
    return d.select(*keep, (F.col("p") + 1).alias("line_no"), "line")


def log_sources(lines: DataFrame, key: str) -> DataFrame:
    """Lines of a build log with the source they belong to: the last file opened before them, and a category."""
    opened = F.nullif(F.regexp_extract("line", r"\(\.?/?([^()\s]+\.tex)", 1), F.lit(""))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    category = (
        F.when(F.col("line").rlike(r"(?i)undefined (reference|citation)|Reference .* undefined"), "undefined")
        .when(F.col("line").rlike(r"Overfull \\hbox"), "overfull_hbox")
        .when(F.col("line").rlike(r"Overfull \\vbox"), "overfull_vbox")
        .when(F.col("line").rlike(r"Underfull"), "underfull")
        .when(F.col("line").rlike(r"LaTeX Warning"), "warning")
    )
    return lines.withColumn("source", F.last(opened, ignorenulls=True).over(w)).withColumn("category", category)


def pair_answers(turns: DataFrame) -> DataFrame:
    """Questions with the nearest later answer of the same conversation, if no other question lies between."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).withColumn("answer_turn", F.lead("turn").over(w))
    return d.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer_turn", "answer")


def pair_by_position(turns: DataFrame) -> DataFrame:
    """The k-th question with the k-th answer of a conversation; questions without one have none."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    k = turns.withColumn("k", F.row_number().over(w))
    q, a = k.where("role = 'user'"), k.where("role = 'assistant'")
    return q.select("conv_id", "k", F.col("turn").alias("question_turn")).join(a.select("conv_id", "k", F.col("turn").alias("answer_turn")), ["conv_id", "k"], "left")


def by_type(parts: dict[str, DataFrame]) -> DataFrame:
    """Ordered union of extractors' cards; ord_extractor keeps their order."""
    out = None
    for k, (name, d) in enumerate(parts.items()):
        one = d.withColumn("type", F.lit(name)).withColumn("ord_extractor", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(tx.col(c), r"\s+", " ")
