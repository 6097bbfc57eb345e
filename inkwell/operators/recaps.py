r"""Answers that only point at their solution, written anew from it.

A text is cut at problems, solutions and the answers in question; windows say which solution and problem an
answer belongs to, its own piece is replaced, and the pieces are put together again: all edits of a document are one pass.
The columns in keep have to name a document and mustn't be called k, off, piece or spot_. Null and empty texts stay. Marks
of earlier recaps are no part of a solution, so a recap never quotes one and a second run changes nothing.
Joins are merges: files tell nothing of the size of texts, which may be too large for the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import fixed
from inkwell.functions import text as tx
from inkwell.operators.structure import MARK, tokens

ANSWER = "\\textbf{Answer:}"
MARKED = r"% NEW: auto-generated 2026-04-30 - please review and refine\n\\textbf\{Answer:\}"


def _spots(docs: DataFrame, spot: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Pieces of the texts, and those that begin with spot and lie in a solution, with solution, problem and the piece behind (after)."""
    d = tokens(docs, rf"\\begin\{{(?:problem|solution)\}}|\\end\{{solution\}}|{spot}", *keep)
    doc = Window.partitionBy(*keep).orderBy("k")
    before, later = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(1, Window.unboundedFollowing)
    starts = lambda s: F.startswith("piece", F.lit(s))
    d = d.withColumn("p_", F.last(F.when(starts("\\begin{problem}"), F.col("off")), ignorenulls=True).over(before))
    d = d.withColumn("s_", F.last(F.when(starts("\\begin{solution}"), F.struct("off", "p_")), ignorenulls=True).over(before))
    d = d.withColumn("e_", F.first(F.when(starts("\\end{solution}"), F.col("off")), ignorenulls=True).over(later)).withColumn("after", F.lead("piece").over(doc))
    found = d.where(F.col("piece").rlike("^" + spot) & F.col("s_").isNotNull() & F.col("e_").isNotNull())
    whole = docs.select(*keep, F.replace(F.col("text"), F.lit(MARK), F.lit(" ")).alias("whole_"))
    part = lambda a, b: F.substr("whole_", a.cast("int") + 1, (b - a).cast("int"))
    found = found.hint("merge").join(whole, list(keep)).select(*keep, F.col("k").alias("spot_"), "piece", "after", F.replace(part(F.col("s_.off"), F.col("e_")), F.lit(fixed.RECAP_MARK + "\n"), F.lit("")).alias("solution"), F.coalesce(part(F.col("s_.p_"), F.col("s_.off")), F.lit("")).alias("problem"))
    return d.select(*keep, "k", "piece"), found


def sentence(c: Column) -> Column:
    """The first sentence if it has more than 30 characters; else all of at most 280, or of these to the last full stop behind the 60th."""
    whole = tx.strip(c)
    head = F.regexp_extract(whole, r"(?s)^(.*?(?<!\d)[.!?])\s+[A-Z]", 1)
    most = F.substring(whole, 1, 280)
    stop = F.regexp_extract(most, r"(?s)^(.*\.)", 1)
    return F.when(F.length(head) > 30, head).when(F.length(whole) <= 280, whole).when(F.length(stop) > 60, stop).otherwise(tx.rstrip(most))


def several_parts(c: Column | str) -> Column:
    """Whether a problem asks for several parts: a numbered list, or at least two letters in brackets."""
    c = tx.col(c)
    marks = [F.regexp_count(c, F.lit(p)) >= 2 for p in (r"\([a-z]\)~", r"\([a-z]\)\s+[A-Za-z\\$]")]
    return F.contains(c, F.lit("\\begin{enumerate}")) | marks[0] | marks[1]


def _flat(c: Column) -> Column:
    """Without nested lists, white space collapsed."""
    return tx.strip(F.regexp_replace(F.regexp_replace(c, r"\\begin\{(itemize|enumerate)\}(?:\[[^\]]*\])?[\s\S]*?\\end\{\1\}", " "), r"\s+", " "))


def _part_lines(approach: Column) -> Column:
    """A line for each part with a bold label, lettered or else numbered; null if there are fewer than two."""

    def lines(label: str) -> Column:
        pattern = F.lit(rf"\\textbf\{{{label}\s*([^}}]*?)\}}\s*([\s\S]*?)" + fixed.PART_END)
        pairs = F.arrays_zip(F.regexp_extract_all(approach, pattern, F.lit(1)).alias("t"), F.regexp_extract_all(approach, pattern, F.lit(2)).alias("b"))

        def line(p: Column) -> Column:
            title = tx.strip(F.regexp_replace(F.regexp_replace(tx.strip(F.regexp_replace(p["t"], ":+$", "")), r"\.+$", ""), ":+$", ""))
            body = _flat(p["b"])
            bold = F.concat(F.lit("\\textbf{"), title)
            return F.when((title != "") & (body != ""), F.concat(bold, F.lit(":} "), sentence(body))).when(title != "", F.concat(bold, F.lit("}."))).when(body != "", sentence(body)).otherwise(F.lit(fixed.NO_SUMMARY))

        return F.when(F.size(pairs) >= 2, F.transform(pairs, line))

    return F.coalesce(lines(r"\([a-z]\)"), lines(r"\d+\."))


def _item_lines(spots: DataFrame, *key: str) -> DataFrame:
    """key and items: the first sentences of the items of the approach's first numbered list that is closed, nested lists left out.

    Items at the list's own depth count, and so does text before the first of them.
    """
    d = tokens(spots, r"\\begin\{[^}]+\}|\\end\{[^}]+\}|\\item\b", *key, text="approach")
    run = Window.partitionBy(*key).orderBy("k")
    env = F.regexp_extract("piece", r"^\\(?:begin|end)\{([^}]+)\}", 1)
    step = F.when(F.startswith("piece", F.lit("\\begin{")), 1).when(F.startswith("piece", F.lit("\\end{")), -1).otherwise(0)
    d = d.withColumn("own", F.when(env == "enumerate", step).otherwise(0)).withColumn("step", step)
    d = d.withColumn("begun", F.max((F.col("own") == 1).cast("int")).over(run)).where("begun = 1")
    d = d.withColumn("open", F.sum("own").over(run)).withColumn("shut", F.max((F.col("open") <= 0).cast("int")).over(run))
    d = d.withColumn("closed", F.max("shut").over(Window.partitionBy(*key))).where("closed = 1 and shut = 0")
    d = d.withColumn("depth", F.coalesce(F.sum("step").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("no", F.sum((F.col("piece").rlike(r"^\\item\b") & (F.col("depth") == 1)).cast("int")).over(run))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"]), "")
    d = d.groupBy(*key, "no").agg(text.alias("item"))
    item = tx.strip(F.regexp_replace("item", F.when(F.col("no") == 0, F.lit(r"^\\begin\{enumerate\}(?:\[[^\]]*\])?")).otherwise(F.lit(r"^\\item\b\s*")), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(item, r"\\begin\{(itemize|enumerate)\}(?:\[[^\]]*\])?[\s\S]*?\\end\{\1\}", " "), r"^\\textbf\{[^}]+\}\s*[:.]?\s*", "")
    d = d.select(*key, "no", tx.strip(F.regexp_replace(bare, r"\s+", " ")).alias("line")).where("line <> ''")
    return d.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda p: sentence(p["line"])).alias("items"))


def answers(spots: DataFrame, *key: str) -> DataFrame:
    r"""key and answer, from solution and problem: the recap of the solution's approach.

    If the problem asks for several parts, they are the approach's labelled parts or the items of its list, if there are at least two; else it is
    the approach's first sentence, without an approach the key insight's, without both a fixed reference.
    """
    approach = tx.strip(F.regexp_extract("solution", rf"(?s)\\textbf\{{Approach:\}}\s*(.*?)(?={fixed.APPROACH_END}|\z)", 1))
    d = spots.select(*key, "solution", several_parts("problem").alias("several"), approach.alias("approach"))
    d = d.hint("merge").join(_item_lines(d.where("several").select(*key, "approach"), *key), list(key), "left")
    part = F.when(F.col("several"), F.coalesce(_part_lines(F.col("approach")), F.when(F.size("items") >= 2, F.col("items"))))
    listed = F.concat(F.lit(ANSWER + "\n\\begin{enumerate}[label=(\\alph*)]\n"), F.array_join(F.transform(part, lambda x: F.concat(F.lit("  \\item "), x)), "\n"), F.lit("\n\\end{enumerate}"))
    key_insight = F.regexp_extract("solution", r"(?s)\\textbf\{Key Insight:\}\s*(.+?)(?=\\textbf\{|\z)", 1)
    plain = F.when(F.col("approach") != "", sentence(F.col("approach"))).when(key_insight != "", sentence(key_insight)).otherwise(F.lit(fixed.NO_APPROACH))
    return d.select(*key, F.when((F.col("approach") != "") & part.isNotNull(), listed).otherwise(F.concat(F.lit(ANSWER + " "), plain)).alias("answer"))


def _put(docs: DataFrame, pieces: DataFrame, new: DataFrame, *keep: str) -> DataFrame:
    """keep, text and replaced: the texts with the pieces of new (keep, spot_, new) in place of their own."""
    d = pieces.hint("merge").join(new.withColumnRenamed("spot_", "k"), [*keep, "k"], "left")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("new", "piece").alias("piece")))), lambda p: p["piece"]), "")
    made = d.groupBy(*keep).agg(whole.alias("text"), F.count("new").alias("replaced"))
    rest = docs.where("text is null or text = ''").select(*keep, "text", F.lit(0).cast("long").alias("replaced"))
    return made.unionByName(rest)


def recapped(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, text and replaced: answers that only say to see the solution are recaps of it, below a mark that they are to be reviewed.

    An answer outside any solution stays.
    """
    pieces, spots = _spots(docs, fixed.STUB, *keep)
    new = F.concat(F.lit(fixed.RECAP_MARK + "\n"), "answer", F.regexp_replace("piece", "^" + fixed.STUB, ""))
    made = answers(spots, *keep, "spot_").hint("merge").join(spots.select(*keep, "spot_", "piece"), [*keep, "spot_"])
    return _put(docs, pieces, made.select(*keep, "spot_", new.alias("new")), *keep)


def cut_short(answer: Column, several: Column) -> Column:
    """Whether a recap is none: empty, a bare label, or too few parts for a problem that asks for several."""
    body = tx.strip(F.regexp_replace(tx.strip(answer), r"^\\textbf\{Answer:\}\s*", ""))
    bare = body.rlike(r"^\\textbf\{\d+\.[\s\S]{0,5}\z") | body.rlike(r"^\\textbf\{\([a-z]\)[\s\S]{0,5}\z")
    few = (F.regexp_count(body, F.lit(r"\\item\s+")) < 2) & (F.regexp_count(body, F.lit(r"\\textbf\{[^}]+\}")) < 3)
    return (body == "") | bare | (several & few)


def renewed(docs: DataFrame, *keep: str, force: bool = False) -> DataFrame:
    """keep, text and replaced: marked recaps that were cut short (force: all) are made again; those that come out the same stay.

    A recap reaches to its solution's end; one with another mark, problem or solution before that is left alone.
    """
    pieces, spots = _spots(docs, MARKED, *keep)
    spots = spots.where(F.startswith("after", F.lit("\\end{solution}"))).withColumn("old", F.substring("piece", len(fixed.RECAP_MARK) + 2, 1 << 30))
    if not force:
        spots = spots.where(cut_short(F.col("old"), several_parts("problem")))
    made = answers(spots, *keep, "spot_").hint("merge").join(spots.select(*keep, "spot_", "old"), [*keep, "spot_"]).where(tx.strip("old") != tx.strip("answer"))
    return _put(docs, pieces, made.select(*keep, "spot_", F.concat(F.lit(fixed.RECAP_MARK + "\n"), "answer", F.lit("\n")).alias("new")), *keep)
