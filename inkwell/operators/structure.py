r"""Structure of marked-up documents from one stream of tokens: boxes, nested lists, environments and what follows them.

A text is split in front of every token, and running sums over its pieces tell how deep each lies. So
nesting to any depth needs no parser, and a document's pieces are the only rows that meet. The
columns in keep have to name a document; pieces of one document are one window.

Null and empty texts give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import fixed
from inkwell.functions import text as tx

MARK = "\x01"


def nested(levels: int) -> str:
    """Pattern of what stands between balanced braces nested so deep at most; possessive."""
    inner = r"[^{}]*+"
    for _ in range(levels):
        inner = rf"(?:[^{{}}]++|\{{{inner}\}})*+"
    return inner


def tokens(docs: DataFrame, pattern: str, *keep: str, text: str = "text") -> DataFrame:
    """keep, k (from 0), off and piece: the text in pieces, each but the first beginning with a match of pattern."""
    marked = F.regexp_replace(F.replace(F.col(text), F.lit(MARK), F.lit(" ")), rf"({pattern})", MARK + "$1")
    # outer: else a filter on the array's size is inferred, which makes the texts again
    pieces = F.posexplode_outer(F.when(F.col(text) != "", F.split(marked, MARK))).alias("k", "piece")
    d = docs.select(*keep, pieces).where("k is not null")
    before = Window.partitionBy(*keep).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("off", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long"))


def list_items(docs: DataFrame, *keep: str) -> DataFrame:
    r"""Items of checkpoint boxes: keep, box, title, half (0: asked, 1: answers), no, off and item.

    A box is a checkpointbox, or a tcolorbox of that style; it ends where its environment does, whatever
    is nested in it, and one that isn't closed before the next box is none. From the first mark of
    answers on its items are answers. In each half the items at the least depth of lists count; one ends
    at the next or where its own list ends, with all lists inside it.
    """
    d = tokens(docs, fixed.LIST_TOKENS, *keep)
    env = F.regexp_extract("piece", r"^\\(?:begin|end)\{([^}]*)\}", 1)
    step = F.when(F.col("piece").rlike(r"^\\begin\{"), 1).when(F.col("piece").rlike(r"^\\end\{"), -1).otherwise(0)
    opens = F.col("piece").rlike(fixed.CHECKPOINT_OPENING).cast("int")
    doc = Window.partitionBy(*keep).orderBy("k")
    d = d.select(*keep, "k", "off", "piece", env.alias("env"), step.alias("step"), opens.alias("opens"), F.sum(opens).over(doc).alias("box")).where("box > 0")
    whole = Window.partitionBy(*keep, "box")
    run = whole.orderBy("k")
    d = d.withColumn("owner", F.first("env").over(run)).withColumn("open", F.sum(F.when(F.col("env") == F.col("owner"), F.col("step")).otherwise(0)).over(run))
    d = d.withColumn("least", F.min("open").over(run)).withColumn("closed", F.min("open").over(whole) <= 0).where("closed and least >= 1")
    d = d.withColumn("half", (F.sum(F.col("piece").rlike(fixed.ANSWERS_MARK).cast("int")).over(run) > 0).cast("int"))
    d = d.withColumn("title", F.first(F.nullif(tx.strip(F.regexp_extract("piece", r"^\\begin\{tcolorbox\}\[[^\n]*?title\s*=\s*\{?([^}\]]+)", 1)), F.lit(""))).over(run))
    half = Window.partitionBy(*keep, "box", "half")
    inside = F.when(F.col("opens") == 1, 0).otherwise(F.col("step"))
    d = d.withColumn("depth", F.coalesce(F.sum(inside).over(half.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    item = F.col("piece").rlike(r"^\\item\b")
    d = d.withColumn("base", F.min(F.when(item, F.col("depth"))).over(half))
    top = (item & (F.col("depth") == F.col("base"))).cast("int")
    d = d.withColumn("no", F.sum(top).over(half.orderBy("k"))).where("no > 0")
    shut = F.max(((F.col("step") == -1) & (F.col("depth") == F.col("base"))).cast("int")).over(Window.partitionBy(*keep, "box", "half", "no").orderBy("k"))
    d = d.withColumn("shut", shut).where("shut = 0")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"])
    d = d.groupBy(*keep, "box", "half", "no").agg(F.first("title").alias("title"), F.min("off").alias("off"), F.array_join(parts, "").alias("item"))
    return d.withColumn("item", tx.strip(F.substring("item", 6, 1 << 30)))


def item_outcome(c: Column | str) -> Column:
    """The outcome that an item names: in its bracket, or set to the right of it; null if neither."""
    bracket = F.regexp_extract(tx.col(c), r"^\[([A-Z0-9]+-[\d.]+)\]", 1)
    return F.coalesce(F.nullif(bracket, F.lit("")), F.nullif(F.regexp_extract(tx.col(c), r"\\hfill\\textit\{[^}]*?([A-Z0-9]+-[\d.]+)", 1), F.lit("")))


def checkpoint_cards(docs: DataFrame, chapter: str, *keep: str) -> DataFrame:
    r"""A card for each question of a checkpoint box: box, no, off, title, los_id, front, back and from (where the back is from).

    The back is the item's own \checkpointanswer, else the answer of the same place, else a placeholder.
    A question of fewer than 10 characters makes no card and keeps its place.
    """
    d = list_items(docs, *keep, chapter)
    asked, answered = (F.max(F.when(F.col("half") == h, F.struct("off", "item"))) for h in (0, 1))
    d = d.groupBy(*keep, chapter, "box", "no").agg(F.max("title").alias("title"), asked.alias("q"), answered.alias("a")).where("q is not null")
    title = F.coalesce("title", F.concat(F.col(chapter), F.lit(" Checkpoint")))
    own = rf"(?s)\\checkpointanswer\s*+\{{({nested(4)})\}}"
    item, bracket = F.col("q.item"), r"^(?:\[[^\]]*\])?\s*"
    inline = F.nullif(tx.strip(F.regexp_extract(item, own, 1)), F.lit(""))
    front = tx.strip(F.regexp_replace(F.when(item.rlike(own), F.regexp_extract(item, r"(?s)^(.*?)\\checkpointanswer\s*\{", 1)).otherwise(item), bracket, ""))
    paired = F.nullif(tx.strip(F.regexp_replace(F.col("a.item"), bracket, "")), F.lit(""))
    placeholder = F.concat(F.lit("Self-check from: "), title, F.lit(fixed.CHECKPOINT_PLACEHOLDER))
    source = F.when(inline.isNotNull(), "inline").when(paired.isNotNull(), "paired").otherwise("placeholder")
    out = d.select(*keep, "box", "no", F.col("q.off").alias("off"), title.alias("title"), item_outcome(item).alias("los_id"), front.alias("front"), F.coalesce(inline, paired, placeholder).alias("back"), source.alias("back_from"))
    return out.where(F.length("front") >= 10)


def checkpoint_prompts(docs: DataFrame, *keep: str) -> DataFrame:
    """Items of boxes that name an outcome in their bracket, without answer keys: answers whose outcome the same box also asks."""
    d = list_items(docs, *keep).withColumn("los_id", F.nullif(F.regexp_extract("item", r"^\[([A-Z0-9]+-[\d.]+)\]", 1), F.lit(""))).where("los_id is not null")
    asked = F.max((F.col("half") == 0).cast("int")).over(Window.partitionBy(*keep, "box", "los_id"))
    d = d.withColumn("key", (F.col("half") == 1) & (asked == 1)).where("not key")
    body = tx.strip(F.regexp_replace("item", r"^\[[^\]]*\]", ""))
    return d.select(*keep, "box", "half", "no", "off", "los_id", tx.words(body).alias("words"))


def vignettes(docs: DataFrame, *keep: str, reach: int = fixed.VIGNETTE_REACH) -> DataFrame:
    r"""Case studies with the solution that belongs to them: keep, off, title, los_id, front, back and has_solution.

    A solution belongs to a vignette if it begins after it with no other problem or vignette opening in
    between, and ends within reach characters: for every vignette the next opening of any kind decides,
    found by a window over the document's tokens. The body is split at the first mark of questions, by the
    first kind of mark that occurs.
    """
    d = tokens(docs, fixed.VIGNETTE_TOKENS, *keep)
    env = F.regexp_extract("piece", r"^\\(?:begin|end)\{([a-z]*)\}", 1)
    d = d.withColumn("env", env).withColumn("opens", F.col("piece").rlike(r"^\\begin\{") & (F.col("env") != "")).withColumn("ends", F.col("piece").rlike(r"^\\end\{"))
    doc = Window.partitionBy(*keep).orderBy("k")
    later = doc.rowsBetween(1, Window.unboundedFollowing)
    finish = F.first(F.when(F.col("ends") & (F.col("env") == "solution"), F.col("off") + F.lit(len("\\end{solution}"))), ignorenulls=True).over(later)
    d = d.withColumn("finish", F.when(F.col("opens") & (F.col("env") == "solution"), finish))
    d = d.withColumn("next", F.first(F.when(F.col("opens"), F.struct("env", "off", "finish")), ignorenulls=True).over(later))
    d = d.withColumn("closing", F.col("ends") & (F.col("env") == "vignette"))
    d = d.withColumn("round", F.coalesce(F.sum(F.col("closing").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = Window.partitionBy(*keep, "round").orderBy("k")
    d = d.withColumn("begun", F.max((F.col("opens") & (F.col("env") == "vignette")).cast("int")).over(same)).where("begun = 1")
    closing = F.col("closing")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~closing, F.struct("k", "piece")))), lambda p: p["piece"]), "")
    d = d.groupBy(*keep, "round").agg(F.min("off").alias("off"), body.alias("body"), F.max(F.when(closing, F.col("off") + F.lit(len("\\end{vignette}")))).alias("end_off"), F.max(F.when(closing, F.col("next"))).alias("next")).where("end_off is not null")
    found = (F.col("next.env") == "solution") & (F.col("next.finish") <= F.col("end_off") + reach)
    start, size = F.col("next.off") + len("\\begin{solution}") + 1, F.col("next.finish") - F.col("next.off") - len("\\begin{solution}\\end{solution}")
    d = d.select(*keep, "off", "body", F.when(found, start).alias("from_"), F.when(found, size).alias("size_"))
    # a merge, as files tell nothing of the size of texts, which may be too large for the driver
    d = d.hint("merge").join(docs.select(*keep, F.replace(F.col("text"), F.lit(MARK), F.lit(" ")).alias("whole_")), list(keep))
    solution = F.nullif(tx.strip(F.expr("substring(whole_, cast(from_ as int), cast(size_ as int))")), F.lit(""))
    lead = r"(?s)^\\begin\{vignette\}(?:\[([^\]]*)\])?(?:\[([^\]]*)\])?(.*)$"
    text = tx.strip(F.regexp_extract("body", lead, 3))
    kind = F.coalesce(*(F.when(text.rlike(p), F.lit(p)) for p in fixed.QUESTION_MARKS), F.lit(None).cast("string"))
    d = d.select(*keep, "off", F.regexp_extract("body", lead, 1).alias("t_"), F.nullif(tx.strip(F.regexp_extract("body", lead, 2)), F.lit("")).alias("los_id"), text.alias("text_"), kind.alias("kind_"), solution.alias("solution_"))
    at = F.coalesce(*(F.when(F.col("kind_") == p, F.length(F.regexp_extract("text_", rf"(?s)^(.*?)(?:{p})", 1))) for p in fixed.QUESTION_MARKS))
    title = F.coalesce(F.nullif(F.col("t_"), F.lit("")), F.lit("Case Study"))
    front = F.concat(F.lit("Case Study: "), title, F.when(at.isNotNull(), F.concat(F.lit("\n\n"), tx.strip(F.substr(F.col("text_"), F.lit(1), at)))).otherwise(F.lit("")))
    back = F.when(at.isNotNull(), F.substr(F.col("text_"), at + 1)).otherwise(F.col("text_"))
    rubric = F.when(F.col("solution_").isNotNull(), F.concat(F.lit("\n\n---\n\n**Answer Rubric:**\n"), "solution_")).otherwise(F.lit(""))
    return d.select(*keep, "off", title.alias("title"), "los_id", front.alias("front"), F.concat(back, rubric).alias("back"), F.col("solution_").isNotNull().alias("has_solution"))
