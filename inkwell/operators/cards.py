"""Cards from marked-up documents: one declarative row per kind of element."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import text as tx
from inkwell.operators import elements


@dataclass(frozen=True)
class Kind:
    """An environment that makes a card: its type, the card's front before the title, and the longest back."""

    environment: str
    type: str
    front: str
    longest: int
    title: str = ""


#: Environments in the order in which their cards come.
KINDS = (
    Kind("redflag", "redflag", "Red flag: ", 500, "Red Flag"),
    Kind("formulacard", "formula", "Formula: ", 600, "Formula"),
    Kind("definition", "term", "Define: ", 1500),
    Kind("proposition", "formula", "State: ", 1600),
    Kind("theorem", "formula", "State: ", 2000),
    Kind("sixtysec", "sixtysec", "In sixty seconds: ", 500),
    Kind("keyconcept", "keyconcept", "", 1500),
    Kind("pitfall", "pitfall", "Pitfall: ", 500, "Pitfall"),
    Kind("interviewtip", "interviewtip", "Tip: ", 400, "Interview Tip"),
    Kind("decisiontree", "decisiontree", "Decide: ", 800, "Decision Tree"),
    Kind("actuarialbridge", "actuarialbridge", "Bridge: ", 800, "Bridge"),
    Kind("starstory", "starstory", "Story: ", 800, "Story"),
    Kind("paradox", "paradox", "Paradox: ", 600, "Paradox"),
)

#: How much a card of a type leads its reader; others are partial.
SCAFFOLDING = {
    "none": "term drill clozeterm termbi formula",
    "full": "vignette interview interviewtip starstory paradox",
}


def scaffolding(type_: Column, given: Column) -> Column:
    """A card's own level, else its type's."""
    level = F.when(type_.isin(*SCAFFOLDING["none"].split()), "none").when(type_.isin(*SCAFFOLDING["full"].split()), "full").otherwise("partial")
    return F.coalesce(F.nullif(given, F.lit("")), level)


def cut_at_sentence(c: Column, most: Column) -> Column:
    """At most most characters: to the last sentence end in the later 60 %, else to the last word with dots."""
    head = F.substr(c, F.lit(1), most)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])\s", 1)
    word = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(c) <= most, c).when(F.length(sentence) > most * 0.4, sentence).when(F.length(word) > most * 0.8, F.concat(word, F.lit("..."))).otherwise(F.concat(F.substr(c, F.lit(1), most - 3), F.lit("...")))


def question(title: Column) -> Column:
    """A concept's title as a question."""
    t = F.lower(title)
    return (
        F.when(F.endswith(title, F.lit("?")), title)
        .when(F.contains(t, F.lit(" vs")), F.concat(F.lit("Compare: "), title))
        .when(t.rlike(r"^(why|how|when|what)\b"), F.concat(title, F.lit("?")))
        .otherwise(F.concat(F.lit("Explain: "), title))
    )


def environment_cards(docs: DataFrame, *keep: str, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """type, title, los_id, front, back, scaffolding_level and places of the cards of all kinds, in document and kind order."""
    envs = elements.environments(docs, tuple(k.environment for k in kinds), *keep)

    def of(value) -> Column:
        out = F.lit(None)
        for k in kinds:
            out = F.when(F.col("name") == k.environment, F.lit(value(k))).otherwise(out)
        return out

    title = F.coalesce(F.nullif(F.try_element_at("options", F.lit(1)), F.lit("")), of(lambda k: k.title or None), F.lit("Untitled"))
    d = envs.where("body <> ''").withColumn("title", tx.strip(title)).withColumn("type", of(lambda k: k.type))
    front = F.when(F.col("type") == "keyconcept", question(F.col("title"))).otherwise(F.concat(of(lambda k: k.front), F.col("title")))
    body = elements.collapse_spaces("body")
    return d.select(*keep, "type", "title", F.try_element_at("options", F.lit(2)).alias("los_id"), front.alias("front"), cut_at_sentence(body, of(lambda k: k.longest)).alias("back"), scaffolding(F.col("type"), F.lit(None).cast("string")).alias("scaffolding_level"), "off", of(lambda k: kinds.index(k)).alias("ord_extractor"))


def cloze_cards(docs: DataFrame, *keep: str) -> DataFrame:
    r"""\clozeterm[outcome]{front}{back}: braces balanced, the second argument optional."""
    d = elements.macro_rows(docs, ("clozeterm",), *keep)
    return d.select(*keep, F.lit("cloze").alias("type"), F.try_element_at("options", F.lit(1)).alias("los_id"), tx.strip(F.col("args")[0]).alias("front"), F.coalesce(tx.strip(F.try_element_at("args", F.lit(2))), F.lit("")).alias("back"), "off")


def two_way_terms(docs: DataFrame, *keep: str) -> DataFrame:
    r"""\termbi{name}{definition}: a card each way; the reverse one asks by the definition's first 80 characters."""
    d = elements.macro_rows(docs, ("termbi",), *keep).where(F.size("args") >= 2).select(*keep, "off", tx.strip(F.col("args")[0]).alias("name"), tx.strip(F.col("args")[1]).alias("definition"))
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.concat(F.lit("Define: "), "name").alias("front"), F.col("definition").alias("back")),
        F.struct(F.lit(1).alias("way"), F.concat(F.lit("Which term: "), F.substring("definition", 1, 80)).alias("front"), F.col("name").alias("back")),
    )
    return d.select(*keep, "off", F.lit("termbi").alias("type"), F.explode(ways).alias("w")).select(*keep, "off", "type", "w.*")


def checkpoints(docs: DataFrame, *keep: str) -> DataFrame:
    """Questions of checkpoint boxes with their answers: in the item, else by position among the box's answers, else a placeholder.

    A question of fewer than 10 characters makes no card but keeps its place.
    """
    boxes = elements.environments(docs, ("checkpointbox",), *keep)
    halves = F.split("body", r"\\(?:textbf|paragraph|subparagraph)\s*\{\s*Answers?:?\s*\}", 2)

    def items(c: Column) -> Column:
        parts = F.split(F.regexp_replace(c, r"\\(?:begin|end)\{(?:enumerate|itemize)\}(?:\[[^\]]*\])?", ""), r"\\item\b")
        return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), tx.strip)

    d = boxes.select(*keep, "off", F.try_element_at("options", F.lit(1)).alias("title"), items(halves[0]).alias("questions"), F.when(F.size(halves) > 1, items(halves[1])).otherwise(F.array().cast("array<string>")).alias("answers"))
    d = d.select(*keep, "off", "title", "answers", F.posexplode("questions").alias("k", "item"))
    inline = F.nullif(tx.strip(F.regexp_extract("item", r"(?s)\\checkpointanswer" + elements.ARG + r"\s*$", 1)), F.lit(""))
    asked = tx.strip(F.regexp_replace(F.regexp_replace("item", r"(?s)\\checkpointanswer" + elements.ARG + r"\s*$", ""), r"^\[[^\]]*\]", ""))
    paired = tx.strip(F.regexp_replace(F.try_element_at("answers", F.col("k") + 1), r"^\[[^\]]*\]", ""))
    blank = F.concat(F.lit("Self-check from: "), F.coalesce("title", F.lit("Checkpoint")), F.lit("\n\n(Answer from memory, then verify against the chapter text.)"))
    d = d.select(*keep, "off", "k", F.nullif(F.regexp_extract("item", r"^\[([^\]]*)\]", 1), F.lit("")).alias("los_id"), asked.alias("front"), F.coalesce(inline, F.nullif(paired, F.lit("")), blank).alias("back"))
    return d.where(F.length("front") >= 10)


def previous_outcomes(cards: DataFrame, before: DataFrame) -> DataFrame:
    """Cards keep the outcome that the snapshot before gave their id, if they have none now."""
    known = before.where("los_id is not null").groupBy("id").agg(F.min("los_id").alias("was"))
    return cards.join(known, "id", "left").withColumn("los_id", F.coalesce("los_id", "was")).drop("was")


def mapped(cards: DataFrame, phrases: DataFrame) -> DataFrame:
    """Adds the first phrase of a bounded list (phrase, note, ord) that occurs in a card's text; null if none does."""
    hits = cards.select("ord", F.lower(F.concat_ws(" ", "front", "back")).alias("t_")).join(F.broadcast(phrases.withColumnRenamed("ord", "p_")), F.contains("t_", F.lower("phrase")))
    first = hits.groupBy("ord").agg(F.min_by("note", "p_").alias("note"))
    return cards.join(first, "ord", "left")


def paragraphs(lines: DataFrame, *key: str) -> DataFrame:
    """Paragraphs of lines: runs between blank lines, with their first line, lines and characters."""
    w = Window.partitionBy(*key).orderBy("line_no")
    blank = tx.strip("line") == ""
    d = lines.withColumn("island", F.sum(blank.cast("int")).over(w)).where(~blank)
    return d.groupBy(*key, "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars")).drop("island")


def nesting(lines: DataFrame, *key: str) -> DataFrame:
    """Lines with the depth of environments open after them."""
    w = Window.partitionBy(*key).orderBy("line_no")
    step = tx.count("line", r"\\begin\{") - tx.count("line", r"\\end\{")
    return lines.withColumn("depth", F.sum(step).over(w))
