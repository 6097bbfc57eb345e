"""Currency gate: notes on what changed since a course was made, and on open debates, dated and cited throughout.

Both notes are cut into spans in one pass: at every mark of an item, or at every mark of a position and
every anchor of the book's own place, so that a position ends at the next mark or the nearest later
anchor. Rules then count within spans. A missing note (null) fails with that reason only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions import text as tx
from inkwell.operators.fleet import is_waived
from inkwell.operators.structure import MARK

_NAMES = "january february march april may june july august september october november december".split()


def citations(c: Column) -> Column:
    """Marks of sources that can be looked up."""
    return sum((tx.count(c, p) for p in fixed.CITATIONS[1:]), tx.count(c, fixed.CITATIONS[0]))


def spans(c: Column, marks: str) -> Column:
    """What begins with a match of marks, up to the next one."""
    parts = F.split(F.regexp_replace(F.replace(c, F.lit(MARK), F.lit(" ")), f"({marks})", MARK + "$1"), MARK)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def without_template(c: Column) -> Column:
    """The lines that hold none of the signatures of scaffolds."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~tx.any_of(*(F.contains(x, F.lit(s)) for s in fixed.SCAFFOLD_SIGNATURES))), "\n")


def stamped(c: Column) -> Column:
    """Months since year 0 of the first date: in numbers, or else in words with a month's name or its beginning."""
    number, word = (F.regexp_extract(c, p, 1) for p in (fixed.AS_OF_NUMBER, fixed.AS_OF_WORD))
    month = F.try_to_number(F.regexp_extract(c, fixed.AS_OF_NUMBER, 2), F.lit("99")).cast("int")
    names = F.array(*(F.lit(n) for n in _NAMES))
    name = F.lower(word)
    shorter = F.when(name == "sept", F.lit("sep")).otherwise(name)
    at = F.greatest(F.array_position(names, name), F.when(F.length(shorter) == 3, F.array_position(F.transform(names, lambda n: F.substring(n, 1, 3)), shorter)).otherwise(F.lit(0))).cast("int")
    in_numbers = F.when((number != "") & month.between(1, 12), number.cast("int") * 12 + month)
    return F.coalesce(in_numbers, F.when((word != "") & (at > 0), F.regexp_extract(c, fixed.AS_OF_WORD, 2).cast("int") * 12 + at))


def _uncited(of: Column) -> Column:
    return F.size(F.filter(of, lambda s: citations(s) < 1))


def currency_gate(notes: DataFrame, now: str, strict: bool = True) -> DataFrame:
    """collection, passed and detail of notes: collection, changes, debates (texts), velocity, version (or null),
    debates_waiver, debates_justification. now: year and month. strict: uncited spans are faults, else remarks.
    """
    year, month = (int(x) for x in now.split("-"))
    body = without_template(F.col("changes"))
    d = notes.withColumn("body_", body).withColumn("live_", tx.strip_comments_simple(F.col("body_")))
    before = F.split("live_", fixed.STILL_HOLDS_SECTION, 2)[0]
    parts = spans(before, fixed.SUBSECTION)
    d = d.withColumn("items_", F.when(F.size(parts) > 0, parts).otherwise(spans(before, fixed.LIST_ITEM)))
    d = d.withColumn("n_", F.greatest(tx.count("body_", fixed.LIST_ITEM), tx.count("body_", fixed.SUBSECTION))).withColumn("age_", F.lit(year * 12 + month) - stamped(F.col("changes")))
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in fixed.MAX_AGE_MONTHS.items() for x in p)), F.col("velocity")), F.lit(fixed.MAX_AGE_MONTHS["medium"]))
    version = F.nullif(F.regexp_extract("version", r"^\s*(?i)(v\d+)(?:\s|$)", 1), F.lit(""))
    named = F.array_contains(F.transform(F.regexp_extract_all("body_", F.lit(r"(?i)\bv\d+\b"), F.lit(0)), lambda v: F.lower(v)), F.lower(version))
    of_items = F.when(_uncited(F.col("items_")) > 0, F.concat(_uncited(F.col("items_")).cast("string"), F.lit("/"), F.size("items_").cast("string"), F.lit(" items uncited")))
    e = F.array_compact(F.array(
        F.when(F.col("body_").rlike(fixed.NO_CHANGES_YET) & (F.col("n_") < fixed.LEAST_ITEMS), "E is a stub (no-changes-yet placeholder)"),
        F.when(F.col("age_").isNull(), "E has no 'current as of YYYY-MM' date").when(F.col("age_") > limit, F.concat(F.lit("E age "), F.col("age_").cast("string"), F.lit("mo > "), "velocity", F.lit(" SLA "), limit.cast("string"), F.lit("mo"))).when(F.col("age_") < 0, "E date is in the future"),
        F.when(F.col("n_") < fixed.LEAST_ITEMS, f"<{fixed.LEAST_ITEMS} currency items"),
        F.when(~F.col("body_").rlike(fixed.STILL_HOLDS), "no 'what still holds' section"),
        of_items if strict else F.lit(None).cast("string"),
        F.when(version.isNotNull() & ~named, F.concat(F.lit("E does not name MEAP version ("), version, F.lit(")"))),
    ))
    d = d.withColumn("e_", F.when(F.col("changes").isNull(), F.array(F.lit(f"{fixed.CURRENCY_FILE} missing"))).otherwise(e)).withColumn("e_note_", F.when(F.col("changes").isNotNull(), of_items))
    text = without_template(F.col("debates"))
    d = d.withColumn("text_", text).withColumn("open_", tx.strip_comments_simple(F.col("text_"))).withColumn("debates_", tx.count("text_", fixed.BOOK_ANCHOR)).withColumn("cites_", citations(F.col("open_")))
    d = d.withColumn("positions_", F.filter(spans(F.col("open_"), f"{fixed.POSITION}|{fixed.BOOK_ANCHOR}"), lambda s: s.rlike("^" + fixed.POSITION)))
    floor = F.greatest(F.lit(fixed.LEAST_CITATIONS), 2 * F.col("debates_"))
    of_positions = F.when(_uncited(F.col("positions_")) > 0, F.concat(_uncited(F.col("positions_")).cast("string"), F.lit("/"), F.size("positions_").cast("string"), F.lit(" Positions uncited")))
    f = F.array_compact(F.array(
        F.when(F.col("debates_") < fixed.LEAST_DEBATES, F.concat(F.lit(f"<{fixed.LEAST_DEBATES} debates ("), F.col("debates_").cast("string"), F.lit(")"))),
        F.when(tx.count("text_", fixed.VERDICT) < fixed.LEAST_DEBATES, "missing verdict flags (well-supported/contested/dated)"),
        F.when(F.col("cites_") < floor, F.concat(F.lit("<"), floor.cast("string"), F.lit(" resolvable citations ("), F.col("cites_").cast("string"), F.lit(")"))),
        of_positions if strict else F.lit(None).cast("string"),
    ))
    none = F.array().cast("array<string>")
    d = d.withColumn("waived_", F.coalesce(is_waived(F.col("debates_waiver"), F.col("debates_justification")), F.lit(False)))
    d = d.withColumn("f_", F.when(F.col("waived_"), none).when(F.col("debates").isNull(), F.array(F.lit(f"{fixed.DEBATE_FILE} missing"))).otherwise(f))
    d = d.withColumn("f_note_", F.when(~F.col("waived_") & F.col("debates").isNotNull(), of_positions))
    passed = (F.size("e_") == 0) & (F.size("f_") == 0)
    well = F.when(F.col("waived_"), "waived").otherwise("ok")

    def part(label: str, issues: str, note: str, fine: Column) -> Column:
        core = F.when(F.size(issues) > 0, F.array_join(issues, "; ")).otherwise(fine)
        return F.concat(F.lit(f"{label}: "), core, F.lit("") if strict else F.coalesce(F.concat(F.lit(" ("), F.col(note), F.lit(", advisory)")), F.lit("")))

    notes_ = F.lit(False) if strict else F.col("e_note_").isNotNull() | F.col("f_note_").isNotNull()
    detail = F.when(passed & ~notes_, F.concat(F.lit("E ok; F "), well)).otherwise(F.concat(part("E", "e_", "e_note_", F.lit("ok")), F.lit(" | "), part("F", "f_", "f_note_", well)))
    return d.select("collection", passed.alias("passed"), detail.alias("detail"))


def collection_gates(decks: DataFrame, dashboards: DataFrame, fidelity: DataFrame, currency: DataFrame, collections: DataFrame) -> DataFrame:
    """collection, gate, passed and reason of the gates G3 (decks), G5 (fidelity), G6 (dashboard) and G7 (currency) of every collection.

    A collection that a gate's own rows lack fails it as missing.
    """
    out = None
    for name, rows, reason in (("G3", decks, "reason"), ("G5", fidelity, "reason"), ("G6", dashboards, "reason"), ("G7", currency, "detail")):
        one = collections.join(rows.select("collection", "passed", F.col(reason).alias("reason")), "collection", "left")
        one = one.select("collection", F.lit(name).alias("gate"), F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("reason", F.lit("missing")).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out
