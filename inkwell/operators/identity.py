"""Identity, duplicates and similarity of cards, lines and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions import similar
from inkwell.functions import text as tx


def card_ids(cards: DataFrame, order: list[str], generic: tuple[str, ...] = ()) -> DataFrame:
    """card_id from prefix and the best slug: of the title unless generic, else of the body, else of the outcome, else a hash.

    Later rows with an id that is taken get one suffix made of their title and body; a third equal
    row repeats it, and keep_first() drops it then. cards: prefix, title, body, los_id.
    """
    title, body, los = (tx.slug(F.coalesce(c, F.lit(""))) for c in ("title", "body", "los_id"))
    short = F.concat(F.lit("H"), F.upper(F.substring(F.md5(F.concat_ws("", "title", "body")), 1, 8)))
    best = F.when(~F.col("title").isin(*generic) if generic else F.lit(True), title).otherwise(F.lit(""))
    best = F.when(F.length(best) >= 4, best).when(F.length(body) >= 8, body).when(F.length(los) >= 4, los).otherwise(short)
    base = cards.withColumn("base_id", F.concat_ws("_", "prefix", best))
    n = F.row_number().over(Window.partitionBy("base_id").orderBy(*order))
    again = F.concat(F.col("base_id"), F.lit("_H"), F.substring(F.md5(F.concat_ws("", "title", "body")), 1, 6))
    return base.withColumn("card_id", F.when(n == 1, F.col("base_id")).otherwise(again)).drop("base_id")


def counted_ids(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Ids made unique by a counter: the first keeps its id, later ones get _2, _3 and so on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), n.cast("string"))))


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rn_", n).where("rn_ = 1").drop("rn_")


def guid(c: Column) -> Column:
    """First ten hexadecimal digits of the SHA-256 as a whole number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 10), 16, 10).cast("long")


def short_guid(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 10)


def collisions(cards: DataFrame) -> DataFrame:
    """Ids that occur more than once: how often, in how many collections, and whether within one or across."""
    d = cards.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("collection").alias("n_collections"), F.min("ord").alias("first_ord"))
    return d.where("n > 1").withColumn("scope", F.when(F.col("n_collections") > 1, "across").otherwise("within"))


def clone_groups(lines: DataFrame, least: int = 2) -> DataFrame:
    """Notes whose collapsed text occurs at least so often in a collection, with the number of documents."""
    d = lines.withColumn("clone", tx.collapse("line")).where("clone <> ''")
    return d.groupBy("collection", "clone").agg(F.count("*").alias("n"), F.count_distinct("ord").alias("n_docs")).where(F.col("n") >= least)


def clone_rates(lines: DataFrame, limit: float = 0.30) -> DataFrame:
    """Per collection: notes, those in clone groups, and whether their share is above limit. Two stages, so no group is gathered."""
    d = lines.withColumn("clone", tx.collapse("line")).where("clone <> ''").groupBy("collection", "clone").agg(F.count("*").alias("n"))
    out = d.groupBy("collection").agg(F.sum("n").alias("n_notes"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_cloned"))
    return out.withColumn("flagged", F.col("n_cloned") > limit * F.col("n_notes"))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with value as column name. It comes from a generator: a filter on a plain column is moved in front of it and works value out again."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def suffixes(items: DataFrame, n: int = 10) -> DataFrame:
    """Items with the last n words of text."""
    return once(items, "suffix", tx.suffix(tx.words("text"), n))


def suffix_clusters(items: DataFrame, least: int = 3, n: int = 10) -> DataFrame:
    """Endings that at least so many items of a collection share. Counted before anything is joined back."""
    d = suffixes(items, n).where("suffix is not null")
    return d.groupBy("collection", "suffix").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def templated(items: DataFrame, outcomes: DataFrame, known: tuple[str, ...], *keep: str, least: int = 3, n: int = 10, least_outcome: int = 3) -> DataFrame:
    """Items with a reason: an ending shared in their collection, a known ending, or their own outcome word for word.

    items: collection, los_id, text. outcomes: los_id, statement; the first statement of an id counts.
    """
    stated = outcomes.groupBy("los_id").agg(F.min_by("statement", "ord").alias("statement")).select("los_id", tx.words("statement").alias("wanted"))
    d = once(items, "words", tx.words("text")).drop("text").join(stated, "los_id", "left")
    # the words end here: what is joined below has only the ending and whether the outcome stands in the text
    verbatim = (F.size("wanted") >= least_outcome) & tx.contains_run(F.col("words"), F.col("wanted"))
    d = d.select(*dict.fromkeys((*keep, "collection")), "words", verbatim.alias("verbatim"))
    d = once(d, "suffix", tx.suffix(F.col("words"), n)).drop("words")
    shared = d.where("suffix is not null").groupBy("collection", "suffix").agg(F.count("*").alias("cluster")).where(F.col("cluster") >= least)
    d = d.join(shared, ["collection", "suffix"], "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("suffix").isin(*known), F.lit("known-tail")),
        F.when(F.col("cluster") >= least, F.concat(F.lit("shared-suffix(x"), F.col("cluster").cast("string"), F.lit(")"))),
        F.when(F.col("verbatim"), F.lit("verbatim-los")),
    ))
    return d.withColumn("reasons", reasons).where(F.size("reasons") > 0).select(*keep, F.array_join("reasons", ",").alias("reason"))


def reason_tally(found: DataFrame) -> DataFrame:
    """Items per kind of reason; an item may have several."""
    kind = F.explode(F.transform(F.split("reason", ","), lambda r: F.regexp_replace(r, r"\(.*$", "")))
    return found.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def run_hits(items: DataFrame, runs: DataFrame, n: int = 8) -> DataFrame:
    """(ord, run_id) where the words of a run stand in an item: the join is on the hash of the first n words, so no pairs are made up.

    items: ord, text; runs: run_id, text. A run of fewer than n words takes no part. Only places and
    hashes are exploded; the words of the items that have one are taken again for the comparison.
    """
    head = lambda w, k: F.xxhash64(*(F.get(w, k + j) for j in range(n)))  # noqa: E731  (a slice copies all words for each place)
    r = runs.withColumn("w", tx.words("text")).where(F.size("w") >= n).select("run_id", head(F.col("w"), F.lit(0)).alias("head"), F.col("w").alias("run"))
    heads = tx.let(tx.words("text"), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda k: head(w, k))))
    # outer: else a filter on the array's size is inferred, which takes the words again for each place
    met = items.select("ord", F.posexplode_outer(heads).alias("at", "head")).join(r.select("run_id", "head"), "head").select("ord", "at", "run_id")
    there = items.join(met.select("ord").distinct(), "ord", "left_semi").select("ord", tx.words("text").alias("w"))
    d = met.join(there, "ord").join(r.select("run_id", "run"), "run_id")
    return d.where(F.slice("w", F.col("at") + 1, F.size("run")) == F.col("run")).select("ord", "run_id").distinct()


def near_fronts(cards: DataFrame, least: int = 85, size: int = 20) -> DataFrame:
    """Pairs of different fronts of one collection with a word similarity of at least least/100, by shared rare words.

    Fronts of equal text are one; candidates share one of the words of a prefix in order of rarity,
    so no collection is expanded into all pairs. Returns the smallest ord of each front.
    """
    f = cards.withColumn("norm", tx.collapse("front")).where(F.length("norm") >= size).groupBy("collection", "norm").agg(F.min("ord").alias("ord"))
    f = f.withColumn("words", F.array_distinct(F.split("norm", " "))).withColumn("n", F.size("words"))
    words = f.select("collection", "ord", "n", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(counts, "word").groupBy("collection", "ord", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda s: s["word"]).alias("ordered"))
    take = F.col("n") - F.ceil(F.col("n") * least / 100) + 1
    prefix = ranked.select("collection", "ord", "n", F.posexplode(F.slice("ordered", F.lit(1), take.cast("int"))).alias("at", "word"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = (F.col("a.collection") == F.col("b.collection")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.ord") < F.col("b.ord"))
    fits = (F.col("a.n") * 100 >= F.col("b.n") * least) & (F.col("b.n") * 100 >= F.col("a.n") * least)
    # in front of the first word that both have there is none to share, so what is left has to do
    enough = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) * (100 + least) >= (F.col("a.n") + F.col("b.n")) * least
    met = a.join(b, near & fits & enough).select(F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b")).distinct()
    sets = lambda name, *more: ranked.select(*more, F.col("ord").alias(f"ord_{name}"), F.col("ordered").alias(name))
    pairs = met.join(sets("a", "collection"), "ord_a").join(sets("b"), "ord_b").select("collection", "ord_a", "ord_b", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("n"))
    return pairs.select("collection", "ord_a", "ord_b", "both", (F.col("n") - F.col("both")).alias("either")).where(F.col("both") * 100 >= F.col("either") * least)


def term_clusters(terms: DataFrame) -> DataFrame:
    """Per name: definitions, collections, and the longest definition's place; the first of equally long ones."""
    longest = F.max_by(F.struct("ord", "line_no"), F.struct(F.length("definition"), -F.col("ord"), -F.col("line_no")))
    return terms.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("collection").alias("n_collections"), longest.alias("c")).select("name", "n", "n_collections", F.col("c.ord").alias("canonical_ord"), F.col("c.line_no").alias("canonical_line"))


def term_duplicates(terms: DataFrame) -> DataFrame:
    """Names that a collection defines more than once."""
    return terms.groupBy("collection", "name").agg(F.count("*").alias("n")).where("n > 1")


def term_conflicts(terms: DataFrame, below: int = 50) -> DataFrame:
    """Pairs of collections whose first definitions of a name share less than below/100 of their words, as counts."""
    first = terms.groupBy("name", "collection").agg(F.min_by("definition", F.struct("ord", "line_no")).alias("definition"))
    first = first.withColumn("words", F.array_distinct(F.split(tx.collapse("definition"), " ")))
    a, b = first.alias("a"), first.alias("b")
    pairs = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.collection") < F.col("b.collection")))
    out = pairs.select("a.name", F.col("a.collection").alias("collection_a"), F.col("b.collection").alias("collection_b"), F.size(F.array_intersect("a.words", "b.words")).alias("both"), F.size(F.array_union("a.words", "b.words")).alias("either"))
    return out.where(F.col("both") * 100 < F.col("either") * below)


def repeated_lines(lines: DataFrame, *key: str) -> DataFrame:
    """Lines that equal the one before them but for a label at its start."""
    w = Window.partitionBy(*key).orderBy("line_no")
    plain = F.regexp_replace(tx.strip("line"), r"^\*\*[A-Za-z ]+:\*\*\s*", "")
    return lines.withColumn("plain", plain).withColumn("before", F.lag("plain").over(w)).where("plain <> '' and plain = before").select(*key, "line_no")


#: Buckets of the counts that order character triples: the table that is broadcast has no more rows.
TRIPLE_BUCKETS = 1 << 16


def front_classes(cards: DataFrame, size: int = 20) -> DataFrame:
    """text, ord, last and n: each different lower-cased front of at least size characters, its first and last card and its number of cards."""
    f = cards.select("ord", tx.strip(F.lower("front")).alias("text")).where(F.length("text") >= size)
    return f.groupBy("text").agg(F.min("ord").alias("ord"), F.max("ord").alias("last"), F.count("*").alias("n"))


def _triples(fronts: DataFrame) -> DataFrame:
    """ord, n, at, triple: the runs of three characters of each text (n characters) by place, as hashes."""
    chars = fronts.select("ord", F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("cs")).withColumn("n", F.size("cs"))
    at = F.sequence(F.lit(1), F.col("n") - 2)
    runs = F.transform(at, lambda i: F.concat(F.get("cs", i - 1), F.get("cs", i), F.get("cs", i + 1)))
    return chars.select("ord", "n", F.posexplode(F.transform(runs, lambda r: F.xxhash64(r))).alias("at", "triple"))


def ratio_candidates(fronts: DataFrame) -> DataFrame:
    """(a, b): every pair of texts that can have a matching-block ratio above 0.9, and few others; a is the longer or the later one.

    fronts: ord, text of at least 20 characters, all different. Matching blocks are a common subsequence: with lengths
    n and m it has more than 0.45 (n + m) characters, so at most 0.1 (n + m) stand beside it. Each of them parts one
    run of matched characters, and a parting spoils two triples, so at least o = (n + m - 7) / 4 triples are
    the same in order, and shifted by no more characters than stand beside the subsequence. Of a text's t triples, rarest first
    and then by place, the first t - o + k hold k of them, in both texts the same k as order is kept; candidates have k
    such hits. k grows with the length, and only these first triples meet, by triple and length class. A text
    meets its own class (lengths within 11/9) and the class below, so lengths that can't fit never meet.
    Counts of triples only order them and may collide; so may triples, being hashes, which only adds candidates. The texts are
    dealt out before they are cut, so that triples are ranked where they are made and only the first ones are shuffled. Texts that are all nearly alike meet once for each triple they share.
    """
    parts = int(fronts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = _triples(fronts.repartition(parts, "ord")).withColumn("bucket", F.pmod("triple", F.lit(TRIPLE_BUCKETS)))
    counts = d.groupBy("bucket").agg(F.count("*").alias("df"))
    d = d.join(F.broadcast(counts), "bucket").withColumn("rank", F.row_number().over(Window.partitionBy("ord").orderBy("df", "triple", "at")))
    hits = F.lit(1) + F.floor(F.col("n") / 8)
    least = lambda total: F.ceil((total - 7) / 4)
    shortest = F.greatest(F.floor(F.col("n") * 9 / 11) + 1, F.lit(20))
    d = d.withColumn("k", hits).withColumn("class", F.floor(F.log("n") / F.log(F.lit(11 / 9))))
    first = lambda total: F.col("n") - 2 - least(total) + F.least(F.col("k"), least(total))
    short = F.col("rank") <= first(F.col("n") * 2)
    d = d.where(F.col("rank") <= first(F.col("n") + shortest)).select("ord", "n", F.col("at").cast("int"), "triple", F.col("class").alias("own"), short.alias("short"), F.explode(F.array("class", F.col("class") - 1)).alias("class"))
    # both sides are one shuffle: rows that can only be a have a length below 0, which no condition on b fits
    n = F.when(F.col("short") & (F.col("class") == F.col("own")), F.col("n")).otherwise(-F.col("n"))
    tokens = d.select("ord", n.alias("n"), "at", F.xxhash64("triple", "class").alias("key")).repartition(parts, "key")
    a, b = tokens.alias("a"), tokens.alias("b")
    length = F.abs("a.n")
    beside = F.floor((length + F.col("b.n")) * 9 / 20) + 1
    later = (length > F.col("b.n")) | ((length == F.col("b.n")) & (F.col("a.ord") > F.col("b.ord")))
    shift = F.col("a.at") - F.col("b.at")
    fits = later & (F.col("b.n") * 11 > length * 9) & (shift <= length - beside) & (shift >= beside - F.col("b.n"))
    met = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & fits)
    out = met.groupBy(F.col("a.ord").alias("a"), F.col("b.ord").alias("b")).agg(F.count("*").alias("hits"), F.first("b.n").alias("n"))
    return out.where(F.col("hits") >= 1 + F.floor(F.col("n") / 8)).select("a", "b")


def ratio_pairs(cards: DataFrame, size: int = 20) -> DataFrame:
    """ord_a, ord_b, n_a, n_b, ratio: all pairs of different fronts with a matching-block ratio above 0.9, over all collections.

    Fronts are compared lower-cased and stripped; those under size (20 or more) characters and null ones take no part. Equal fronts are one, with
    their first card and number of cards. The ratio isn't symmetric: of two cards the later one's front is compared with the
    earlier one's. If cards of both fronts come after one of the other's, the greater ratio counts.
    """
    fronts = front_classes(cards, size)
    pairs = ratio_candidates(fronts.select("ord", "text"))
    one = fronts.select(F.col("ord").alias("a"), F.col("text").alias("text_a"), F.col("last").alias("last_a"), F.col("n").alias("cards_a"))
    two = fronts.select(F.col("ord").alias("b"), F.col("text").alias("text_b"), F.col("last").alias("last_b"), F.col("n").alias("cards_b"))
    d = pairs.join(one, "a").join(two, "b")
    a_later, b_later = F.col("last_a") > F.col("b"), F.col("last_b") > F.col("a")
    nobody = F.lit(None).cast("string")
    d = d.withColumn("ratio", similar.high_ratio(F.when(a_later, F.col("text_a")).otherwise(nobody), "text_b", "text_a", F.when(b_later, F.col("text_b")).otherwise(nobody)))
    first = F.col("a") < F.col("b")
    swap = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return d.where("ratio > 0.9").select(swap("a", "b").alias("ord_a"), swap("b", "a").alias("ord_b"), swap("cards_a", "cards_b").alias("n_a"), swap("cards_b", "cards_a").alias("n_b"), F.round("ratio", 6).alias("ratio"))
