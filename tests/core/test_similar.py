"""Complete near-duplicates by character ratio against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from inkwell.functions import similar
from inkwell.functions import text as tx
from inkwell.operators import identity


def plain(cards):
    """The rule itself on every two cards, a later one against an earlier one; equal fronts are one."""
    kept = [(o, f.lower().strip()) for o, f in sorted(cards) if f is not None]
    kept = [(o, f) for o, f in kept if len(f) >= 20]
    first, best = {}, {}
    for k, (o, f) in enumerate(kept):
        first.setdefault(f, o)
        for _, g in kept[:k]:
            if f != g:
                r = SequenceMatcher(None, f, g).ratio()
                key = tuple(sorted((first[f], first[g])))
                if r > 0.9:
                    best[key] = max(best.get(key, 0), r)
    return {k: round(v, 6) for k, v in best.items()}


def edited(rng, text, n, alphabet):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        way = rng.randrange(3)
        if way == 0:
            out[at] = rng.choice(alphabet)
        elif way == 1:
            out.insert(at, rng.choice(alphabet))
        else:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["ab", "abcdef ", "etaoinshrdlucmfgypwb   ", "éß\U0001f600\n漢 x"])
def test_complete(spark, alphabet):
    rng = random.Random(len(alphabet))
    cards = []
    for _ in range(14):
        base = "".join(rng.choice(alphabet) for _ in range(rng.choice((20, 21, 25, 40, 60, 130, 250))))
        # edits spread so evenly that hardly a word stays whole
        cards += [base] + [edited(rng, base, max(1, int(len(base) * share)), alphabet) for share in (0.02, 0.05, 0.07, 0.09, 0.1, 0.12)]
        cards += [base.upper() + "  ", base[: len(base) * 9 // 11], base + base[: len(base) * 2 // 9], base[len(base) // 9 :]]
    cards = list(enumerate([*cards, None, "", "short", cards[3], cards[0]]))
    rng.shuffle(cards)
    found = identity.ratio_pairs(spark.createDataFrame(cards, "ord long, front string")).collect()
    assert {(r.ord_a, r.ord_b): r.ratio for r in found} == plain(cards)
    assert len(found) == len({(r.ord_a, r.ord_b) for r in found}) and len(found) > 20


def test_edges_of_near_fronts(spark):
    empty = identity.ratio_pairs(spark.createDataFrame([], "ord long, front string, text string, n int"))
    assert empty.columns == ["ord_a", "ord_b", "n_a", "n_b", "ratio"] and empty.count() == 0
    base = "the quick brown fox jumps over it"
    rows = [(1, base), (2, base + "!"), (3, base.upper()), (4, base), (5, "x" * 50_000), (6, "x" * 49_999), (7, base + "!")]
    found = identity.ratio_pairs(spark.createDataFrame(rows, "ord long, front string").where("ord not in (5, 6)")).collect()
    assert [(r.ord_a, r.ord_b, r.n_a, r.n_b) for r in found] == [(1, 2, 3, 2)]


def test_common():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similar.common(a, b) == table[-1][-1]
        r = SequenceMatcher(None, a, b).ratio()
        assert similar.block_ratio(a, b) == (r if r > 0.9 else 0) or not a + b


def test_triples_are_ranked_where_they_are_made(spark):
    fronts = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "the quick brown fox jumps over it!")], "ord long, text string")
    plan = identity.ratio_candidates(fronts)._jdf.queryExecution().executedPlan().toString()
    ranked = plan[plan.index("Window") :]
    assert "hashpartitioning(ord" not in ranked[: ranked.index("Generate")]
    assert [tuple(r) for r in identity.ratio_candidates(fronts).collect()] == [(2, 1)]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_taken_once(spark):
    """What uses an item's ending takes its words once for each use of the table, also where it is filtered."""
    items = spark.createDataFrame([("c", 1, "1", r"One two three \hfill \textit{(A-1)}."), ("c", 2, "1", r"x \emph[opt]{one} TWO, three"), ("c", 3, "1", None), ("c", 4, "1", "two"), ("c", 5, "1", "Kelvin İs o'clock")], "collection string, ord long, los_id string, text string")
    clusters = identity.suffix_clusters(items, 2, 3)
    assert _plan(clusters).count("hfill") == 1
    assert [tuple(r) for r in clusters.collect()] == [("c", "one two three", 2)]
    assert [r[0] for r in items.orderBy("ord").select(tx.words("text")).collect()] == [["one", "two", "three"], ["one", "two", "three"], None, ["two"], ["kelvin", "clock"]]
    stated = spark.createDataFrame([("1", "one two three", 1)], "los_id string, statement string, ord long")
    found = identity.templated(items, stated, ("no such tail",), "ord", least=2, n=3)
    assert _plan(found).count("hfill") <= 4  # the items twice, the statements twice
    assert sorted(map(tuple, found.collect())) == [(1, "shared-suffix(x2),verbatim-los"), (2, "shared-suffix(x2),verbatim-los")]


def test_runs_are_met_without_copies_of_the_words(spark):
    """The words of each place are looked up one by one: a slice copies all words of a text for each of its places."""
    items = spark.createDataFrame([(1, "zero a1 a2 a3 a4 a5 a6 a7 a8 a9 end"), (2, "a1 a2 a3 a4 a5 a6 a7 a8"), (3, "short"), (4, None)], "ord long, text string")
    runs = spark.createDataFrame([(7, "A1 a2 a3 a4 a5 a6 a7 a8"), (8, "a2 a3 a4 a5 a6 a7 a8 a9 end"), (9, "a1 a2")], "run_id long, text string")
    found = identity.run_hits(items, runs)
    assert not [line for line in _plan(found).splitlines() if "posexplode" in line and "slice(" in line]
    assert sorted(map(tuple, found.collect())) == [(1, 7), (1, 8), (2, 7)]


def test_character_pairs_are_made_once(spark):
    """Each text's pairs are made once for a similarity, by one pass; a pair may hold any character."""
    d = spark.createDataFrame([("ab\n\U0001f600b\U0001f600b", "ab\n\U0001f600c"), ("", "ab"), ("a", "bc"), ("same", "same")], "a string, b string")
    out = d.select(tx.bigram_similarity("a", "b").alias("s"), F.sort_array(tx.bigrams("a")).alias("pairs"))
    assert _plan(out).count("(?=(..))") == 3
    rows = out.collect()
    assert [r["s"] for r in rows] == [3 / 6, 0.0, 0.0, 1.0]
    assert set(rows[0]["pairs"]) == {"ab", "b\n", "\n\U0001f600", "\U0001f600b", "b\U0001f600"}
