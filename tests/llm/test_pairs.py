"""Near-duplicates, removed strings, benchmark overlaps and neighbours, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import common, components, decontaminate, jaccard_join, neighbours, strings, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3)


def corpus(seed: int, n: int = 120):
    """Copies, near copies, chains of near copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts, made = [], []
    for i in range(n):
        kind = rng.random()
        if made and kind < 0.5:
            words = list(rng.choice(made[-12:]))
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = word()
        elif kind < 0.6:
            words = [word() for _ in range(rng.randint(1, 6))]
        else:
            words = [word() for _ in range(rng.randint(20, 150))]
        if kind > 0.85:
            words[rng.randrange(len(words)) :] = passage
        made.append(words)
        texts.append((i * 3, rng.choice([" ", "\n", "  "]).join(words)))
    return [*texts, (9000, None), (9001, ""), (9002, " \n "), (9003, "A b"), (9004, "a B"), (9005, "a b c")]


def jaccard_brute(texts):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 2)  # so that the small corpus has common elements
    monkeypatch.setattr(jaccard_join, "SPLIT", 8)
    monkeypatch.setattr(jaccard_join, "DENSE", 3 if seed == 2 else 32)
    monkeypatch.setattr(jaccard_join, "BLOCK", 300)
    texts = corpus(seed)
    docs = table(spark, texts)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()}
    assert found == jaccard_brute(texts)


def test_jaccard_pair_of_different_needs(spark):
    """A pair at the threshold with needs 4 and 1, whose common list has a hub that links to neither."""
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    hot, warm, rare = words("hot", 86), words("warm", 86), words("rare", 12)
    node = lambda w: jaccard_join.set_id(next(jaccard_join.sets(pa.array([" ".join(w)]))))
    y = hot + words("y", 16) + rare
    x = next(x for x in (hot + words(f"x{k}w", 6) + rare for k in range(1000)) if node(x) < node(y))  # the smaller node asks
    hub = next(h for h in (rare + [f"hub{k}"] + warm for k in range(1000)) if node(h) < node(x))
    texts = [(1, x), (2, y), *((10 + i, hot + warm + words(f"other{i}w", 300)) for i in range(8))]
    texts = [(i, " ".join(w)) for i, w in [*texts, (3, hub)]]
    docs = table(spark, texts)
    order = jaccard_join.order_of(jaccard_join.census(docs.coalesce(1)))
    of_x, of_y, of_hub = (jaccard_join.prefix(u, order) for u in jaccard_join.sets(pa.array([texts[k][1] for k in (0, 1, -1)])))
    shared = set(of_x[0].tolist()) & set(of_y[0].tolist())
    assert (of_x[1], of_y[1], len(shared)) == (4, 1, 8) and shared <= set(of_hub[0].tolist())
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs.coalesce(1)).collect()}
    assert found == jaccard_brute(texts) and found[2][1] == 1


def test_jaccard_asks_no_more_than_any_pair(spark):
    """What a node has to share with a component is what the least demanding pair needs."""
    pairs = spark.range(1, 90).selectExpr("id as n").crossJoin(spark.range(1, 5).selectExpr("id as need")).crossJoin(spark.range(1, 5).selectExpr("id as least"))
    sizes = pairs.crossJoin(spark.range(1, 121).selectExpr("id as m")).where("m * 100 >= n * 75 and n * 100 >= m * 75")
    x, y = F.struct("n", "need").alias("x"), F.struct(F.col("m").alias("n"), F.col("least").alias("need")).alias("y")
    exact = sizes.select("n", "need", "least", x, y).withColumn("asks", jaccard_join._least("x", "y", "least(x.need, y.need)")).groupBy("n", "need", "least").agg(F.min("asks").alias("exact"))
    c = F.struct(F.lit(1).alias("low"), F.lit(120).alias("high"), "least").alias("c")
    found = pairs.select("n", "need", "least", F.struct("n", "need").alias("x"), c).withColumn("found", F.expr(jaccard_join._asks()[2]))
    assert [tuple(r) for r in found.join(exact, ["n", "need", "least"]).where("found <> exact").select("n", "need", "least", "found", "exact").collect()] == []


def test_jaccard_edges(spark):
    same = "one two three four five six seven"
    rows = [(None, same, "en", "s", 1), (7, same, "en", "s", 1), (7, same, "en", "s", 1), (8, None, "en", "s", 1), (None, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "node").withColumnRenamed("lang", "component_id")
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()), key=str)
    assert found == sorted([(None, 3, 7), (7, 3, 7), (7, 3, 7), (8, 0, 8), (None, 0, None)], key=str)
    assert jaccard_join.join(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in jaccard_join.keep_one(docs).collect()) == [0, 0, 7, 7, 8]


def test_prefix_rule():
    order = jaccard_join.Order(np.arange(0, 50, 2, dtype=np.uint64), np.full(25, 40))
    u = np.arange(100, dtype=np.uint64)
    prefix, m = jaccard_join.prefix(u, order)
    assert m > 1 or not set(prefix.tolist()) & set(order.element.tolist())
    assert len(prefix) == 100 - jaccard_join.least_overlap(100) + m
    assert jaccard_join.least_overlap(1) == 1 and jaccard_join.least_overlap(4) == 3 and jaccard_join.least_overlap(5) == 4


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (100, 102), (7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long").repartition(4)
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
    assert components.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_removed_strings(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", 400)
    texts = corpus(seed, 60) + [(9100, "Und " * 400), (9101, "x" + "Und " * 100), (9102, "é" * 49), (9103, "y" + "é" * 49), (9104, "z" * 3000), (9105, "q" + "z" * 70)]
    docs = table(spark, texts)
    found = {r["doc_id"]: tuple(r[1:]) for r in suffix_dedup.remove(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()}
    assert found == suffix_dedup.brute_force(dict(texts))


def test_removed_strings_edges(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(None, long, "en", "s", 1), (5, long, "en", "s", 1), (5, long + "!", "en", "s", 1), (5, long, "en", "s", 1), (6, long, "en", "s", 1), (7, None, "en", "s", 1), (8, long[:49], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "doc").withColumnRenamed("lang", "places")
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove(docs).collect()), key=str)
    assert found == sorted([(None, 300, 0, 0), (5, 300, 0, 0), (5, 301, 0, 0), (5, 300, 0, 0), (6, 300, 300, 1), (7, 0, 0, 0), (8, 49, 0, 0)], key=str)
    assert suffix_dedup.remove(docs.limit(0)).count() == 0


@pytest.mark.parametrize("letters", [2, 5, 256])
def test_deep_shallow_sorting(letters):
    rng = np.random.default_rng(letters)
    base = rng.integers(0, letters, (400, 50)).astype(np.uint8)
    base[100:200] = base[:100]
    base[200:300, :40] = base[:100, :40]
    order, shared = strings.deep_shallow(base)
    rows = [base[i].tobytes() for i in order]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(400))
    for a, b, n in zip(rows, rows[1:], shared[1:].tolist(), strict=False):
        assert a[:n] == b[:n] and (n == 50 or a[n] != b[n])


def test_benchmark_overlaps(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([30, 13, 12, 10, 9, 8, 6, 3])}
    texts, expected = [], set()
    for i, tokens in items.items():
        size, least = decontaminate.needed(len(tokens))
        for k in range(6):
            part = list(tokens)
            for at in rng.sample(range(len(part)), size - least) if k < 4 else rng.sample(range(size), size - least + 1):
                part[at] = word()
            own = " ".join([*(word() for _ in range(20)), *part[: size if k >= 4 else len(part)], *(word() for _ in range(20))])
            doc = 10 * i + k
            texts.append((doc, own.upper() if k == 1 else own.replace(" ", ", ") if k == 2 else own))
            if k < 4 and (len(tokens) < 30 or _brute(own, tokens)):
                expected.add((doc, i))
    texts += [(900, None), (901, ""), (902, " ".join(word() for _ in range(500)))]
    bench = spark.createDataFrame([*((i, " ".join(t)) for i, t in items.items()), (50, None), (51, ""), (None, "a b c"), (52, "...")], "item_id long, text string")
    docs = table(spark, texts)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == expected == {(d, i) for d, t in texts for i, tokens in items.items() if _brute(t or "", tokens)}
    kept = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in expected}
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


def _brute(text, tokens):
    size, least = decontaminate.needed(len(tokens))
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return any(
        sum(x == y for x, y in zip(words[a : a + size], tokens[b : b + size], strict=True)) >= least
        for a in range(len(words) - size + 1)
        for b in range(len(tokens) - size + 1)
    )


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 40)
    words = [f"w{i}" for i in range(130)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "p q r s t u v w x y")], "item_id long, text string")
    docs = table(spark, [(i, "zz " + " ".join(words[i : i + 13]) + " yy") for i in range(0, 118)] + [(500, "p q r s t u v w x y")])
    assert len(list(decontaminate.blocks(bench))) > 3
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, bench).collect()} == {(i, 1) for i in range(118)} | {(500, 2)}


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "TOGETHER", 10)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12)) * rng.uniform(0.5, 3, (600, 1))
    x[300:420] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1020, [0.0] * 12, 1), (1040, [float("nan")] + [1.0] * 11, 1), (1060, [1.0, None] + [1.0] * 10, 1), (1080, [1.0] * 5, 1), (None, [1.0] * 12, 1), (1100, [], 1)]
    table_ = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int").repartition(4)
    found = {}
    for r in neighbours.neighbours(table_).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 600, 20))
    hits = 0
    for q, got in found.items():
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        got = sorted(got)
        assert [g[0] for g in got] == list(range(1, 21)) and q not in [g[1] for g in got]
        assert [g[2] for g in got] == pytest.approx([score[g[1]] for g in got])
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got, got[1:], strict=False))
        hits += len(set(order) & {g[1] for g in got})
    assert hits >= 0.9 * 20 * len(found)
    few = neighbours.neighbours(table_.where("vec_id < 5"))
    assert few.count() == 4 and neighbours.neighbours(table_.limit(0)).count() == 0


def test_chi_square_quantile():
    assert neighbours.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert neighbours.chi_square_quantile(0.99, 10) == pytest.approx(23.209, abs=1e-3)


def test_neighbours_skip_leaves_of_far_clusters(spark, monkeypatch):
    """Clusters with neighbours nearer than other clusters: most leaves aren't looked at, and nothing is lost. Two lengths are searched apart."""
    monkeypatch.setattr(neighbours, "LEAF", 50)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(60, 24)), 40, axis=0) + 0.02 * rng.normal(size=(2400, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    other = rng.normal(size=(30, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, v.tolist()) for i, v in enumerate(other)]
    asked = []
    cut = common.cut

    def counting(df, name="step", **more):
        made = cut(df, name, **more)
        if name == "probes":
            asked.append(made.count())
        return made

    monkeypatch.setattr(common, "cut", counting)
    found = {}
    for r in neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(asked) < 0.5 * 120 * 48
    hits = 0
    for q in range(0, 2400, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * 120
    assert found[5000] <= {5000 + i for i in range(1, 30)} and len(found[5000]) == 20


def test_jaccard_lists_part_sizes_that_cannot_link(spark):
    """One element in sets of 20, 25, 33, 60, 61 and 200: what is alone with its size goes, hubs stay within a part, and a split list stays whole."""
    sizes = np.array([20, 61, 200, 25, 60, 33], np.uint32)
    nodes, tokens = np.array([5, 1, 0, 4, 2, 3], np.int64), np.full(6, 9, np.uint64)
    row = (0, tokens.tobytes(), nodes.tobytes(), sizes.tobytes(), np.ones(6, np.uint8).tobytes(), np.ones(6, np.uint32).tobytes())
    packed = spark.createDataFrame([row, row], jaccard_join._ENTRIES)
    plain = jaccard_join.Order(np.empty(0, np.uint64), np.empty(0, np.int64))
    found = jaccard_join.shared(packed, plain, 2).collect()
    assert sorted((r["n"], r["node"], r["hub"], r["size"]) for r in found) == [(20, 5, 3, 3), (25, 4, 3, 3), (33, 3, 3, 3), (60, 2, 1, 2), (61, 1, 1, 2)]
    assert len({r["token"] for r in found if r["n"] < 40}) == len({r["token"] for r in found if r["n"] > 40}) == 1 and len({r["token"] for r in found}) == 2
    common_ = jaccard_join.Order(np.array([9], np.uint64), np.array([jaccard_join.SPLIT]))
    whole = jaccard_join.shared(packed, common_, 2).collect()
    assert {(r["token"], r["hub"]) for r in whole} == {(9, 0)} and len(whole) == 6


def test_signs_bound_the_intersection():
    rng = np.random.default_rng(3)
    for n, m, both in ((1, 1, 1), (1, 2, 0), (7, 9, 6), (40, 33, 31), (600, 500, 480), (600, 500, 0), (1025, 1024, 1000), (3000, 2300, 2250)):
        u = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        x, y = np.sort(u[:n]), np.sort(np.concatenate([u[:both], u[n : n + m - both]]))
        most = jaccard_join.most_shared(jaccard_join.sign(x), jaccard_join.sign(y), n, m)
        assert both <= most == jaccard_join.most_shared(jaccard_join.sign(y), jaccard_join.sign(x), m, n)
        if n > 500 and not both:
            assert most * 100 < (n + m - most) * 75


def test_chance_meetings_cost_no_sets(spark, monkeypatch):
    """Texts that share one shingle, all of it in their prefixes, are told apart without their sets."""
    asked = []
    sets_of = jaccard_join.sets_of
    monkeypatch.setattr(jaccard_join, "sets_of", lambda docs, wanted: asked.append(wanted.count()) or sets_of(docs, wanted))
    rows = [(k, " ".join([*(f"w{k}x{j}" for j in range(60)), *(f"s{k // 5}y{j}" for j in range(5)), *(f"t{k % 5}z{j}" for j in range(5))])) for k in range(25)]
    rows += [(100, rows[0][1] + " more"), (101, rows[7][1] + " end")]
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: k for k in range(25)} | {100: 0, 101: 7}
    assert max(asked) <= 4
