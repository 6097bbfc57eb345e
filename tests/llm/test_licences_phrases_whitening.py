"""Licence scans, collocations and whitening against plain versions."""

import os
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import collocations, license_scan, whitening

SF = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# licences


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({label for _, label in found}))


SCANNER = license_scan.Scanner()
WORDS = ["GNU", "general public license", "Public", "License", "apache", "MIT license", "cc", "by", "cc-by", "é", " ", "\n", ".", "licensed under", "license:", "spdx-license-identifier:", "(", ")", "and", "or", "with", "mit", " ", "9"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=30), st.sampled_from([" ", "", "-"]))
def test_base_of_licences_is_the_plain_rule(parts, between):
    text = between.join(parts)
    row = SCANNER.scan(text)
    assert row[:5] == plain_base(text) and set(filter(None, row[4].split(","))) <= set(filter(None, row[5].split(","))) and 0 <= row[8] <= 1


EXPRESSIONS = [
    ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT) AND Apache-2.0", "apache,gpl,mit", ["(gpl-2.0-or-later with classpath-exception-2.0 or mit) and apache-2.0"], True),
    ("SPDX-License-Identifier: MIT AND BSD-3-Clause OR GPL-3.0", "bsd,gpl,mit", ["mit and bsd-3-clause or gpl-3.0"], True),
    ("SPDX-License-Identifier: GPL-3.0 AND (MIT OR ISC)\nmit", "gpl,isc,mit", ["gpl-3.0 and (mit or isc)"], False),
    ("SPDX-License-Identifier: ((MIT))", "mit", ["mit"], True),
    ("SPDX-License-Identifier: Foo-1.0", "other", ["foo-1.0"], False),
    ("SPDX-License-Identifier: MIT OR (GPL-2.0", "gpl,mit", [], False),
    ("SPDX-License-Identifier: MIT WITH", "mit", [], False),
    ("SPDX-License-Identifier: AND MIT", "", [], False),
    ('"license": "MIT OR Apache-2.0",', "apache,mit", ["mit or apache-2.0"], True),
    ("Licensed under the Apache License, Version 2.0 or the MIT license", "apache,mit", ["apache or mit"], True),
    ("licensed under the sun and the moon; my license expired", "", [], False),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", ["cc-by-nc"], False),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd", [], False),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit", [], False),
]


@pytest.mark.parametrize(("text", "labels", "expressions", "permissive"), EXPRESSIONS)
def test_licence_expressions(text, labels, expressions, permissive):
    row = SCANNER.scan(text)
    assert (row[5], row[6], row[7]) == (labels, expressions, permissive)


def trees(depth):
    leaf = st.sampled_from(["mit", "isc", "gpl-2.0"])
    return st.recursive(leaf, lambda inner: st.tuples(st.sampled_from(["and", "or"]), inner, inner), max_leaves=depth)


@settings(max_examples=200, deadline=None)
@given(trees(12))
def test_a_written_expression_reads_back(tree):
    def met(t):
        if isinstance(t, str):
            return t != "gpl-2.0"
        return met(t[1]) and met(t[2]) if t[0] == "and" else met(t[1]) or met(t[2])

    text = license_scan.written(tree)
    one = license_scan.Expression(False)
    assert one.read(text.encode(), 0, len(text)) == len(text)
    again = one.value()
    assert again[1] == met(tree)
    two = license_scan.Expression(False)
    two.read(again[0].encode(), 0, len(again[0]))
    assert two.value() == again


def test_long_licence_texts():
    for text in ("license: mit and " * 60_000, "licensed under " * 70_000, "spdx-license-identifier: " + "(" * 500_000, "spdx-license-identifier: " + "((mit or isc) and " * 40_000 + "mit" + ")" * 40_000):
        began = time.time()
        SCANNER.scan(text)
        assert time.time() - began < 30


def test_licence_table(spark):
    rows = [(1, "MIT license", "x", 1), (2, None, None, 2), (3, "", "x", 3), (3, "", "x", 3), (None, "a cc by b", "x", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_base long")
    found = license_scan.scan(d).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in found) == [(0, 4, 1, "cc-by"), (1, 2, 1, "mit"), (2, 0, 0, ""), (3, 0, 0, ""), (3, 0, 0, "")]
    assert license_scan.scan(d.limit(0)).count() == 0


# collocations


def plain_counts(rows, longest):
    counts, totals = {}, Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[i : i + k])] += 1
    return counts, totals


def plain_collocations(rows, least, longest, top):
    counts, totals = plain_counts(rows, longest)
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in good.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 80 * a for q, b in good.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def test_collocations_against_the_plain_rule(spark):
    rng = np.random.default_rng(4)
    words = np.array(["the", "The", "of", "New", "york", "city", "é", "a,", "b.", "c\n", "x\ty", " ", "end!", "big-data"])
    rows = [(" ".join(rng.choice(words, rng.integers(0, 60))), [None, "en", "und", "fr"][int(rng.integers(4))]) for _ in range(120)]
    rows += [(None, "en"), ("", "en"), ("new york city " * 3000, "fr"), ("w " * 70, "de"), ("new york city " * 3000, "fr")]
    d = spark.createDataFrame([(t, lang, i) for i, (t, lang) in enumerate(rows)], "text string, lang string, words long").repartition(3)
    found = sorted(tuple(r) for r in collocations.collocations(d, least=5, top=40).collect())
    assert found == plain_collocations(rows, 5, 4, 40) and len(found) > 60
    assert collocations.collocations(d.limit(0), least=5).count() == 0


def test_shards_and_batches_lose_nothing(monkeypatch):
    monkeypatch.setattr(collocations, "BYTES", 200)
    monkeypatch.setattr(collocations, "BATCH", 16)
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "bb", "c.", "Dd", "é"], n)) for n in (0, 3, 50, 400, 7)] + ["q " * 300, ". ,", "long" * 90 + " x"]
    shard, made = collocations.Shard("en"), []
    for t in texts:
        made += shard.add(t.encode())
    made += shard.row()
    assert len(made) > 5
    total = Counter()
    for row in made:
        bitmaps = collocations.Bitmaps(row["chunk"], row["word"], row["bits"])
        names = [w.as_py() for w in row["words"]]
        total.update({(w,): int(n) for w, n in zip(names, row["counts"], strict=True)})
        for phrases, counts in collocations.mined(bitmaps, len(names), 4, None):
            for p, n in zip(phrases, counts, strict=True):
                total[tuple(names[i] for i in p)] += int(n)
    assert total == plain_counts([(t, "en") for t in texts], 4)[0]["en"]


# whitening


def test_residues_give_exact_integers():
    primes = whitening.primes_beyond(10**30)
    assert all(all(p % q for q in range(2, int(p**0.5) + 1)) for p in primes) and max(primes) < 1 << whitening.PRIME_BITS
    values = np.array([[0, 10**30, -(10**30)], [7, -1, 12345678901234567890]], object)
    assert (whitening.remaindered({p: values % p for p in primes}) == values).all()


def whitened_by_numpy(vectors):
    x = np.array([np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000 for v in vectors])
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(0)
    centred = once - sums / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    deviation = [(n * row.astype(object) - sums.astype(object)) @ (n * row.astype(object) - sums.astype(object)) for row in x]
    return n, deviation, (x - sums / n) @ columns[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / values.sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32).tolist()
    vectors += vectors[:40] * 3
    odd = [None, [1.0] * 19 + [None], [float("nan")] * 20, [float("inf")] + [0.0] * 19, [], [0.0] * 20]
    rows = [(i, v, 9) for i, v in enumerate(vectors + odd)] + [(None, [5.0] * 20, 9), (7000, [1.0, 2.0], 9), (7001, [1.5, 2.0], 9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int").repartition(3)
    found = whitening.whiten(d).toPandas()
    usable = vectors + [[0.0] * 20, [5.0] * 20]
    n, deviation, z, explained = whitened_by_numpy(usable)
    long = found[found.vec_id.isna() | (found.vec_id < 7000)]
    assert len(long) == 16 * len(usable) and set(long.n) == {n} and long.identity_error.max() < 1e-9
    by = {(-1 if np.isnan(r.vec_id) else int(r.vec_id), r.component): r for r in long.itertuples()}
    places = [*range(len(vectors)), len(vectors) + 5, -1]
    for j, place in enumerate(places):
        assert int(by[place, 1].deviation) == deviation[j]
    got = np.array([[by[p, c].whitened for c in range(1, 17)] for p in places])
    sign = np.sign((got * z[:, :16]).sum(0))
    assert np.abs(got * sign - z[:, :16]).max() < 1e-8
    assert np.allclose([by[0, c].explained for c in range(1, 17)], explained[:16], rtol=1e-9)
    pair = found[found.vec_id >= 7000].sort_values(["vec_id", "component"])  # two vectors: one component that varies
    assert list(pair.n) == [2] * 4 and np.allclose(pair[pair.component == 1].whitened.abs(), 1) and pair[pair.component == 2].whitened.isna().all()
    assert whitening.whiten(d.limit(0)).count() == 0


def test_whitening_of_far_values(spark):
    """Large values: exact sums beyond 64 bits, and deviations that no long holds."""
    vectors = [[1e9, -3.5e8], [2e9, 1.0], [-1e9, 77.25], [1e30, 0.0]]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {(r.vec_id, r.component): r for r in whitening.whiten(d).collect()}
    x = [[min(int(np.floor(64 * c)), 1 << 62) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for i, v in enumerate(x):
        exact = sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert found[i, 1].deviation is None if exact >= 10**38 else int(found[i, 1].deviation) == exact


@HERE
def test_whitening_query(spark):
    found = whitening.query(spark, SF)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    assert found.where("identity_error > 1e-4 or whitened is null").count() == 0


def test_collocations_broadcast_nothing_that_grows(spark):
    """Files of words and phrases are compressed, so what is small on disk isn't in the driver: such joins are merges whatever the limit."""
    found = spark.createDataFrame([("en", "a b", 40), ("en", "a", 50), ("en", "b", 60)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 110)], "lang string, n long")
    ids = spark.createDataFrame([(1, 2, 40)], "w1 long, w2 long, f long")
    words = spark.createDataFrame([("en", "a", 50, 1), ("en", "b", 60, 2)], "lang string, phrase string, f long, id long")
    spelt = collocations.spelt(ids, words, ["w1", "w2"])
    rows = collocations.scored(found, totals)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (spelt, rows)]
    assert plans[0].count("BroadcastHashJoin") == 0 and plans[1].count("BroadcastHashJoin") <= 1  # the totals of the languages
    assert [tuple(r) for r in spelt.collect()] == [("en", "a b", 40)]
    assert [(r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows.collect()] == [("a b", 40, 50, 60, 110, 727272)]


def test_pairs_come_to_their_shards_as_rows(spark):
    """No list of a shard's pairs is gathered; a shard without any has no longer phrases."""
    docs = spark.createDataFrame([("en", "a b c d. " * 3 + "x y"), ("fr", "only pairs. only pairs. only pairs")], "lang string, text string")
    table = collocations.shards(docs.coalesce(1)).localCheckpoint()
    rest = collocations.pruned(table, collocations.local_words(table, 3)).localCheckpoint()
    pairs = collocations.local_pairs(collocations.counted(rest), 3).localCheckpoint()
    longer = collocations.counted_longer(rest, pairs, 4)
    plan = longer._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "CoGroup" in plan
    assert sorted((r["w4"] >= 0, r["f"]) for r in longer.collect()) == [(False, 3), (False, 3), (True, 3)]
    alone = collocations.counted_longer(rest, pairs.limit(0), 4)
    assert alone.collect() == [] and alone.columns == ["w1", "w2", "w3", "w4", "shard", "f"]
