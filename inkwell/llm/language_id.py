"""Operator 6: language identification.

Method: hierarchical discrimination. Linear support vector machines, one against the rest, predict
the language family; within it, one-versus-one linear support vector machines vote on the language.
Features: counts of hashed letter trigrams of the whole text, log-scaled, of unit length.

The machines are fitted on the driver on a bounded sample: at most PER_LANGUAGE documents of each
language and SAMPLE in all, those with the smallest hash of their doc_id. Every document is scored.

Null text, or one without a letter: lang_pred is und, score 0. Null lang or null doc_id: never
learned from. Null doc_id: predicted, held out. No labelled documents: und for all, score 0. Only
one language: that one. Equal votes: the larger sum of margins, then the name. Repeated rows: each
is predicted. Extra columns are dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

PER_LANGUAGE = 600
SAMPLE = 9_600
BUCKETS = 4096
UNDETERMINED = "und"

#: Families of languages by code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "hellenic": "el",
    "finno-ugric": "et fi hu",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "austronesian": "ceb fil id jv mg mi ms sm su tl",
    "bantu": "ln rw sn st sw tn xh zu",
    "sinitic": "yue zh",
}

_FOLD = np.full(256, 32, np.uint64)
for _b in [*range(97, 123), *range(128, 256)]:
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def family(lang: str) -> str:
    """The family of a language code such as de or de-AT."""
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"={lang}")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of log counts of hashed trigrams, one row per text."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS), np.float32)
    x = _FOLD[data]
    gram = (x[:-2] << np.uint64(16)) | (x[1:-1] << np.uint64(8)) | x[2:]
    bucket = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    counts = np.bincount(owner[:-2][inside] * BUCKETS + bucket[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    counts[:, ((0x202020 * 0x9E3779B97F4A7C15) % (1 << 64)) >> 52] = 0
    z = np.log1p(counts, dtype=np.float32)
    length = np.sqrt((z * z).sum(1, keepdims=True))
    return z / np.where(length > 0, length, 1)


def machine(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 15) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    alpha = np.zeros(len(x))
    q = (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(6)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c) / q[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


class Model:
    """Families and the machines between them and within each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        own = np.array(langs, object)
        of = np.array([family(v) for v in langs], object)
        self.families = sorted(set(of))
        self.members = {f: sorted(set(own[of == f])) for f in self.families}
        rows = [machine(x, np.where(of == f, 1.0, -1.0)) for f in self.families] if len(self.families) > 1 else [np.zeros(BUCKETS + 1)]
        self.first = np.array(rows, np.float32) if self.families else np.zeros((0, BUCKETS + 1), np.float32)
        self.pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray]] = {}
        for f in self.families:
            pairs = list(itertools.combinations(range(len(self.members[f])), 2))
            ws = []
            for a, b in pairs:
                la, lb = self.members[f][a], self.members[f][b]
                keep = (own == la) | (own == lb)
                ws.append(machine(x[keep], np.where(own[keep] == la, 1.0, -1.0)))
            self.pairs[f] = (pairs, np.array(ws, np.float32).reshape(len(pairs), BUCKETS + 1))

    def predict(self, z: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row: the family's probability-like margin times the winner's mean one."""
        z = np.column_stack([z, np.ones(len(z), np.float32)])
        top = z @ self.first.T
        chosen = top.argmax(1)
        if len(self.families) > 1:
            ordered = np.sort(top, 1)
            sure = 1 / (1 + np.exp(-2 * np.clip(ordered[:, -1] - ordered[:, -2], 0, 20)))
        else:
            sure = np.ones(len(z))
        langs: list[str] = [""] * len(z)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            names = self.members[f]
            pairs, ws = self.pairs[f]
            votes, margins = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for m, (a, b) in zip((z[rows] @ ws.T).T if pairs else (), pairs, strict=True):
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                margins[:, a] += m
                margins[:, b] -= m
            best = (votes + 0.5 * np.tanh(margins / max(1, len(names)))).argmax(1) if len(rows) else []
            for i, (r, b) in enumerate(zip(rows, best, strict=True)):
                langs[r] = names[b]
                if len(names) > 1:
                    sure[r] *= 1 / (1 + np.exp(-2 * margins[i, b] / (len(names) - 1)))
        return langs, np.clip(sure, 0, 1)


def has_letter(text: str | None) -> bool:
    return any(ch.isalpha() for ch in text or "")


def _sample(docs: DataFrame) -> DataFrame:
    """The training rows' doc_id and lang: within the bounds, by hash of doc_id.

    A first cut by hash leaves about twice the rows wanted of each language, so that ranking them
    isn't slowed by a language that most documents have.
    """
    usable = docs.where("lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("doc_id", "lang")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(SAMPLE)
    n = max(1, sizes.count())
    each = max(1, min(PER_LANGUAGE, SAMPLE // n))
    hashed = usable.join(F.broadcast(sizes), "lang").withColumn("hash", F.xxhash64("doc_id"))
    near = hashed.where(F.pmod("hash", F.lit(1 << 40)) < F.lit(float(1 << 41)) * (each + 30) / F.col("size"))
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 40)), "doc_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("doc_id", "lang")


def fit(docs: DataFrame) -> Model | None:
    """The machines of this corpus; None without any labelled text."""
    # a sample of at most SAMPLE rows, or one a language
    chosen = docs.select("doc_id", "lang", "text").join(F.broadcast(_sample(docs).distinct()), ["doc_id", "lang"])
    schema = "doc_id long, lang string, at binary, value binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = common.buffers(batch.column("text"))
            places, values = [], []
            for lo, hi in common.passes(at, rows=256):
                for z in features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]):
                    some = np.flatnonzero(z)
                    places.append(some.astype(np.uint16).tobytes())
                    values.append(z[some].tobytes())
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("lang"), pa.array(places, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "at", "value"])

    rows = sorted(chosen.mapInArrow(run, schema).collect(), key=lambda r: (r["lang"], r["doc_id"], r["value"]))
    rows = [r for r in rows if r["at"]]
    if not rows:
        return None
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for z, r in zip(x, rows, strict=True):
        z[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    return Model(x, [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            data, at = common.buffers(column)
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for lo, hi in common.passes(at, rows=256):
                part, begin = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                if model is None:
                    langs += [UNDETERMINED] * (hi - lo)
                    scores.append(np.zeros(hi - lo))
                    continue
                found, score = model.predict(features(part, begin))
                letters = np.concatenate(([0], np.cumsum(_IS_LETTER[part], dtype=np.int64)))
                for i in np.flatnonzero(letters[begin[1:]] == letters[begin[:-1]]):
                    if not has_letter(column[lo + int(i)].as_py()):
                        found[i], score[i] = UNDETERMINED, 0.0
                langs += found
                scores.append(score)
            made = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(made, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
