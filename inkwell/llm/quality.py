"""Operator 4: quality classifier.

Method: random Fourier features approximate a Gaussian kernel over document statistics; normal
equations, summed per partition and then over partitions, fit ridge scores; isotonic calibration
turns a score into a probability. The calibration is fitted on scores of rows that the scoring
model hasn't seen: the normal equations are summed for two folds apart, each fold is scored by the
other's model, and the final model has the sum of both.

All training rows count: only sums leave the executors, whose size doesn't depend on the rows.
Null or empty text: the statistics of an empty text, so it is scored too. Null label: not learned
from. Several labels of one doc_id: their mean. Null doc_id: scored, never learned from, held out.
No labels at all: every score is 0.5. Repeated rows: each is scored. Extra columns of the documents
are dropped, except those that scored() is asked to keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Random Fourier features; the normal equations have FEATURES + 1 unknowns.
FEATURES = 192
#: Gaussian kernel exp(-GAMMA * squared distance) over standardised statistics.
GAMMA = 0.03
RIDGE = 1e-3
#: Score bins in which the calibration is summed.
BINS = 512
SPAN = (-0.5, 1.5)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WIDE = np.zeros(256, bool)
_WIDE[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:'\"()-?")] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_PIPE = np.zeros(256, bool)
_PIPE[list(b"|\t")] = True
_BANG = np.zeros(256, bool)
_BANG[33] = True
_MARKUP = np.zeros(256, bool)
_MARKUP[list(b"<>{}[]\\/=+_@~^")] = True
_SYMBOL = common.PUNCT & ~(common.SPACE | _STOP | _PIPE | _BANG | _MARKUP)

CLASSES = (_UPPER, _LETTER, _DIGIT, _WIDE, common.SPACE, _LINE, _STOP, _PIPE, _BANG, _MARKUP, _SYMBOL)
#: What each column of the statistics is.
STATISTICS = (
    "log bytes", "log words", "log mean word length", "upper share of letters", "letter share", "digit share", "non-ASCII share",
    "space share", "line break share", "stop share", "pipe share", "exclamation share", "markup share", "symbol share",
    "distinct words", "commonest word", "distinct lines", "distinct shingles", "log mean line length",
)


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the number of different hashes, and how often the commonest occurs."""
    n = len(first) - 1
    if not len(h):
        return np.zeros(n), np.zeros(n)
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, owner[at], runs)
    return np.bincount(owner[at], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; data holds the texts one after the other from offsets[0] = 0."""
    size = np.diff(offsets).astype(float)
    counts = []
    for kind in CLASSES:
        total = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        counts.append((total[offsets[1:]] - total[offsets[:-1]]).astype(float))
    upper, letter, digit, wide, space, line, stop, pipe, bang, markup, symbol = counts
    some = np.maximum(size, 1)
    h, _, first = common.words(data, offsets, common.SPACE)
    words = np.diff(first).astype(float)
    different, most = _distinct(h, first)
    grams, of = common.shingles(h, first, 3)
    lines, _, begin = common.words(data, offsets, _LINE)
    n_lines = np.diff(begin).astype(float)
    columns = (
        np.log1p(size), np.log1p(words), np.log1p((size - space) / np.maximum(words, 1)), upper / np.maximum(letter, 1), letter / some, digit / some,
        wide / some, space / some, line / some, stop / some, pipe / some, bang / some, markup / some, symbol / some,
        different / np.maximum(words, 1), most / np.maximum(words, 1), _distinct(lines, begin)[0] / np.maximum(n_lines, 1),
        _distinct(grams, of)[0] / np.maximum(np.diff(of), 1), np.log1p(size / np.maximum(n_lines, 1)),
    )
    return np.stack(columns, 1)


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns keep, and stats: the statistics of each whole text."""
    fields = [f for f in docs.select(*keep).schema]
    schema = T.StructType([*fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("statistics")
        for batch in batches:
            data, at = common.buffers(batch.column(text))
            parts = [statistics(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in common.passes(at)]
            made = np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * len(STATISTICS), pa.int32()), pa.array(made.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), stats], names=[*keep, "stats"])

    return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


@dataclass
class Model:
    """Standardisation, random features, ridge weights and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(4)
        w = rng.normal(0, np.sqrt(2 * GAMMA), (stats.shape[1], FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -20, 20)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones(len(z))])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.clip(self.features(stats) @ (self.weights if weights is None else weights), *SPAN)

    def probability(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def ridge(gram: np.ndarray, moment: np.ndarray, n: float) -> np.ndarray:
    return np.linalg.solve(gram + RIDGE * max(n, 1) * np.eye(len(gram)) / FEATURES, moment)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the blocks' mean x and mean y. x ascending."""
    blocks: list[list[float]] = []
    for one in zip(x, y, weight, strict=True):
        blocks.append([one[0] * one[2], one[1] * one[2], one[2]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _sums(rows: DataFrame, model: Model) -> list:
    """Normal equations of each fold: summed in every partition, then in a few, then here."""
    size = FEATURES + 1
    schema = "fold int, n double, sums array<double>"

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            fold = np.asarray(batch.column("fold"))
            y = np.asarray(batch.column("label"), float)
            z = model.features(matrix(batch.column("stats"))) if len(fold) else np.empty((0, size))
            for k in np.unique(fold).tolist():
                own = z[fold == k]
                now = [float(len(own)), np.concatenate([(own.T @ own).ravel(), own.T @ y[fold == k]])]
                total[k] = [a + b for a, b in zip(total[k], now, strict=True)] if k in total else now
        yield from _packed(total)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for k, n, s in zip(batch.column("fold").to_pylist(), batch.column("n").to_pylist(), matrix(batch.column("sums")) if len(batch) else (), strict=True):
                total[k] = [total[k][0] + n, total[k][1] + s] if k in total else [n, s]
        yield from _packed(total)

    parts = rows.select("fold", "label", "stats").mapInArrow(part, schema)
    return parts.repartition(4).mapInArrow(join, schema).collect()


def _packed(total: dict[int, list]) -> Iterator[pa.RecordBatch]:
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()]), pa.array([v[1].tolist() for v in total.values()], pa.list_(pa.float64()))],
            names=["fold", "n", "sums"],
        )


def remainder(column: str = "doc_id", by: int = 3) -> F.Column:
    return (F.crc32(F.col(column).cast("string")) % by).cast("int")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """stats: doc_id and stats; labels: doc_id and label. Learns from all rows whose remainder isn't 1."""
    target = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("label"))
    rows = stats.join(target, "doc_id").withColumn("fold", remainder()).where("fold <> 1")
    rows = common.cut(rows.select("fold", "label", "stats"), "labelled", narrow=4)
    width = len(STATISTICS)
    wide = rows.select(*(F.col("stats")[i].alias(f"s{i}") for i in range(width)))
    first = wide.agg(*(F.avg(f"s{i}").alias(f"m{i}") for i in range(width)), *(F.stddev_pop(f"s{i}").alias(f"d{i}") for i in range(width))).first()
    if first["m0"] is None:
        return Model(np.zeros(width), np.ones(width))
    model = Model(np.array([first[f"m{i}"] for i in range(width)]), np.array([max(first[f"d{i}"], 1e-3) for i in range(width)]))
    size = FEATURES + 1
    folds: dict[int, list] = {}
    for row in _sums(rows, model):
        s = np.asarray(row["sums"])
        n, g, m = folds.get(row["fold"], (0.0, 0.0, 0.0))
        folds[row["fold"]] = (n + row["n"], g + s[: size * size].reshape(size, size), m + s[size * size :])
    solved = {k: ridge(g, m, n) for k, (n, g, m) in folds.items()}
    model.weights = ridge(sum(g for _, g, _ in folds.values()), sum(m for _, _, m in folds.values()), sum(n for n, _, _ in folds.values()))
    other = {k: next((solved[o] for o in solved if o != k), model.weights) for k in solved}

    @F.pandas_udf("double")
    def unseen(stats: pd.Series, fold: pd.Series) -> pd.Series:
        z = np.stack(stats.to_list()) if len(stats) else np.empty((0, width))
        out = np.zeros(len(z))
        for k in fold.unique():
            out[fold.to_numpy() == k] = model.raw(z[fold.to_numpy() == k], other[int(k)])
        return pd.Series(out)

    binned = rows.select(unseen("stats", "fold").alias("raw"), "label")
    binned = binned.withColumn("bin", F.floor((F.col("raw") - SPAN[0]) / (SPAN[1] - SPAN[0]) * BINS))
    sums = binned.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.knots = isotonic(*(np.array([r[k] for r in sums], float) for k in ("x", "y", "n")))
    return model


def scored(stats: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, and score: the calibrated probability of a good text."""
    schema = T.StructType([*stats.select(*keep).schema, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.probability(matrix(batch.column("stats"))) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(made, pa.float64())], names=[*keep, "score"])

    return stats.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a score of 0.5 or more, all columns kept; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.kept("statistics")
        for batch in batches:
            data, at = common.buffers(batch.column(text))
            parts = [model.probability(statistics(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])) for lo, hi in common.passes(at)]
            yield batch.filter(pa.array(np.concatenate(parts) >= 0.5 if parts else np.empty(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = common.cut(with_statistics(docs), "stats")
    out = scored(stats, fit(stats, labels))
    return out.select(
        "doc_id",
        F.coalesce(remainder() == 1, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
