"""Operator 2: benchmark decontamination.

Method: spaced-seed hashing. Fixed masks choose five of up to eight neighbouring tokens and ignore
the others; the hashes of the test items' seeds are looked up among the documents' seeds, and around
every hit the overlap is verified token by token along its diagonal, which tolerates substitutions.

A document overlaps an item if WINDOW neighbouring tokens of the item (all of them, if it has fewer)
stand in the document in order with at least SHARE of them equal. The three masks find every such
overlap, up to the number of substitutions that SHARE allows, for items of 8 and more tokens; an
item of fewer has to occur whole and exactly. Tokens are runs of letters, digits and non-ASCII
bytes, A-Z in lower case, so punctuation and white space don't matter.

The test items go to the executors in blocks of at most BLOCK_TOKENS tokens, one pass over the
documents each; so nothing unbounded is broadcast however large the benchmark is.

Null or empty document: no overlap. Null, empty or tokenless item: takes no part. Repeated items or
documents: each pair of rows is found; overlaps() gives one row per distinct pair of ids. Very long
texts are searched whole. Extra columns are dropped by overlaps() and kept by clean().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Token positions that count; chosen so that no placing of the allowed substitutions escapes all three.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7), (0, 1, 2, 3, 4))
WINDOW = 13
SHARE = 0.8
SHORTEST = 8
BLOCK_TOKENS = 200_000
_BITS = 22


def needed(tokens: int) -> tuple[int, int]:
    """Length of an item's window and how many of its tokens have to be equal."""
    size = min(tokens, WINDOW)
    return size, size if tokens < SHORTEST else int(np.ceil(SHARE * size - 1e-9))


class Seeds:
    """Seed hashes of one block of items, and the items' tokens for the verification."""

    def __init__(self, ids: list[int], tokens: list[np.ndarray]):
        self.ids, self.tokens = ids, tokens
        short = sorted({len(t) for t in tokens if 0 < len(t) < SHORTEST})
        self.masks = [*MASKS, *(tuple(range(n)) for n in short)]
        self.tables = []
        for k, mask in enumerate(self.masks):
            own = [i for i, t in enumerate(tokens) if (len(t) >= SHORTEST if k < len(MASKS) else len(t) == len(mask))]
            h = [self.hashes(tokens[i], mask) for i in own]
            item = np.repeat(np.array(own, np.int64), [len(x) for x in h]) if own else np.empty(0, np.int64)
            at = np.concatenate([np.arange(len(x)) for x in h]) if own else np.empty(0, np.int64)
            value = np.concatenate(h) if own else np.empty(0, np.uint64)
            order = np.argsort(value, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[value >> np.uint64(64 - _BITS)] = True
            self.tables.append((mask, value[order], item[order], at[order], seen))

    @staticmethod
    def hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        """Hash of the masked tokens at every place where the mask fits."""
        n = len(h) - mask[-1]
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j, p in enumerate(mask):
            out += h[p : p + n] * common._PLACE[j]
        return out

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of the text, item, token of the item) of every equal seed."""
        found = [(np.empty(0, np.int64),) * 3]
        for mask, value, item, at, seen in self.tables:
            own = self.hashes(h, mask)
            maybe = np.flatnonzero(seen[own >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(value, own[maybe], "left"), np.searchsorted(value, own[maybe], "right")
            n = hi - lo
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append((np.repeat(maybe, n), item[which], at[which]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def verified(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item's number, first token, tokens covered, tokens equal) of every verified diagonal."""
        place, item, at = self.hits(h)
        if not len(place):
            return
        owner = np.searchsorted(first, place, "right") - 1
        for o, i, shift in np.unique(np.stack([owner, item, place - at], 1), axis=0).tolist():
            tokens = self.tokens[i]
            lo, hi = max(shift, first[o]), min(shift + len(tokens), first[o + 1])
            size, least = needed(len(tokens))
            if hi - lo < size:
                continue
            same = h[lo:hi] == tokens[lo - shift : hi - shift]
            total = np.concatenate(([0], np.cumsum(same)))
            good = np.flatnonzero(total[size:] - total[:-size] >= least)
            if len(good):
                cover = np.zeros(hi - lo + 1, np.int64)
                np.add.at(cover, good, 1)
                np.add.at(cover, good + size, -1)
                cover = np.cumsum(cover)[:-1] > 0
                yield o, i, int(lo - first[o] + good[0]), int(cover.sum()), int((same & cover).sum())


def _tokens(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    h, _, first = common.words(np.frombuffer(b"".join(raw), np.uint8), at, common.PUNCT)
    return [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def blocks(items: DataFrame) -> Iterator[Seeds]:
    """The items in blocks of bounded size; read through an iterator, so that the driver holds one block."""
    ids: list[int] = []
    tokens: list[np.ndarray] = []
    held = 0
    for row in items.where("item_id is not null").select("item_id", "text").toLocalIterator():
        own = _tokens([row["text"]])[0]
        if not len(own):
            continue
        # a longer item than a block is taken in parts that overlap by a window
        for lo in range(0, max(1, len(own) - WINDOW + 1), BLOCK_TOKENS - WINDOW + 1):
            part = own[lo : lo + BLOCK_TOKENS]
            if held and held + len(part) > BLOCK_TOKENS:
                yield Seeds(ids, tokens)
                ids, tokens, held = [], [], 0
            ids.append(row["item_id"])
            tokens.append(part)
            held += len(part)
    if ids:
        yield Seeds(ids, tokens)


SCHEMA = "doc_id long, item_id long, first_token long, n_tokens long, n_equal long"


def _pass(docs: DataFrame, seeds: Seeds) -> DataFrame:
    ids, tokens, name = seeds.ids, seeds.tokens, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = common.kept(("seeds", name), lambda: Seeds(ids, tokens))
        for batch in batches:
            data, at = common.buffers(batch.column("text"))
            doc = batch.column("doc_id")
            rows = []
            for lo, hi in common.passes(at):
                h, _, first = common.words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], common.PUNCT)
                rows += [(doc[lo + o].as_py(), own.ids[i], start, n, same) for o, i, start, n, same in own.verified(h, first)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "first_token", "n_tokens", "n_equal"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, the longest overlap's first token, its tokens and how many are equal."""
    found = None
    for seeds in blocks(items):
        one = _pass(docs, seeds)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], SCHEMA)
    longest = F.max(F.struct("n_tokens", "n_equal", (-F.col("first_token")).alias("less"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(longest).select("doc_id", "item_id", (-F.col("m.less")).alias("first_token"), "m.n_tokens", "m.n_equal")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that overlap no item, all columns kept: one narrow pass for each block of items."""
    for seeds in blocks(items):
        docs = _without(docs, seeds)
    return docs


def _without(docs: DataFrame, seeds: Seeds) -> DataFrame:
    ids, tokens, name = seeds.ids, seeds.tokens, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = common.kept(("seeds", name), lambda: Seeds(ids, tokens))
        for batch in batches:
            data, at = common.buffers(batch.column("text"))
            keep = np.ones(len(batch), bool)
            for lo, hi in common.passes(at):
                h, _, first = common.words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], common.PUNCT)
                for o, *_ in own.verified(h, first):
                    keep[lo + o] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
