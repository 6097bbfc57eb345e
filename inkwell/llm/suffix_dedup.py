"""Operator 5: removal of long strings that an earlier document has.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.

Method: suffixes are sorted by deep-shallow sorting, that is multikey quicksort to a shallow depth
and blind tries for the groups that remain (strings.py). Sorted are not all suffixes but those at
anchors: the places of the smallest hash of GRAM bytes in any LENGTH-byte string, which depend on
that string alone, so every LENGTH-byte string has an anchor and all its copies have it at the same
place. The suffixes at equal anchors, and the texts before them backwards, are sorted; the common
prefixes of neighbours tell for every offset which of the strings around the anchors are equal, and
the smallest doc_id of each.

Steps: (1) anchors' short hashes are dealt by hash, and those that two documents have come back; a
task looks after copies within its own texts itself. (2) the surroundings of these anchors are
dealt by the anchor and sorted; a task sends equal surroundings once, for its smallest doc_id, and
settles its other documents itself; so a passage in a third of all documents makes at most a few
rows a task. Results are masks of the removed strings by anchor. (3) masks meet their texts.

The hashes in (1) only pick what to look at; what is removed rests on compared bytes.

Null or short text: nothing is removed; null has no bytes. Null doc_id: the row neither loses nor
causes anything. Repeated doc_id: rows of one doc_id don't cause removals in each other; each row
gets its own result. Overlapping copies and ties need no rule, as strings are judged on the input.
Very long texts are treated whole. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .strings import deep_shallow

LENGTH = 50
GRAM = 20
#: Places of an anchor in a string: 0 to LENGTH - GRAM bytes from its start.
PLACES = LENGTH - GRAM + 1
#: Bytes on either side of an anchor's gram, of which every string around it has one side whole.
SIDE = (LENGTH - GRAM) // 2
FLUSH = 500_000
#: Bytes of text whose anchors are found together; about a processor's cache.
PASS = 1 << 17
#: Bytes of text per bucket of anchors and per bucket of surroundings; the numbers of buckets grow with the corpus.
ANCHOR_BYTES = 16 << 20
AROUND_BYTES = 5 << 20

_VALUE = common._constants(99, 256)


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the bytes' values at their places, from which every substring's hash follows."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_VALUE[x] * common.powers(len(x))[0], out=total[1:])
    return total


def hash_at(total: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Hash of k bytes at each start."""
    return common.mix((total[start + k] - total[start]) * common.powers(len(total))[1][start])


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over every width neighbours."""
    m = 1
    while m * 2 <= width:
        x = f(x[:-m], x[m:])
        m *= 2
    return f(x[: len(x) - (width - m)], x[width - m :]) if width > m else x


def anchors(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place (in x), text, hash and the two sides' bytes of hash of the anchors of texts that stand one after the other.

    A side's byte is 0 where the text has fewer than SIDE bytes.
    """
    n = len(x)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, np.uint8)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    outside = text[: n - LENGTH + 1] != text[LENGTH - 1 :]
    total = running(x)
    h = total[GRAM:] - total[:-GRAM]
    h *= common.powers(n)[1][: n - GRAM + 1]
    h = common.mix(h)
    least = sliding(np.minimum, h, PLACES)
    least[outside] = 0
    edge = np.zeros(PLACES - 1, np.uint64)
    at = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), PLACES) == h)
    own = text[at]
    sides = []
    for start in (at - SIDE, at + GRAM):
        fits = (start >= offsets[own]) & (start + SIDE <= offsets[own + 1])
        side = (hash_at(total, np.clip(start, 0, n - SIDE), SIDE) >> np.uint64(56)).astype(np.uint8) | np.uint8(1)
        sides.append(np.where(fits, side, np.uint8(0)))
    return at, own, h[at], sides[0], sides[1]


def joined(h: np.ndarray, *small: np.ndarray) -> np.ndarray:
    """One key from a hash and bytes."""
    for k, s in enumerate(small):
        h = h + s.astype(np.uint64) * common._PLACE[k + 8]
    return h


def ends_of(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest doc among the rows with each row's key."""
    if not len(doc):
        return doc, doc
    order = np.argsort(key)
    sorted_ = key[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    sizes = np.diff(np.append(at, len(order)))
    d = doc[order]
    low, high = np.empty_like(doc), np.empty_like(doc)
    low[order] = np.repeat(np.minimum.reduceat(d, at), sizes)
    high[order] = np.repeat(np.maximum.reduceat(d, at), sizes)
    return low, high


def shared_anchors(doc: np.ndarray, h: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Anchors that another document has with an equal left or right side."""
    out = np.zeros(len(doc), bool)
    low, high = ends_of(doc, h)
    some = np.flatnonzero(low != high)
    for side in (left, right):
        low, high = ends_of(doc[some], joined(h[some], side[some]))
        out[some] |= (low != high) & (side[some] > 0)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, mark (tells rows of one doc_id apart by their text) and text of the rows that take part."""
    some = docs.where("doc_id is not null").where(F.octet_length("text") >= LENGTH)
    return some.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text")


def _blob(parts: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _find(keyed: DataFrame, buckets: int) -> DataFrame:
    """doc, mark and places (32-bit) of the anchors that another document has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            x, at = common.buffers(batch.column("text"))
            doc, mark = np.asarray(batch.column("doc")), np.asarray(batch.column("mark"))
            for lo, hi in common.passes(at, PASS):
                begin = at[lo : hi + 1] - at[lo]
                place, text, *hashes = anchors(x[at[lo] : at[hi]], begin)
                held.append((doc[lo + text], mark[lo + text], (place - begin[text]).astype(np.uint32), *hashes))
                size += len(place)
                if size >= FLUSH:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def send(held: list) -> Iterator[pa.RecordBatch]:
        doc, mark, place, h, left, right = (np.concatenate(c) for c in zip(*held, strict=True))
        # anchors shared within these texts need no answer; of each kind, those of the smallest doc go on for the others
        known = shared_anchors(doc, h, left, right)
        go = np.flatnonzero(doc == ends_of(doc, joined(h, left, right))[0])
        answers = dealt(buckets, doc[known], mark[known], place[known])
        doc, mark, place, h, left, right = (c[go] for c in (doc, mark, place, h, left, right))
        bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        doc, mark, place, h, left, right, bucket = (c[order] for c in (doc, mark, place, h, left, right, bucket))
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if hi > lo:
                own = slice(lo, hi)
                change = np.flatnonzero(np.concatenate([[True], (doc[own][1:] != doc[own][:-1]) | (mark[own][1:] != mark[own][:-1])]))
                counts = np.diff(np.append(change, hi - lo)).astype(np.uint32)
                short = h[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                low, high = (place[own] & 0xFFFF).astype(np.uint16), (place[own] >> 16).astype(np.uint16)
                rows.append((b, doc[own][change].tobytes(), mark[own][change].tobytes(), counts.tobytes(), _blob([short]), low.tobytes(), high.tobytes(), left[own].tobytes(), right[own].tobytes()))
        yield table_of(names, rows, answers)

    # what a task asks others, by the anchor's bucket, and its own answers (the last column), by the document's
    names = ["bucket", "docs", "marks", "counts", "short", "low", "high", "left", "right", "answer"]
    sent = keyed.mapInArrow(scan, f"bucket int, {', '.join(f'{c} binary' for c in names[1:])}")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["answer"] is not None:
                    yield table_of(["bucket", "answer"], [], [(row["bucket"], row["answer"])])
                    continue
                counts = np.frombuffer(row["counts"], np.uint32)
                wide = np.zeros((int(counts.sum()), 8), np.uint8)
                wide[:, :5] = np.frombuffer(row["short"], np.uint8).reshape(-1, 5)
                place = np.frombuffer(row["low"], np.uint16).astype(np.uint32) | (np.frombuffer(row["high"], np.uint16).astype(np.uint32) << 16)
                parts.append((
                    np.repeat(np.frombuffer(row["docs"], np.int64), counts), np.repeat(np.frombuffer(row["marks"], np.int64), counts), place,
                    wide.view("<u8").ravel(), np.frombuffer(row["left"], np.uint8), np.frombuffer(row["right"], np.uint8),
                ))
        if parts:
            doc, mark, place, h, left, right = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            yes = shared_anchors(doc, h, left, right)
            yield table_of(["bucket", "answer"], [], dealt(buckets, doc[yes], mark[yes], place[yes]))

    return gathered(sent.repartition(buckets, "bucket").mapInArrow(match, "bucket int, answer binary"), buckets, False)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Places where any of the sorted keys changes."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def table_of(names: list[str], rows: list[tuple], answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """rows fill all columns but the last, answers the first and the last."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
    blank = [None] * len(answers)
    arrays = [pa.array([*columns[0], *(a[0] for a in answers)], pa.int32())]
    arrays += [pa.array([*c, *blank], pa.binary()) for c in columns[1:]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([*([None] * len(rows)), *(a[1] for a in answers)], pa.binary())], names=names)


def dealt(buckets: int, doc: np.ndarray, mark: np.ndarray, place: np.ndarray, mask: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """Answers in as many packets as there are buckets of documents, so their number doesn't grow with the documents'."""
    mask = np.zeros(len(doc), np.uint32) if mask is None else mask
    to = (common.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(buckets + 1))
    out = []
    for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if hi > lo:
            own = order[lo:hi]
            out.append((b, _blob([doc[own], mark[own], place[own], mask[own]])))
    return out


def gathered(answers: DataFrame, buckets: int, masked: bool) -> DataFrame:
    """doc, mark, places and (if masked) masks: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for raw in batch.column("answer").to_pylist():
                n = len(raw) // 24
                parts.append((np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.uint32, n, 16 * n), np.frombuffer(raw, np.uint32, n, 20 * n)))
        if parts:
            doc, mark, place, mask = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((mark, doc))
            doc, mark, place, mask = doc[order], mark[order], place[order], mask[order]
            begin = _first(doc, mark)
            ends = np.append(begin, len(doc))
            for lo in range(0, len(begin), 5000):
                some = list(zip(ends[lo : lo + 5000], ends[lo + 1 : lo + 5001], strict=False))
                arrays = [pa.array(doc[begin[lo : lo + 5000]]), pa.array(mark[begin[lo : lo + 5000]])]
                arrays += [pa.array([v[a:b].tobytes() for a, b in some], pa.binary()) for v in ((place, mask) if masked else (place,))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "mark", "places", "masks"][: len(arrays)])

    schema = "doc long, mark long, places binary" + ", masks binary" * masked
    return answers.repartition(buckets, "bucket").mapInArrow(run, schema)


def valid_places(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Bit o of each row: whether the string that begins o bytes before the anchor lies in the text.

    before: bytes before the anchor; after: bytes from the anchor on; both at most what a string needs.
    """
    o = np.arange(PLACES)
    ok = (o <= before[:, None]) & (LENGTH - o <= after[:, None])
    return (ok << o).sum(1).astype(np.uint32)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of bytes."""
    wide = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for k in range(wide.shape[1]):
        h += common.mix(wide[:, k]) * common._PLACE[k]
    return common.mix(h)


def classes(strings: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row among the distinct rows, and each distinct row's common prefix with the one before it.

    Equal rows are sorted once: rows of one hash that are compared and found equal to the first.
    """
    _, first, of = np.unique(row_hashes(strings), return_index=True, return_inverse=True)
    if (strings != strings[first[of]]).any():  # a collision
        first, of = np.arange(len(strings)), np.arange(len(strings))
    order, shared = deep_shallow(strings[first], shallow)
    new = shared < strings.shape[1]
    new[:1] = True
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank[of], shared[new]


def removed_places(doc: np.ndarray, before: np.ndarray, after: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Bit o of each row: whether the string o bytes before its anchor is also in a smaller doc of these rows.

    around: PLACES - 1 bytes before the anchor, backwards, then LENGTH bytes from it; zeros beyond the text.
    """
    out = np.zeros(len(doc), np.uint32)
    low, high = ends_of(doc, row_hashes(around[:, PLACES - 1 : PLACES - 1 + GRAM]))
    rows = np.flatnonzero(low != high)
    if not len(rows):
        return out
    doc, before, after, around = doc[rows], before[rows], after[rows], around[rows]
    back, ahead = around[:, : PLACES - 1], around[:, PLACES - 1 :]
    right, shared = classes(ahead, 24)
    group = np.cumsum(shared < GRAM)[right]
    named = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), back], 1)
    left, shared2 = classes(named, 16)
    valid = valid_places(before, after)
    made = np.zeros(len(doc), np.uint32)
    for o in range(PLACES):
        some = np.flatnonzero(valid >> np.uint32(o) & 1)
        if len(some):
            key = np.cumsum(shared < LENGTH - o)[right[some]] * (len(shared2) + 1) + np.cumsum(shared2 < 8 + o)[left[some]]
            made[some[doc[some] > ends_of(doc[some], key)[0]]] |= np.uint32(1 << o)
    out[rows] = made
    return out


def _sort(keyed: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """doc, mark, places and masks: the removed strings around anchors."""
    rows = keyed.join(found, ["doc", "mark"])
    width = PLACES - 1 + LENGTH
    names = ["bucket", "docs", "marks", "at", "before", "after", "around", "answer"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            x, at = common.buffers(batch.column("text"))
            doc, mark = np.asarray(batch.column("doc")), np.asarray(batch.column("mark"))
            for i, places in enumerate(batch.column("places").to_pylist()):
                own = x[at[i] : at[i + 1]]
                place = np.unique(np.frombuffer(places, np.uint32)).astype(np.int64)
                padded = np.concatenate([np.zeros(PLACES - 1, np.uint8), own, np.zeros(LENGTH, np.uint8)])
                view = np.lib.stride_tricks.sliding_window_view(padded, width)[place]
                around = np.concatenate([view[:, PLACES - 2 :: -1], view[:, PLACES - 1 :]], 1)
                held.append((np.full(len(place), doc[i]), np.full(len(place), mark[i]), place.astype(np.uint32), np.minimum(place, PLACES - 1).astype(np.uint8), np.minimum(len(own) - place, LENGTH).astype(np.uint8), around))
                size += len(place)
                if size >= FLUSH // 3:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def send(held: list) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        doc, mark, place, before, after, around = (np.concatenate(c) for c in zip(*held, strict=True))
        # equal surroundings: only the smallest doc's go on; the others are settled
        same = np.concatenate([around, before[:, None], after[:, None]], 1)
        same = np.ascontiguousarray(np.pad(same, ((0, 0), (0, -same.shape[1] % 8)))).view(np.uint64)
        key = row_hashes(same.view(np.uint8))
        order = np.lexsort((doc, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (same[order][1:] != same[order][:-1]).any(1)
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        settled = order[doc[order] > doc[lead]]
        go = order[doc[order] == doc[lead]]
        mask = valid_places(before[settled], after[settled])
        some = mask > 0
        answers = dealt(buckets, doc[settled][some], mark[settled][some], place[settled][some], mask[some])
        h = row_hashes(around[go, PLACES - 1 : PLACES - 1 + GRAM])
        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        go = go[np.argsort(bucket, kind="stable")]
        ends = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            own = go[ends[b] : ends[b + 1]]
            if len(own):
                rows.append((b, *(c[own].tobytes() for c in (doc, mark, place, before, after)), pack.compress(_blob([around[own]]))))
        yield table_of(names, rows, answers)

    sent = rows.mapInArrow(scan, f"bucket int, {', '.join(f'{c} binary' for c in names[1:])}")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        parts = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["answer"] is not None:
                    yield table_of(["bucket", "answer"], [], [(row["bucket"], row["answer"])])
                    continue
                kinds = (("docs", np.int64), ("marks", np.int64), ("at", np.uint32), ("before", np.uint8), ("after", np.uint8))
                around = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["around"]), np.uint8)
                parts.append([*(np.frombuffer(row[c], t) for c, t in kinds), around])
        if parts:
            doc, mark, place, before, after, around = (np.concatenate(c) for c in zip(*parts, strict=True))
            parts.clear()
            mask = removed_places(doc, before.astype(np.int64), after.astype(np.int64), around.reshape(len(doc), width))
            some = mask > 0
            yield table_of(["bucket", "answer"], [], dealt(buckets, doc[some], mark[some], place[some], mask[some]))

    return gathered(sent.repartition(buckets, "bucket").mapInArrow(sort, "bucket int, answer binary"), buckets, True)


def covered(n: int, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of n bytes are removed."""
    bits = np.unpackbits(np.ascontiguousarray(masks, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    row, o = np.nonzero(bits)
    start = places[row].astype(np.int64) - o
    change = np.bincount(start, minlength=n + 1) - np.bincount(start + LENGTH, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of every document."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    found = common.cut(_find(keyed, max(least, -(-size // ANCHOR_BYTES))), "shared-anchors")
    masks = common.cut(_sort(keyed, found, max(least, -(-size // AROUND_BYTES))), "masks")
    rows = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = common.buffers(batch.column("text"))
            gone, spans, kept = [], [], []
            for i, (places, masks) in enumerate(zip(batch.column("places").to_pylist(), batch.column("masks").to_pylist(), strict=True)):
                own = x[at[i] : at[i + 1]]
                if not places:
                    gone.append(0)
                    spans.append(0)
                    kept.append(own.tobytes())
                    continue
                away = covered(len(own), np.frombuffer(places, np.uint32), np.frombuffer(masks, np.uint32))
                gone.append(int(away.sum()))
                spans.append(int((away & ~np.concatenate([[False], away[:-1]])).sum()))
                kept.append(own[~away].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    with_masks = rows.join(masks, ["doc", "mark"], "left").select("doc_id", "text", "places", "masks")
    return with_masks.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove(common.table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None]) -> dict[int, tuple[int, int, int, str]]:
    """What query() gives, for a small table: every string of LENGTH bytes with the smallest doc_id that has it."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    first: dict[bytes, int] = {}
    for i in sorted(raw):
        for p in range(len(raw[i]) - LENGTH + 1):
            first.setdefault(raw[i][p : p + LENGTH], i)
    out = {}
    for i, b in raw.items():
        away = bytearray(len(b))
        for p in range(len(b) - LENGTH + 1):
            if first[b[p : p + LENGTH]] < i:
                away[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, gone in zip(b, away, strict=True) if not gone)
        out[i] = (len(b), sum(away), bytes(away).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest())
    return out
