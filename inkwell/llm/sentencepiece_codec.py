"""Operator 9: SentencePiece encoding and decoding.

Method: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi; at each position the
output links give every piece that ends there, and each relaxes the best path (pieces.py).

Results: the piece ids of every whole text, equal to the model's own encoder's (but a U+2581 in a
text becomes bytes, not a blank), and the text back from the ids. The round trip is exact for every
text under a model with byte pieces.

Null text: treated as empty, so no ids. Empty text: no ids. Ties: pieces.py. Repeated
rows: each is encoded. Extra columns: the operators keep them; columns named as an output are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words kept with their ids per worker; only speed depends on it.
CACHE = 300_000
#: Largest model file that is sent with the tasks.
MODEL_BYTES = 16 << 20


def read_model(path: str = MODEL) -> bytes:
    """The vocabulary file, read on the driver; its size is checked because it goes with every task."""
    data = Path(path).read_bytes()
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MODEL_BYTES} are sent with the tasks")
    return data


def coder_of(model: bytes) -> Encoder:
    """Kept by the worker while it does nothing else, so that later tasks find the words of earlier ones."""
    return common.kept(("coder", model), lambda: Encoder(model))


class Encoder:
    """Texts to packed little-endian 32-bit ids and back."""

    def __init__(self, model: bytes):
        self.pieces = pieces.Pieces(model)
        self.known: dict[str, bytes] = {}
        sizes = np.array([len(b) for b in self.pieces.bytes_of], np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.pieces.bytes_of) or b"\0", np.uint8)

    def _word(self, word: str) -> bytes:
        ids = pieces.packed(self.pieces.segment(" " + word))
        if len(word) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        get, made = self.known.get, self._word
        return b"".join([get(w) or made(w) for w in pieces.pretokens(text)])

    def decode(self, ids: bytes | None) -> str:
        if not ids:
            return ""
        at = np.frombuffer(ids, "<i4")
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        source = np.arange(int(ends[-1])) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        raw = self.bytes[source].tobytes()
        return raw[raw.startswith(b" ") :].decode("utf-8", "replace")


def _with(df: DataFrame, field: T.StructField, extra: tuple[T.StructField, ...] = ()) -> T.StructType:
    names = {field.name, *(f.name for f in extra)}
    return T.StructType([*(f for f in df.schema if f.name not in names), field, *extra])


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """Adds ids: the ids of text as packed little-endian 32-bit integers. check: adds whether they decode to the text."""
    more = (T.StructField(check, T.BooleanType()),) if check else ()
    schema = _with(df, T.StructField(ids, T.BinaryType()), more)
    kept = [f.name for f in schema if f.name not in {ids, check}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model)
        for whole in batches:
            _, at = common.buffers(whole.column(text))
            for lo, hi in common.passes(at, 8 << 20):
                batch = whole.slice(lo, hi - lo)
                texts = batch.column(text).to_pylist()
                made = [coder.encode(t) for t in texts]
                columns = [batch.column(n) for n in kept] + [pa.array(made, pa.binary())]
                if check:
                    columns.append(pa.array([coder.decode(m) == (t or "") for m, t in zip(made, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, *([check] if check else [])])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds text: what the packed ids stand for."""
    schema = _with(df, T.StructField(text, T.StringType()))
    kept = [f.name for f in schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model)
        for whole in batches:
            _, at = common.buffers(whole.column(ids))
            for lo, hi in common.passes(at, 8 << 20):
                batch = whole.slice(lo, hi - lo)
                back = [coder.decode(x) for x in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(back, pa.string())], names=[*kept, text])

    return df.mapInArrow(run, schema)


def summary(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the packed ids) and round_trip of every whole text."""
    done = encode(docs.select("doc_id", "text"), model, check="round_trip")
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "round_trip",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(common.table(spark, sf_dir, "documents"), read_model())
