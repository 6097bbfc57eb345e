"""Operator 10: token counts of a SentencePiece model.

Method: distinct pre-tokens go into a trie. A trie node holds the forward score of its prefix with
the number of tokens on the best path, so a prefix that words share is scored once; the node where
a pre-token ends gives its count, which is kept. A text's count is the sum over its pre-tokens. In
a merge (BPE) model the forward score is whether merging allows the path (pieces.py).

Results: one row per document with n_tokens, and totals per group by totals(). The counts equal the
number of ids that operator 9 makes with the same model.

Null or empty text: 0 tokens. Ties between segmentations: as in operator 9. Repeated rows: each is
counted. Extra columns are kept by counted(); one named as the output is replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, pieces
from .sentencepiece_codec import read_model

#: Trie nodes and counts held at once; either then starts anew. Only speed and memory depend on them.
NODES = 600_000
COUNTS = 800_000
#: Characters of a pre-token that go into the trie; the rest of a longer one is scored with a window of the last positions.
DEPTH = 64


class CountTrie:
    """Trie of pre-tokens. A node holds its prefix's forward score, last piece and number of tokens."""

    def __init__(self, model: bytes):
        self.pieces = pieces.Pieces(model)
        self.terminal: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        """Only the empty prefix is left."""
        self.next: dict[int, int] = {}
        self.best: list[float] = [0]
        self.last: list[int] = [pieces.FREE]
        self.tokens: list[int] = [0]

    def count(self, word: str) -> int:
        """Tokens of one pre-token with its blank; only the part of it that the trie lacks is scored."""
        if len(self.best) >= NODES:
            self.clear()
        text, path, node, follow = " " + word, [0], 0, self.next.get
        for ch in text[:DEPTH]:
            node = follow(node << 21 | ord(ch))
            if node is None:
                break
            path.append(node)
        if len(path) <= len(text):
            tokens = self._extend(text, path) if len(text) <= DEPTH else self._long(text, path)
        else:
            tokens = self.tokens[path[-1]]
        if len(word) <= DEPTH:
            if len(self.terminal) >= COUNTS:
                self.terminal.clear()
            self.terminal[word] = tokens
        return tokens

    def _extend(self, text: str, path: list[int]) -> int:
        """Nodes for the prefixes of text longer than path, each scored from its ancestors on path; tokens of the whole text."""
        model = self.pieces
        best, last, tokens, follow = self.best, self.last, self.tokens, self.next
        pairs, stays, had = model.known_pairs, model.stays, len(path)
        found: dict[int, list[tuple[int, int]]] = {}
        for end, piece in model.automaton.iter(text):
            if end + 1 >= had:
                found.setdefault(end + 1, []).append(piece)
        for end in range(had, len(text) + 1):
            ch = text[end - 1]
            top, via = 0.0, (1, pieces.FREE)
            if model.merges:
                for piece in found.get(end, ()):
                    before = last[path[end - piece[0]]]
                    if before < 0 or pairs.get(before << 32 | piece[1]) or stays(before, piece[1]):
                        via = piece
                        break
            else:
                top, via = model.relax(ch, found.get(end, ()), lambda length, end=end: best[path[end - length]])
            made = len(best)
            follow[path[-1] << 21 | ord(ch)] = made
            best.append(top)
            last.append(via[1])
            tokens.append(tokens[path[end - via[0]]] + (1 if via[1] >= 0 else len(model.fallback(ch))))
            path.append(made)
        return tokens[path[-1]]

    def _long(self, text: str, path: list[int]) -> int:
        """Tokens of a text too long for the trie: on from the node where it leaves it, with a window of the last positions."""
        model = self.pieces
        best, last, tokens = ([kind[n] for n in path] for kind in (self.best, self.last, self.tokens))
        off, found, done = 0, [], len(path) - 1  # off: positions before those that are still held
        for end, some in itertools.chain(model.automaton.iter(text), [(len(text), None)]):
            while done < end:  # all that ends at the character done is found
                top, via = 0.0, (1, pieces.FREE)
                if model.merges:
                    for piece in found:
                        before = last[done + 1 - piece[0] - off]
                        if before < 0 or model.stays(before, piece[1]):
                            via = piece
                            break
                else:
                    top, via = model.relax(text[done], found, lambda n, to=done + 1 - off: best[to - n])
                tokens.append(tokens[done + 1 - via[0] - off] + (1 if via[1] >= 0 else len(model.fallback(text[done]))))
                best.append(top)
                last.append(via[1])
                found = []
                done += 1
                if len(tokens) > 4096 + model.longest:
                    off += 4096
                    del best[:4096], last[:4096], tokens[:4096]
            if end == done:
                found.append(some)
        return tokens[-1]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        get, made = self.terminal.get, self.count
        return sum([get(w) or made(w) for w in pieces.pretokens(text)])


def trie_of(model: bytes) -> CountTrie:
    """Kept by the worker while it does nothing else, so that later tasks find the words of earlier ones."""
    return common.kept(("trie", model), lambda: CountTrie(model))


def counted(df: DataFrame, model: bytes, text: str = "text", tokens: str = "n_tokens") -> DataFrame:
    """Adds tokens: the number of tokens of each whole text."""
    kept = [f for f in df.schema if f.name != tokens]
    schema = T.StructType([*kept, T.StructField(tokens, T.LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(model)
        for whole in batches:
            _, at = common.buffers(whole.column(text))
            for lo, hi in common.passes(at, 8 << 20):
                batch = whole.slice(lo, hi - lo)
                made = [trie.text(t) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.int64())], names=[*names, tokens])

    return df.mapInArrow(run, schema)


def totals(df: DataFrame, model: bytes, by: list[str]) -> DataFrame:
    """Documents and tokens of each group; only counts are shuffled."""
    some = counted(df.select(*by, "text"), model).drop("text")
    return some.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return counted(docs, read_model()).select("doc_id", "n_tokens")
