"""A SentencePiece vocabulary as an Aho-Corasick automaton that drives a single-pass Viterbi.

The automaton reports, at each position of a text, every piece that ends there: the longest first,
then those along the output links. Each piece relaxes the best path to that position from the best
path to where the piece begins.

What counts as best follows the kind of model. In a unigram model a path's score is the sum of its
pieces' scores, and of equal sums the longer last piece wins. In a merge (BPE) model a path is
allowed only if merging would leave each two neighbouring pieces as they are; each prefix then has
exactly one allowed path, the one that merging in order of score gives, so the first allowed piece
is the best one. Both give the ids of the model's own encoder.

Pieces are kept with plain blanks in place of U+2581, so that a U+2581 in a text is an ordinary
unknown character and survives the round trip. A character without a piece of its own becomes the
model's byte pieces.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np

#: What stands before the first piece, or is a character without a piece: goes with every neighbour.
FREE = -1


class Pieces:
    """One model; built once per Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        self.merges = spec.trainer_spec.model_type == spec.trainer_spec.BPE
        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unk_id = read.unk_id()
        self.byte_id: dict[int, int] = {}
        self.id_of: dict[str, int] = {}
        self.score: list[float] = [read.get_score(i) for i in range(read.vocab_size())]
        self.bytes_of: list[bytes] = []
        self.text_of: dict[int, str] = {}
        for i in range(read.vocab_size()):
            if read.is_byte(i):
                self.byte_id[int(read.id_to_piece(i)[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(read.id_to_piece(i)[1:-1], 16)]))
            elif read.is_control(i) or read.is_unknown(i) or read.is_unused(i):
                self.bytes_of.append(b"")
            else:
                piece = read.id_to_piece(i).replace("▁", " ")
                self.id_of[piece] = i
                self.text_of[i] = piece
                self.bytes_of.append(piece.encode())
        self.unknown = min((self.score[i] for i in self.text_of), default=0) - 10
        self.singles = {p for p in self.id_of if len(p) == 1}
        if any(p.lstrip(" ").count(" ") for p in self.id_of):
            raise ValueError("a piece has a blank after another character; texts can't be parted at blanks")
        if any(ch not in self.singles for p in self.id_of for ch in p) and self.merges:
            raise ValueError("a piece has a character that is no piece")
        self.longest = max(map(len, self.id_of), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.known_pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            self.automaton.add_word(piece, (len(piece), i))
        if self.id_of:
            self.automaton.make_automaton()

    def merged(self, text: str) -> list[int]:
        """Plain merging, the highest score first and of equal ones the leftmost; FREE for unknown characters.

        Used to take pieces apart; no piece is long.
        """
        parts = list(text)
        self_last = (0, 0)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                found = self.id_of.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best[0]):
                    best = (self.score[found], i)
            if best is None:
                break
            i = best[1]
            self_last = (self.id_of.get(parts[i], FREE), self.id_of.get(parts[i + 1], FREE))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 1 and len(text) > 1:
            self.halves[self.id_of[text]] = self_last
        return [self.id_of.get(p, FREE) for p in parts]

    def split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merging makes this one; None for a single character."""
        text = self.text_of[piece]
        if len(text) == 1:
            return None
        if piece not in self.halves and self.merged(text) != [piece]:
            self.halves[piece] = (FREE, FREE)
        return self.halves[piece]

    def stays(self, left: int, right: int) -> bool:
        """Whether merging leaves the neighbours left and right as they are.

        Looks at the symbols beside the boundary backwards in time: undo the later of the two sides'
        last merges; a merge across the boundary must not have come before the one just undone.
        """
        key = left << 32 | right
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) >= 300_000:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        if FREE in (self.split(left) or ()) or FREE in (self.split(right) or ()):
            return False
        undone = None  # score of the merge undone last, and whether it lies left of the boundary
        while True:
            across = self.id_of.get(self.text_of[left] + self.text_of[right])
            if across is not None and (undone is None or self.score[across] > undone[0] or (self.score[across] == undone[0] and not undone[1])):
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            # of equal scores the left one is merged first, so the right one is undone first
            if b is None or (a is not None and self.score[left] < self.score[right]):
                undone = (self.score[left], True)
                left = a[1]
            else:
                undone = (self.score[right], False)
                right = b[0]

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of text as it stands (no blank is put before it)."""
        last = self._merge_path(text) if self.merges else self._sum_path(text)
        path, i = [], len(text)
        while i:
            length, piece = last[i]
            path.append((length, piece))
            i -= length
        return self._ids(path[::-1], text)

    def _ids(self, path: list[tuple[int, int]], text: str) -> list[int]:
        ids, at = [], 0
        for length, piece in path:
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.fallback(text[at]))
            at += length
        return ids

    def _merge_path(self, text: str) -> list[tuple[int, int]]:
        last = [(1, FREE)] * (len(text) + 1)
        done, pairs, stays = 0, self.known_pairs, self.stays
        for end, found in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            before = last[end - found[0]][1]
            if before < 0:
                last[end] = found
                done = end
            else:
                known = pairs.get(before << 32 | found[1])
                if known or (known is None and stays(before, found[1])):
                    last[end] = found
                    done = end
        return last

    def _sum_path(self, text: str) -> list[tuple[int, int]]:
        n = len(text)
        last, best = [(1, FREE)] * (n + 1), [0.0] * (n + 1)
        ends: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.automaton.iter(text):
            ends.setdefault(end + 1, []).append(found)
        for end in range(1, n + 1):
            best[end], last[end] = self.relax(text[end - 1], ends.get(end, ()), lambda length, end=end: best[end - length])
        return last

    def relax(self, ch: str, found, reached) -> tuple[float, tuple[int, int]]:
        """Best score at a position and its last piece. found: the pieces that end there, longest first."""
        top, via = None, (1, FREE)
        for length, piece in found:
            score = reached(length) + self.score[piece]
            if top is None or score > top:
                top, via = score, (length, piece)
        if ch not in self.singles:
            score = reached(1) + self.unknown
            if top is None or score > top:
                top, via = score, (1, FREE)
        return top, via

    def fallback(self, ch: str) -> list[int]:
        """Byte pieces of a character without a piece; the unknown id in a model that has none."""
        return [self.byte_id[b] for b in ch.encode()] if self.byte_id else [self.unk_id]


def pretokens(text: str) -> list[str]:
    """Parts of text that are segmented apart, each without the one blank before it.

    No piece has a blank after another character, so a best segmentation never crosses such a
    place. A run of blanks stays with the word after it. The blank that the model puts before a
    text is the first part's.
    """
    parts = text.split(" ")
    if "" not in parts:
        return parts
    return _AFTER_BLANK.findall(" " + text)


#: What follows the one blank before a pre-token.
_AFTER_BLANK = re.compile(r" ( *[^ ]+| *\Z)")


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<i4").tobytes()
