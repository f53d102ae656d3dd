"""Encoding and decoding with the pieces of a SentencePiece model.

An Aho-Corasick automaton over the pieces reads a segment once. At each position its output
links name the pieces that end there; each offers the best score of the position where it
starts plus its own, and the best offer stays (Viterbi). For a unigram model every piece is
admissible. A byte-pair model defines its result by merges, not by a sum of scores: there a
piece is admissible after the one its start was reached by only if merging the two alone
leaves them as they are. A sequence all of whose neighbours pass is the result of the merges,
and the only one, so the same pass over the automaton finds it.

No piece but runs of spaces has a space after its first letter, and letters of no piece
stand alone, so a text falls into segments that can be encoded one by one. Words recur: a
worker remembers the short segments it has met, up to a fixed number of bytes."""

from __future__ import annotations

import re
from itertools import groupby

import ahocorasick
import numpy as np

SPACE = "▁"
#: Bytes of segments with their ids, and pairs, a worker remembers at most; then it starts afresh.
REMEMBERED_BYTES, REMEMBERED_PAIRS = 64 << 20, 600_000
#: Longer segments are not remembered; bytes of one besides its letters and ids, about.
SEGMENT_CHARS, SEGMENT_BYTES = 64, 250
#: How far below the least score a letter without a piece lies (a fixed value).
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class PieceModel:
    def __init__(self, serialized: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(serialized)
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are read")
        norm = proto.normalizer_spec
        if proto.trainer_spec.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("spaces must be escaped and lead a word")
        self.merges = proto.trainer_spec.model_type == BPE
        self.unknown = proto.trainer_spec.unk_id
        self.prefix = norm.add_dummy_prefix
        self.strip = norm.remove_extra_whitespaces
        plain = not norm.precompiled_charsmap and not self.strip
        self._normalize = None if plain else SentencePieceProcessor(model_proto=serialized).normalize
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.bytes_of: dict[int, int] = {i: int(p[1:-1], 16) for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        self.byte_ids = {b: i for i, b in self.bytes_of.items()} if proto.trainer_spec.byte_fallback else {}
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (NORMAL, USER)}
        self.scores = {p: (float if self.merges else np.float32)(proto.pieces[i].score) for p, i in self.ids.items()}
        self.unknown_score = np.float32(min(self.scores.values()) - UNKNOWN_PENALTY)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        if any(SPACE in p.strip(SPACE) or p.endswith(SPACE) and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after its first letter")
        known = {c for p in self.ids for c in p} - {SPACE}
        some = "".join(map(re.escape, sorted(known)))
        self._segments = re.compile(f"{SPACE}+[{some}]*|[{some}]+|[^{some}{SPACE}]")
        self._known: dict[str, tuple[int, ...]] = {}
        self._held = 0
        self._pairs: dict[tuple[str, str], bool] = {}
        self._made: dict[str, tuple[str, str, bool] | None] = {}
        self._raw = [None if i in self.bytes_of or i in self.silent else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def normalized(self, text: str) -> str:
        if self._normalize:
            return self._normalize(text)
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    # encoding

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self._known
        for segment in self._segments.findall(self.normalized(text)):
            ids = known.get(segment)
            if ids is None:
                ids = tuple(i for p in self._viterbi(segment) for i in self._ids(p))
                if len(segment) <= SEGMENT_CHARS:
                    self._held += SEGMENT_BYTES + 2 * len(segment) + 8 * len(ids)
                    if self._held > REMEMBERED_BYTES:
                        known.clear()
                        self._held = 0
                    known[segment] = ids
            out += ids
        if not self.byte_ids:  # letters without a piece, side by side, are one unknown piece
            out = [i for k, same in groupby(out) for i in ([k] if k == self.unknown else same)]
        return out

    def _ids(self, piece: str) -> list[int]:
        if (i := self.ids.get(piece)) is not None:
            return [i]
        return [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unknown]

    def _viterbi(self, segment: str) -> list[str]:
        n = len(segment)
        if n == 1:
            return [segment]
        reached: list[str | None] = [""] + [None] * n
        found = self.automaton.iter(segment)
        if odd := [i for i, c in enumerate(segment) if c not in self.ids]:
            found = sorted([*found, *((i, segment[i]) for i in odd)], key=lambda f: (f[0], -len(f[1])))
        if self.merges:
            pairs = self._pairs
            for end, piece in found:  # the first admissible piece of a position is the only one
                if reached[end + 1] is None and (before := reached[end + 1 - len(piece)]) is not None:
                    ok = pairs.get((before, piece))
                    if ok or ok is None and self._admissible(before, piece):
                        reached[end + 1] = piece
        else:
            best: list[np.float32 | None] = [np.float32(0)] + [None] * n
            for end, piece in found:
                if (score := best[end + 1 - len(piece)]) is not None:
                    score += self.scores.get(piece, self.unknown_score)
                    if best[end + 1] is None or score > best[end + 1]:
                        best[end + 1], reached[end + 1] = score, piece
        out, at = [], n
        while at:
            out.append(reached[at])
            at -= len(reached[at])
        return out[::-1]

    # which pieces may follow each other in a byte-pair model

    def _admissible(self, before: str, piece: str) -> bool:
        if len(self._pairs) >= REMEMBERED_PAIRS:
            self._pairs.clear()
        ok = self._pairs[before, piece] = self._stays(piece) and (not before or self._keep_apart(before, piece))
        return ok

    def _stays(self, piece: str) -> bool:
        return len(piece) == 1 or self._halves(piece) is not None

    def _halves(self, piece: str) -> tuple[str, str, bool] | None:
        """The last merge that makes ``piece`` of its letters, and whether its parts and
        theirs were all made by better merges; None if merging does not end there."""
        if piece not in self._made:
            parts = self._merged(piece, 2)
            made = None
            if len(parts) == 2 and "".join(parts) in self.scores:
                early = all(len(p) == 1 or self.scores[p] > self.scores[piece] and (h := self._halves(p)) is not None and h[2] for p in parts)
                made = (*parts, early)
            self._made[piece] = made
        return self._made[piece]

    def _keep_apart(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` never joins across the border between them. Read
        backward in time: while the two neighbours of the border stand, a merge of both
        must not beat the one that made the younger of them; then that one is undone."""
        for piece in (left, right):
            if len(piece) > 1 and not self._halves(piece)[2]:
                return self._merged(left + right) == [left, right]
        scores, limit, strict = self.scores, None, False
        while True:
            across = scores.get(left + right)
            if across is not None and (limit is None or across > limit or across == limit and not strict):
                return False
            a, b = scores.get(left) if len(left) > 1 else None, scores.get(right) if len(right) > 1 else None
            if a is None and b is None:
                return True
            if b is None or a is not None and a < b:
                limit, strict, left = a, True, self._halves(left)[1]
            elif a is None or b < a:
                limit, strict, right = b, False, self._halves(right)[0]
            else:  # the same merge on both sides: the left one came first
                limit, strict, right = b, False, self._halves(right)[0]

    def _merged(self, text: str, stop: int = 1) -> list[str]:
        """The merges of a short text, down to ``stop`` parts: always the best-scored, and
        the first of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > stop:
            offers = [(-scores[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in scores]
            if not offers:
                break
            i = min(offers)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    # decoding

    def decode(self, ids: list[int]) -> str:
        raw, bytes_of = self._raw, self.bytes_of
        text = b"".join([r if (r := raw[i]) is not None else bytes([bytes_of[i]]) if i in bytes_of else b"" for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text
