"""Token ids by a public vocabulary file, for the operators that write or pack them.

The ids are the tokenizers library's. Where its file describes plain byte-level BPE, texts
are cut at places where the library's splitting rule always starts a new word, whatever
stands around them, so the ids of the parts, one after the other, are the ids of the text.
The places are found on the bytes of many texts at once, the distinct parts by Arrow's
dictionary encoding. Parts recur, and a worker remembers the ids of those it met last.
Other files, and texts that hold an added token, go to the library whole."""

from __future__ import annotations

import ctypes
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Characters encoded at once.
CALL_CHARS = 1 << 20
#: Bytes of remembered parts and ids: a worker holds at most twice as many.
REMEMBERED_BYTES = 80 << 20
#: Bytes of a remembered part besides its letters and ids, about.
ENTRY_BYTES = 170
#: Longer parts are not remembered.
PART_CHARS = 100


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ship(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary file to the executors; returns the name it has there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


# Kinds of bytes. OTHER: continues a character, or it is not plain what it begins; MARK: begins
# a character that is not white space; letters of two bytes are LETTER in both.
OTHER, LETTER, DIGIT, SIGN, QUOTE, MARK, SPACE, BREAK = range(8)
#: First bytes of the two-byte letters: Latin, phonetic and Cyrillic blocks (but for two signs, see ``starts``).
LETTER_PAIRS = [*range(0xC3, 0xCB), 0xD0, 0xD1]
#: After the byte, before the byte: where a pair of neighbours lets a part begin.
AFTER, BEFORE = 1, 2


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[0x21:0x7F] = SIGN
    kinds[[b for b in range(128) if chr(b).isalpha()]] = LETTER
    kinds[[b for b in range(128) if chr(b).isdigit()]] = DIGIT
    kinds[0x27], kinds[0x20], kinds[[9, 10, 13]] = QUOTE, SPACE, BREAK
    kinds[[*range(0xCB, 0xE1), *range(0xE4, 0xF5)]] = MARK  # C2, E1, E2, E3 may begin white space
    kinds[LETTER_PAIRS] = LETTER
    return kinds


def _rules() -> np.ndarray:
    """By 8 * kind + kind of the next byte. A run of letters, digits or signs ends at anything
    plainly of another kind; a quote and what follows may be one of the rule's short forms. Of
    the white space before something visible, the last character stands alone, or, a space, is
    the beginning of the word."""
    rules = np.zeros((8, 8), np.uint8)
    for kind in (LETTER, DIGIT, SIGN):
        for following in (LETTER, DIGIT, SIGN, SPACE, BREAK):
            rules[kind, following] = AFTER * (kind != following)
    rules[[LETTER, DIGIT], QUOTE] = AFTER
    rules[QUOTE, [SPACE, BREAK]] = AFTER
    for visible in (LETTER, DIGIT, SIGN, QUOTE, MARK):
        rules[SPACE, visible], rules[BREAK, visible] = BEFORE, BEFORE | AFTER
    return rules.ravel()


KINDS, RULES = _kinds(), _rules()


def starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin; ``data`` are their bytes, ``ends`` where each text ends."""
    kinds = KINDS[data]
    pairs = np.flatnonzero((data >= LETTER_PAIRS[0]) & (data <= LETTER_PAIRS[-1]) & (kinds == LETTER))
    sign = (data[pairs] == 0xC3) & (data[pairs + 1] | 0x20 == 0xB7)  # multiplication and division
    kinds[pairs[sign]] = MARK
    kinds[pairs[~sign] + 1] = LETTER
    both = kinds << 3
    both[:-1] |= kinds[1:]
    ends = ends[ends > 0]
    both[ends - 1] = 0  # nothing follows a text's last byte
    found = RULES[both]
    begins = found & BEFORE > 0
    begins[1:] |= (found[:-1] & AFTER).view(bool)
    begins[:1] = True
    begins[ends[ends < len(data)]] = True
    return np.flatnonzero(begins)


def _plain(sign: str) -> bool:
    """Whether it is plain that the character is not white space."""
    return "!" <= sign <= "~" or sign.isalnum()


class Encoder:
    def __init__(self, path: str, plain: bool = False, remembered: int | None = None):
        """``plain``: the strings of special tokens inside texts are ordinary text."""
        self.remembered = REMEMBERED_BYTES if remembered is None else remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        split, model = described.get("pre_tokenizer") or {}, described.get("model") or {}
        self._added = [] if plain else [t["content"] for t in described.get("added_tokens") or []]
        self._by_parts = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                          and not described.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout"))
        #: The narrowest of uint16 and uint32 that holds every id.
        self.dtype = np.dtype("<u2" if self._library.get_vocab_size() <= 1 << 16 else "<u4")
        # byte-level pieces are written with one sign for each byte
        self._bytes_of = np.zeros(self._library.get_vocab_size(), np.int64)
        for token, i in self._library.get_vocab().items():
            self._bytes_of[i] = len(token)
        #: Ids by part.
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held = 0

    def vocabulary(self) -> list[str]:
        """The token of each id; ids without one are empty."""
        out = [""] * self._library.get_vocab_size()
        for token, i in self._library.get_vocab().items():
            out[i] = token
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, parts: list[str]) -> dict[str, bytes]:
        """The library's ids of parts: in one text, told apart again by their bytes, where a word
        begins before and after each anyway."""
        lead = ["" if p[0] == " " and p[1:] and _plain(p[1]) else "\n" if _plain(p[0]) and _plain(p[-1]) else None for p in parts]
        alone = [p for p, before in zip(parts, lead) if before is None]
        made = dict(zip(alone, (ids.tobytes() for ids in self._whole(alone))))
        rest = [(p, before) for p, before in zip(parts, lead) if before is not None]
        if rest:
            ids = self._whole(["".join(before + p for p, before in rest)])[0]
            ends = np.cumsum(self._bytes_of[ids])
            sizes = np.array([len(p.encode()) for p, _ in rest])
            skipped = np.array([len(before) for _, before in rest])
            to = np.cumsum(sizes + skipped)
            lows = np.searchsorted(ends, to - sizes, "right")
            highs = np.searchsorted(ends, to) + 1
            raw, width = ids.tobytes(), self.dtype.itemsize
            for (p, _), low, high in zip(rest, (lows * width).tolist(), (highs * width).tolist()):
                made[p] = raw[low:high]
        return made

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        made = {p: self._old[p] for p in missing if p in self._old}
        made |= self._ask([p for p in missing if p not in made])
        kept = {p: i for p, i in made.items() if len(p) <= PART_CHARS}
        size = sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY_BYTES * len(kept)
        if self._held + size > self.remembered:
            self._young, self._old, self._held = {}, self._young, 0
        if size <= self.remembered:
            self._young |= kept
            self._held += size
        return made

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, whole, without special tokens."""
        if not self._by_parts:
            return self._whole(texts)
        added = [any(a in t for a in self._added) for t in texts]
        column = pa.array(["" if a else t for t, a in zip(texts, added)], pa.string())
        ends = np.frombuffer(column.buffers()[1], np.int32)[:len(texts) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[:ends[-1]]
        at = starts(data, ends[1:])
        places = pa.py_buffer(np.append(at, len(data)).astype(np.int32))
        parts = pa.StringArray.from_buffers(len(at), places, pa.py_buffer(data)).dictionary_encode()
        known = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self._young.get, known))
        if None in found:
            made = self._learn([p for p, i in zip(known, found) if i is None])
            found = [made[p] if i is None else i for p, i in zip(known, found)]
        ids = pa.array(found, pa.binary()).take(parts.indices)
        width = self.dtype.itemsize
        raw = np.frombuffer(ids.buffers()[2] or b"", np.uint8)
        cuts = np.frombuffer(ids.buffers()[1] or bytes(4), np.int32)[np.searchsorted(at, ends)].tolist()
        out = [raw[low:high].view(self.dtype) for low, high in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(added).tolist():
            out[i] = self._whole([texts[i]])[0]
        return out


_LOADED: dict[tuple[str, bool, int | None], Encoder] = {}


def encoder(name: str, plain: bool = False, remembered: int | None = None) -> Encoder:
    """The worker's encoder for a file sent by ``ship``."""
    if (name, plain, remembered) not in _LOADED:
        _LOADED[name, plain, remembered] = Encoder(SparkFiles.get(name), plain, remembered)
    return _LOADED[name, plain, remembered]


def let_go() -> None:
    """Gives back the memory of the worker's encoders and what they remember; whoever encodes
    next loads the file anew. A worker outlives its task, and would hold them through others."""
    _LOADED.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed inside its arenas
    if trim:
        trim(0)


def encode(name: str, texts: list[str | None], remembered: int | None = None) -> Iterator[np.ndarray]:
    """The ids of each text; a null text is empty. ``remembered`` as in ``REMEMBERED_BYTES``."""
    own, at = encoder(name, remembered=remembered), 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CALL_CHARS):
            chars += len(texts[end] or "")
            end += 1
        yield from own.encode([t or "" for t in texts[at:end]])
        at = end
