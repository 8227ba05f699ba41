"""Token ids of many texts at once: each distinct piece is encoded once.

Texts are cut only where the byte-level BPE pattern starts a new match whatever stands around: before white space that follows
something else, and between ASCII letters, digits and punctuation; an apostrophe stays with what follows it. So a text's ids are those
of its pieces one after the other. A text that has a special token's string is one piece.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codesieve.llm.common import byte_lengths, flat, ranges, text_bytes

#: Kinds of bytes. Control characters and rare ASCII white space are OTHER, where nothing is cut.
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, WHITE, BEYOND = range(7)


def kind(byte: int) -> int:
    char = chr(byte)
    if byte > 127:
        return BEYOND
    if char in " \t\n\r":
        return WHITE
    if char.isalnum():
        return LETTER if char.isalpha() else DIGIT
    return OTHER if byte < 33 or byte == 127 else APOSTROPHE if char == "'" else MARK


KIND = bytes(kind(i) for i in range(256))
#: By 8 * kind of a byte + kind of the next: whether a piece ends between them.
CUT = np.zeros((8, 8), bool)
CUT[LETTER, [DIGIT, MARK, APOSTROPHE]] = CUT[DIGIT, [LETTER, MARK, APOSTROPHE]] = CUT[MARK, [LETTER, DIGIT]] = True
CUT[[LETTER, DIGIT, MARK, APOSTROPHE, BEYOND], WHITE] = True
CUT = CUT.ravel().tobytes() + bytes(192)
#: White space beyond ASCII, as the last three bytes; what some versions of Unicode call so is among it.
WIDE = np.array([int.from_bytes(chr(i).encode()) for i in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)])
#: Bytes of a piece that is remembered, at most.
LONG = 256


def cuts(data: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start and the last ends; a text that is `whole` is one piece, an empty text none."""
    cut = np.zeros(len(data) + 1, bool)
    kinds = np.frombuffer(data.tobytes().translate(KIND), np.uint8)
    cut[1:-1] = np.frombuffer(((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(CUT), bool)
    at = np.flatnonzero(cut[1:-1] & (kinds[:-1] == BEYOND)) + 1  # behind a character of two bytes at least
    two = data[at - 1] | data[at - 2].astype(np.int64) << 8
    three = two | data[np.maximum(at - 3, 0)].astype(np.int64) << 16
    cut[at[np.isin(two, WIDE) | np.isin(three, WIDE)]] = False
    for i in np.flatnonzero(whole).tolist():
        cut[starts[i] : starts[i + 1]] = False
    cut[starts] = True
    cut[-1] = True
    return np.flatnonzero(cut)


class Memory:
    """Pieces by number, and where in `ids` the ids of each number start and how many they are."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.at, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """-1 for a piece that isn't here."""
        return np.fromiter(map(self.number.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[str], ids: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The numbers of new pieces."""
        new = np.arange(len(self.at), len(self.at) + len(pieces))
        self.number.update(zip(pieces, new.tolist(), strict=True))
        self.at, self.counts = np.concatenate([self.at, len(self.ids) + at]), np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])
        return new


Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


class PieceEncoder:
    """encode_alone, encode_pieces: ids of strings independent of each other, where those of each start, and their counts; the second gets pieces without special tokens. most: pieces remembered, in two generations. special: strings for which a text is one piece."""

    def __init__(self, encode_alone: Callable[[list[str]], Encoded], encode_pieces: Callable[[list[str]], Encoded], most: int, special: tuple[str, ...] = ()):
        self.encode_alone, self.encode_pieces, self.most, self.special = encode_alone, encode_pieces, most, special
        self.young, self.old = Memory(), Memory()

    def known(self, pieces: list[str]) -> np.ndarray:
        """The number in the young memory of each piece, encoded now if it isn't remembered."""
        if len(self.young.number) > self.most:
            self.old, self.young = self.young, Memory()
        out = self.young.numbers(pieces)
        if len(missing := np.flatnonzero(out < 0)):
            names = [pieces[i] for i in missing.tolist()]
            before = self.old.numbers(names)
            seen, new = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            if len(seen):
                counts = self.old.counts[before[seen]]
                out[missing[seen]] = self.young.add([names[i] for i in seen.tolist()], self.old.ids[ranges(self.old.at[before[seen]], counts)], np.cumsum(counts) - counts, counts)
            if len(new):
                names = [names[i] for i in new.tolist()]
                out[missing[new]] = self.young.add(names, *self.encode_pieces(names))
        return out

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the rows one after the other, and where each row's ids start and the last end."""
        texts = flat(column)
        data, starts = text_bytes(texts)
        whole = np.zeros(len(texts), bool)
        for x in self.special:
            whole |= pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)
        places = cuts(data, starts, whole)
        coded = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        codes, rows = coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(places, starts)
        apart = byte_lengths(coded.dictionary) > LONG
        apart[codes[rows[:-1][whole]]] = True
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        at, counts = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        numbers = self.known(names[~apart].tolist())
        at[~apart], counts[~apart], pool = self.young.at[numbers], self.young.counts[numbers], self.young.ids
        if apart.any():
            ids, begins, counts[apart] = self.encode_alone(names[apart].tolist())
            at[apart], pool = len(pool) + begins, np.concatenate([pool, ids])
        del coded, names, numbers, apart  # the largest arrays come last
        lengths = counts[codes]
        return pool[ranges(at[codes], lengths)], np.concatenate([[0], np.cumsum(lengths)])[rows]
